"""Product codes of vectors: each part of a vector becomes the index of its nearest codebook entry, in integer arithmetic.

Vectors become integers and are packed into columnar NumPy blocks, (part, dimension, row), a row of a table each. A round of
training is one treeAggregate over the RDD of blocks: squared distances to all entries of a part accumulate dimension by
dimension, np.add.at adds the parts to int64 tensors of sums and counts, and the tensors, of the codebooks' size, merge through
a reduction tree, so that neither the driver nor a task receives one from every task. Sums are exact, so they don't
depend on how rows are dealt. The codebooks are sent to the workers: parts x entries x dimensions integers, however many rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.llm.shared import finite_vector, map_arrow, materialise, only

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block: distances of a part to all entries take BLOCK_ROWS x ENTRIES x 8 bytes, twice.
BLOCK_ROWS = 2048
#: Levels of the reduction tree: with depth 3, a million blocks' partitions merge by about a hundred at a time.
DEPTH = 3
MOST = 2**63 - 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, with zeros behind the end of shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integers(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), exactly: as int64, or as Python integers if wide."""
    if not wide:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.size, object)
    out[:] = [math.floor(Fraction(v) * scale) for v in x.ravel().tolist()]
    return out.reshape(x.shape)


def columnar(x: np.ndarray, parts: int) -> np.ndarray:
    """(row, component) as (part, dimension, row)."""
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 2, 0))


def assigned(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and row of a block the nearest entry of the codebooks (part, dimension, entry), the first of equals, and its squared distance."""
    parts, dims, n = block.shape
    codes, errors = np.empty((parts, n), np.int64), np.empty((parts, n), block.dtype)
    for p in range(parts):
        distance = np.zeros((n, book.shape[2]), block.dtype)
        for j in range(dims):
            step = np.subtract.outer(block[p, j], book[p, j])
            step *= step
            distance += step
        codes[p] = distance.argmin(axis=1)
        errors[p] = distance[np.arange(n), codes[p]]
    return codes, errors


def _tensors(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(book.shape, book.dtype), np.zeros((book.shape[0], book.shape[2]), np.int64)


def _add_block(tensors: tuple[np.ndarray, np.ndarray], block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = tensors
    codes, _ = assigned(block, book)
    for p in range(len(block)):
        np.add.at(counts[p], codes[p], 1)
        for j in range(block.shape[1]):
            np.add.at(sums[p, j], codes[p], block[p, j])
    return sums, counts


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def _moved(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at floor(sum / count) of their parts; unused ones where they were."""
    used = np.broadcast_to(counts[:, None, :] > 0, book.shape)
    return np.where(used, sums // np.maximum(counts, 1)[:, None, :], book)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def product_codes(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, depth: int = DEPTH
) -> DataFrame:
    """One row per kept vector: its id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Vectors that are NULL or hold NULL, NaN or infinite components are dropped. A vector whose length isn't that of the longest
    one, or not a multiple of parts, counts as if zeros followed; an empty vector is all zeros. The first codebooks are those of
    the `entries` smallest ids, NULL ids last, rows of equal ids by their components; with fewer rows there are fewer entries.
    Rows that repeat an id are coded each. NULL labels are one label. Components of any size are handled exactly: beyond what
    int64 can sum, blocks hold Python integers; an error beyond a long is given as the largest long. An empty table gives
    an empty result. Further columns are ignored.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("entries must be 1 to 256, parts at least 1")
    spark = vectors.sparkSession
    kept = only(vectors, id_col, vector_col, label_col).toDF("vec_id", "v", "label").filter(finite_vector("v"))
    n, longest, largest = kept.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    dims = max(1, -(-(longest or 0) // parts))
    width = parts * dims
    reach = math.ceil(Fraction(largest or 0.0) * scale) + 1  # no component of vectors or entries is larger
    wide = reach >= 2**31 or reach * max(n, 1) >= 2**63 or width * (2 * reach) ** 2 >= 2**63
    out = StructType([StructField("vec_id", kept.schema["vec_id"].dataType), StructField("label", kept.schema["label"].dataType), StructField("code", StringType()), StructField("error", LongType())])
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).toArrow() if n else None
    if first is None:
        book = np.zeros((parts, dims, 0), np.int64)
    else:
        book = columnar(integers(matrix(first.column("v").combine_chunks(), width), scale, wide), parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            x = matrix(run.column(0), width)
            block = columnar(x, parts) if wide else columnar(integers(x, scale, False), parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([run.num_rows], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["n", "block"])

    def unpacked(row) -> np.ndarray:
        flat = np.frombuffer(row.block, np.float64 if wide else np.int32).reshape(parts, dims, row.n)
        return integers(flat, scale, True) if wide else flat.astype(np.int64)

    if n and rounds:
        packed = StructType([StructField("n", IntegerType()), StructField("block", BinaryType())])
        blocks = materialise(map_arrow(kept.select("v"), pack, packed), "blocks").rdd.map(unpacked)
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(book)
            sums, counts = blocks.treeAggregate(_tensors(book), lambda t, block, sent=sent: _add_block(t, block, sent.value), _merge, depth)
            book = _moved(book, sums, counts)
            sent.unpersist()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            codes, errors = assigned(columnar(integers(matrix(run.column(1), width), scale, wide), parts), book)
            digits = codes.T.astype(np.uint8).tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            error = pa.array([min(e, MOST) for e in errors.sum(axis=0).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([run.column(0), run.column(2), pa.array(code, pa.string()), error], ["vec_id", "label", "code", "error"])

    coded = materialise(map_arrow(kept.select("vec_id", "v", "label"), encode, out), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    totals = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    digest = hashlib.sha256(",".join(str(v) for v in book.transpose(0, 2, 1).ravel().tolist()).encode()).hexdigest()
    rows = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return rows.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Integer division rounds to zero in SQL; this is the floor.
_FLOOR = "(sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*)"


def _rounds(n: int) -> str:
    """Assignment to codebooks 0 to n, and codebooks 1 to n from the one before."""
    out = []
    for k in range(n + 1):
        if k:
            out.append(f"""
book{k} AS MATERIALIZED (
    SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c
    FROM book{k - 1} b LEFT JOIN (
        SELECT p.part, a.entry, p.pos, {_FLOOR} AS c
        FROM parts p JOIN near{k - 1} a ON a.r = p.r AND a.part = p.part
        GROUP BY p.part, a.entry, p.pos) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
        out.append(f"""
near{k} AS MATERIALIZED (
    SELECT r, part, min(struct_pack(d := d, entry := entry)).entry AS entry, min(d) AS d
    FROM (SELECT p.r, p.part, b.entry, sum((p.x - b.c) * (p.x - b.c)) AS d
          FROM parts p JOIN book{k} b ON b.part = p.part AND b.pos = p.pos
          GROUP BY p.r, p.part, b.entry)
    GROUP BY r, part)""")
    return ",".join(out)


SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings e
    WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(e.embedding) AS x) WHERE x IS NULL OR NOT isfinite(x))),
parts AS MATERIALIZED (
    SELECT r, (i - 1) * {PARTS} // n AS part, (i - 1) % (n // {PARTS}) AS pos, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT) AS x
    FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM parts WHERE r <= {ENTRIES}),{_rounds(ROUNDS)},
rows AS (
    SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN rows USING (r)
"""
