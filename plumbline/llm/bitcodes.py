"""Nearest vectors by randomly rotated one-bit codes.

A vector, as a direction, less the mean direction, is rotated at random into at least MIN_BITS dimensions; the signs are its
code, packed into words of 64 bits. Beside the code stand three numbers: what the mean contributes to any product, the factor that
makes the code's product with a rotated query an unbiased estimate, and the spread of its error, which is that of a random direction
in the code's dimensions. A query is rotated too and cut into bit planes, so that a product with a code is a weighted sum of
bit counts of ANDs. Only vectors whose estimate plus EPS spreads reaches the score that the query's k-th best has so far
are compared in double precision, in the task that holds them: what is shuffled are a task's k best of a query.

Every query meets the code of every vector: queries are a stated set, sent to the workers in blocks of a stated size, one
block at a time, each of which meets the whole index in one pass. The score to beat starts as the k-th best among a bounded sample of
vectors; that only saves comparisons, as any k vectors' scores bound the k best from below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.codebooks import matrix
from plumbline.llm.shared import Scratch, chosen, finite_vector, map_arrow, only

K, EVERY = 5, 50
#: A code has as many bits as a vector has components, in whole words, and this many at least.
MIN_BITS = 256
#: Bits of a query's components in a product with a code.
PLANES = 6
#: A vector of the k best is missed if its estimate is off by more than so many standard deviations: 3 in 100,000 of those that lie just at the limit, and fewer of the others.
EPS = 4.0
#: Vectors that the first score to beat is taken from.
SEED_ROWS = 4096
#: Bytes of a block of queries, on average.
QUERY_BYTES = 32 << 20
#: Pairs of queries and vectors that are estimated at a time.
TILE = 1 << 18


def rotation(width: int, bits: int, seed: int) -> np.ndarray:
    """width x bits: rows of a random rotation, orthonormal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, width)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def scaled(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over a power of two, so that no square overflows and no digit changes, and their lengths."""
    x = matrix(column, width)
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    x = np.ldexp(x, -exponent[:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def encoded(x: np.ndarray, length: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, word), and each row's product with the mean, gain and spread."""
    bits = turn.shape[1]
    rest = x / length[:, None] - mean
    size = np.sqrt((rest * rest).sum(axis=1))
    turned = rest @ turn
    code = np.packbits(turned > 0, axis=1).view(np.uint64)
    kept = np.abs(turned).sum(axis=1) / math.sqrt(bits)  # the product of the rest with its code, as directions, times size
    share = np.divide(kept, size, out=np.ones(len(x)), where=size > 1e-12)
    gain = size / share / math.sqrt(bits)
    spread = size * np.sqrt(np.maximum(0.0, 1 - share**2)) / share / math.sqrt(bits - 1)
    return code, rest @ mean, gain, spread


class Queries:
    """A block of queries, ready to meet codes."""

    def __init__(self, table: pa.Table, width: int, mean: np.ndarray, turn: np.ndarray) -> None:
        table = table.combine_chunks()
        self.ids, self.beat = (table.column(c).to_numpy() for c in ("vec_id", "beat"))
        self.x, self.length = scaled(table.column("v").combine_chunks(), width)
        unit = self.x / self.length[:, None]
        turned = (unit - mean) @ turn
        low, high = turned.min(axis=1), turned.max(axis=1)
        self.step = np.maximum(high - low, 1e-12) / (2**PLANES - 1)
        level = np.rint((turned - low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = np.stack([np.packbits((level >> p) & 1 == 1, axis=1).view(np.uint64) for p in range(PLANES)])  # plane, query, word
        self.low, self.sum, self.base = low, turned.sum(axis=1), unit @ mean
        self.size = np.sqrt(((unit - mean) ** 2).sum(axis=1))
        self.bits = turn.shape[1]

    def ceilings(self, at: slice, code: np.ndarray, base: np.ndarray, gain: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """(query, vector): the estimated cosine plus EPS standard deviations of its error. code: (word, vector)."""
        ones = np.bitwise_count(code).sum(axis=0, dtype=np.int64)
        weighted = np.zeros((len(self.ids[at]), code.shape[1]), np.int32)
        for p in range(PLANES):
            plane = np.zeros(weighted.shape, np.uint16)
            for w in range(code.shape[0]):
                plane += np.bitwise_count(self.planes[p, at, w][:, None] & code[w][None, :])
            weighted += plane.astype(np.int32) << p
        low, step = self.low[at][:, None], self.step[at][:, None]
        product = 2 * (low * ones + step * weighted) - self.sum[at][:, None]
        error = self.size[at][:, None] * spread + step * math.sqrt(self.bits / 12) * gain
        return self.base[at][:, None] + base + gain * product + EPS * error + 1e-9


def best(q: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: the largest scores, of equal ones the smallest ids."""
    order = np.lexsort((vec, -score, q))
    first = np.searchsorted(q[order], q[order], "left")
    return order[np.arange(len(order)) - first < k]


def _cosines(a: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """Of rows with rows, each by itself, so that equal vectors have equal scores wherever they stand."""
    return (a * b).sum(axis=1) / (a_length * b_length)


def _first_scores(batches: Iterator[pa.RecordBatch], seeds: pa.Table, width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Adds to queries the score to beat: a little less than the k-th best among the seeds, minus infinity where there are fewer."""
    seeds = seeds.combine_chunks()
    ids = seeds.column("vec_id").to_numpy()
    y, size = scaled(seeds.column("v").combine_chunks(), width) if len(ids) else (np.zeros((0, width)), np.zeros(0))
    y = (y / size[:, None]).T
    for batch in batches:
        x, length = scaled(batch.column("v"), width)
        score = np.full(batch.num_rows, -np.inf)
        own = batch.column("vec_id").to_numpy()
        step = max(1, TILE // max(1, len(ids)))
        for at in range(0, batch.num_rows, step):
            if len(ids) >= k:
                cos = x[at : at + step] / length[at : at + step, None] @ y
                cos[own[at : at + step, None] == ids[None, :]] = -np.inf
                score[at : at + step] = np.partition(cos, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(score)], ["vec_id", "v", "beat"])


def _meet(batches: Iterator[pa.RecordBatch], queries: Queries, width: int, k: int) -> Iterator[pa.RecordBatch]:
    """(row, query_id, vec_id, score): of the vectors of one task each query's k best, if they may be among the k best of all."""
    n = len(queries.ids)
    beat = queries.beat.copy()
    kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query, score, vector
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        y, size = scaled(batch.column("v"), width)
        words = queries.planes.shape[2]
        code = np.ascontiguousarray(np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(len(ids), words).T)
        base, gain, spread = (batch.column(c).to_numpy() for c in ("base", "gain", "spread"))
        step = max(1, TILE // max(1, len(ids)))
        new = [kept]
        for at in range(0, n, step):
            part = slice(at, min(n, at + step))
            ceiling = queries.ceilings(part, code, base, gain, spread)
            ceiling[queries.ids[part][:, None] == ids[None, :]] = -np.inf
            if len(ids) > k:  # a better score to beat first: that of the vectors that look best
                top = np.argpartition(ceiling, len(ids) - k, axis=1)[:, -k:]
                q = np.repeat(np.arange(part.start, part.stop), k)
                scores = _cosines(queries.x[q], queries.length[q], y[top.ravel()], size[top.ravel()])
                scores[np.take_along_axis(ceiling, top, 1).ravel() == -np.inf] = -np.inf
                beat[part] = np.maximum(beat[part], scores.reshape(-1, k).min(axis=1))
            i, j = np.nonzero((ceiling >= beat[part][:, None]) & (ceiling > -np.inf))
            score = _cosines(queries.x[part][i], queries.length[part][i], y[j], size[j])
            good = score >= beat[part][i]
            new.append([i[good] + at, score[good], ids[j[good]]])
        kept = [np.concatenate(c) for c in zip(*new)]
        first = best(kept[0], kept[1], kept[2], k)
        kept = [c[first] for c in kept]
        counts = np.bincount(kept[0], minlength=n)
        last = np.cumsum(counts) - 1
        full = counts == k
        beat[full] = np.maximum(beat[full], kept[1][last[full]])
    yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(queries.ids[kept[0]]), pa.array(kept[2]), pa.array(kept[1])], ["row", "query_id", "vec_id", "score"])


def _mean(rows: DataFrame, width: int) -> np.ndarray:
    """The mean direction: sums of each task, added by component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0
        for batch in batches:
            x, length = scaled(batch.column(0), width)
            total, n = total + (x / length[:, None]).sum(axis=0), n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total), pa.array(np.full(width, n))], ["at", "total", "n"])

    found = map_arrow(rows.select("v"), sums, "at long, total double, n long").groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return np.array([r["mean"] for r in found.orderBy("at").collect()])  # width rows


def index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", min_bits: int = MIN_BITS, seed: int = 13) -> tuple[DataFrame, int, np.ndarray, np.ndarray]:
    """The codes of all usable vectors (vec_id, v, code, base, gain, spread), the longest vector's length, the mean direction and the rotation."""
    usable = finite_vector("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = only(vectors, id_col, vector_col).toDF("vec_id", "v").filter(usable).withColumn("vec_id", F.col("vec_id").cast("long"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    bits = max(min_bits, -(-width // 64) * 64)
    mean = _mean(rows, width) if width else np.zeros(0)
    turn = rotation(width, bits, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, length = scaled(batch.column("v"), width)
            code, *numbers = encoded(x, length, mean, turn)
            packed = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), packed, *map(pa.array, numbers)], ["vec_id", "v", "code", "base", "gain", "spread"])

    kind = rows.schema["v"].dataType.simpleString()
    return map_arrow(rows, encode, f"vec_id long, v {kind}, code binary, base double, gain double, spread double"), width, mean, turn


def nearest_vectors(vectors: DataFrame, asked: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, min_bits: int = MIN_BITS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of the largest cosine for each vector whose id fulfils asked, a condition on id_col; fewer if there are fewer.

    Scores are cosines of the original vectors in double precision; ties go to the smaller id. Vectors that are NULL, zero, empty or
    hold NULL or non-finite components, and those without an id, take no part. Shorter vectors count as if zeros followed. A
    query doesn't meet its own id: rows that repeat an id are the same vector's. A query that repeats gives rows for each of its rows, and
    a vector that repeats is found as often. An empty table, and one without queries, give an empty result. Further columns are
    ignored.
    """
    spark = vectors.sparkSession
    store = Scratch()
    codes, width, mean, turn = index(vectors, id_col=id_col, vector_col=vector_col, min_bits=min_bits)
    codes = store(codes, "codes")
    n = codes.count()
    seeds = codes.filter(chosen(SEED_ROWS / max(n, 1), 5, "vec_id")).select("vec_id", "v").toArrow()  # about SEED_ROWS rows
    kind = codes.schema["v"].dataType.simpleString()
    named = codes.select(F.col("vec_id").alias(id_col), "v").filter(asked).select(F.col(id_col).alias("vec_id"), "v")
    queries = store(map_arrow(named, lambda batches: _first_scores(batches, seeds, width, k), f"vec_id long, v {kind}, beat double"), "queries")
    each = 8 * (3 * width + PLANES * turn.shape[1] // 64 + 8)
    blocks = max(1, -(-queries.count() * each // query_bytes))
    found = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about query_bytes
        block = spark.sparkContext.broadcast(own)

        def meet(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            if block.value.num_rows:
                yield from _meet(batches, Queries(block.value, width, mean, turn), width, k)

        found.append(store(map_arrow(codes, meet, "row long, query_id long, vec_id long, score double"), f"found-{b}"))
        block.destroy()
    rows = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH usable AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS size
    FROM embeddings e
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(e.embedding) AS x) WHERE x IS NULL OR NOT isfinite(x))
        AND EXISTS (SELECT 1 FROM (SELECT unnest(e.embedding) AS x) WHERE x <> 0)),
pairs AS (
    SELECT q.r, q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v) / (q.size * x.size) AS score
    FROM usable q JOIN usable x ON q.vec_id % {EVERY} = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= {K}
"""
