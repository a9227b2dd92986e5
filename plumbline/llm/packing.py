"""Vector best-fit packing of token pieces into fixed-length sequences.

Every piece needs tokens, one document place and its attention cost (length squared) of a sequence. Those needs depend on the
length alone, so the counts of pieces by length (at most `capacity` numbers, however many documents) are all that choosing
bins needs: the driver packs them longest first, many equal pieces at a time into many bins with equal room, each into the
room with the best score, and the resulting runs "these ranks of this length go to those bins at this offset" are joined to
the pieces by their rank among equals. Ranks come from window functions within (length, bucket of the id's hash), so that a
length which most documents have is dealt over BUCKETS tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import FILE_BYTES, map_arrow, materialise, only
from plumbline.llm.tokens import pieces_of

BUCKETS = 256
VOCABULARY = "byte_bpe_50k.json"


def vector_best_fit(counts: dict[int, int], capacity: int, max_docs: int, max_attention: int, score: str = "residual", weights: tuple[float, float, float] | None = None) -> np.ndarray:
    """Runs (length, first rank, number, first bin, offset) that place counts[length] pieces of each length.

    score: "residual" takes the room whose weighted residual norm after placing is least, "dot" that with the greatest
    weighted dot product of need and room; either only among bins with room in every dimension. weights: of tokens, documents
    and attention; unset, each dimension counts by the number of bins that all pieces together need of it. Ties: the older bin.
    A piece that exceeds an empty bin's capacity in any dimension is an error.
    """
    caps = np.array([capacity, max_docs, max_attention], np.float64)
    sizes, numbers = np.array(list(counts), np.float64), np.array(list(counts.values()), np.float64)
    demand = np.array([sizes @ numbers, numbers.sum(), (sizes**2) @ numbers]) / caps
    w = np.array(weights) if weights else demand / max(demand.max(), 1e-9)
    fill, rooms = {}, {}  # fill state -> [(first bin, number)], and its residual
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        need = np.array([size, 1, size * size], np.float64)
        if (need > caps).any():
            raise ValueError(f"a piece of {size} tokens exceeds a sequence's capacities")
        opened: dict[tuple[int, int, int], list] = {}
        while left:
            states = [s for s in fill if s[0] + size <= capacity and s[1] < max_docs and s[2] + size * size <= max_attention]
            if states:
                room = np.array([rooms[s] for s in states])
                value = (w * ((room - need) / caps) ** 2).sum(1) if score == "residual" else -(w * (need / caps) * (room / caps)).sum(1)
                state = states[int(np.argmin(value))]
            else:
                state = (0, 0, 0)
            after = (state[0] + size, state[1] + 1, state[2] + size * size)
            if state == (0, 0, 0):
                per_bin = min(capacity // size, max_docs, max_attention // (size * size))
                take = -(-left // per_bin)
                blocks = [(bins, take)]
                bins += take
            else:
                blocks = fill.pop(state)
            rest = []
            for first, number in blocks:
                n = min(number, left)
                if n:
                    runs.append((size, rank, n, first, state[0]))
                    fill.setdefault(after, []).append((first, n))
                    rooms[after] = caps - np.array(after, np.float64)
                    left, rank = left - n, rank + n
                if n < number:
                    rest.append((first + n, number - n))
            if rest and state != (0, 0, 0):
                fill[state] = rest
    return np.array(runs, np.int64).reshape(-1, 5)


def _place(batches: Iterator[pa.RecordBatch], runs: np.ndarray, before: np.ndarray, hash_names: list[str]) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keys = (runs[:, 0] << 44) + runs[:, 1]
    for batch in batches:
        length, bucket = (batch.column(c).to_numpy() for c in ("length", "bucket"))
        rank = before[length, bucket] + batch.column("place").to_numpy()
        at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
        columns = [batch.column(c) for c in hash_names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], [*hash_names, "sequence_id", "offset"])


def pack(docs: DataFrame, *, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, max_docs: int | None = None, max_attention: int | None = None, score: str = "residual", with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A text's ids, then end_id; only texts longer than capacity are cut, and their first piece takes the remainder. max_docs
    and max_attention (sum of squared lengths) bound a sequence beside its tokens; unset, they never bind. A NULL text counts
    as empty and is one piece of end_id; repeated rows are packed each by itself; an empty table gives an empty result;
    further columns are ignored.
    """
    spark = docs.sparkSession
    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = materialise(map_arrow(rows, lambda batches: pieces_of(batches, tokenizer_path, capacity, end_id, with_ids), schema), "pieces")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    counts = np.zeros((capacity + 1, BUCKETS), np.int64)
    for r in pieces.groupBy("length", "bucket").count().toLocalIterator():  # at most capacity * BUCKETS rows
        counts[r["length"], r["bucket"]] = r["count"]
    total = counts.sum(1)
    runs = vector_best_fit({int(n): int(total[n]) for n in np.flatnonzero(total)}, capacity, max_docs or capacity, max_attention or capacity * capacity, score)
    before = np.concatenate((np.zeros((capacity + 1, 1), np.int64), np.cumsum(counts, 1)[:, :-1]), 1)
    files = max(1, -(-int(total.sum()) * 64 // FILE_BYTES))  # a piece without its ids takes some 64 bytes
    shared = spark.sparkContext.broadcast((runs, before))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("place", place.cast("long"))
    names = pieces.columns[:-1]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields[:-1])
    out = map_arrow(ranked, lambda batches: _place(batches, *shared.value, names), f"{fields}, sequence_id long, offset long")
    return out if with_ids else out.coalesce(files)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path=public_tokenizers.path(VOCABULARY))
