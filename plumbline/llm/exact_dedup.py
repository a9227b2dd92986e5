"""Exact deduplication by content sort, with DataFrame operations alone.

Normalised texts are range-partitioned by their leading characters and digest at splitters that Spark samples, sorted
externally within each partition, and compared in full with their neighbours: the window's groups are runs of adjacent rows
whose whole texts are equal. The sampled keys are short, however long the texts. A text of very many copies is counted
beforehand (partial sums of 32-byte digests), and its copies are dealt over several pieces by a hash of the id, each sorted and
compared by itself. Its group size and surviving id come from that count: a departure from comparing neighbours, for such texts
alone, in that the pieces of one text meet by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import FILE_BYTES, only

#: A text is hot that has more than HOT_COPIES copies, and more than one in HOT_TEXTS of all rows: so fewer than HOT_TEXTS are, a bound on what is broadcast.
HOT_COPIES, HOT_TEXTS = 500, 100_000
#: Characters of a text in its range key; the digest and the whole text follow in the order.
KEY_CHARS = 48
#: Steps that normalise accepts, applied in the order given.
STEPS = {"lower": F.lower, "trim": F.trim, "squeeze": lambda c: F.regexp_replace(c, r"\s+", " ")}


def normalised(text: Column, steps: Sequence[str] = ()) -> Column:
    text = F.coalesce(text, F.lit(""))
    for step in steps:
        text = STEPS[step](text)
    return text


def _sorted(rows: DataFrame, keep: str, row_bytes: int = 0) -> DataFrame:
    """rows (doc_id, text, ...) with keep_id, group_size, kept and text_sha256 added; with row_bytes, which a row takes about, in no more partitions than fill a file each."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    best = F.min if keep == "smallest" else F.max
    others = rows.columns
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    n = rows.count()
    limit = max(HOT_COPIES, n // HOT_TEXTS)
    hot = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("hot_size"), best("doc_id").alias("hot_id")).filter(F.col("hot_size") > limit)
    rows = rows.join(F.broadcast(hot), "text_sha256", "left")  # fewer than HOT_TEXTS rows
    # a NULL identifier hashes alike everywhere, so a hot group without identifiers stays in one piece
    rows = rows.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("hot_size") / limit)), F.lit(0)))
    key = ["prefix", "text_sha256", "piece"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("prefix", F.substring("text", 1, KEY_CHARS)).repartitionByRange(parts, *key)
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    run = Window.partitionBy(*key, "text").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "place": F.row_number().over(run),
        "run_id": F.first("doc_id").over(whole),
        "run_size": F.count(F.lit(1)).over(whole),
    })
    keep_id, size = F.when(F.col("hot_size").isNull(), F.col("run_id")).otherwise(F.col("hot_id")), F.coalesce("hot_size", "run_size")
    kept = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep_id)
    out = rows.select(*others, keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256")
    return out.coalesce(max(1, -(-n * row_bytes // FILE_BYTES))) if row_bytes else out


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Sequence[str] = (), keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised UTF-8 text).

    keep: "smallest" or "largest" identifier stays. NULL texts count as empty texts, and so are equal to each other and to
    empty ones. Rows that repeat an identifier and text are copies like others; one of them stays. NULL identifiers rank
    after all others (a group of NULL identifiers alone keeps one row, and its keep_id is NULL). An empty table gives an
    empty result. Further columns are ignored.
    """
    rows = only(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", normalised(F.col("text"), normalise).alias("text"))
    return _sorted(rows, keep).drop("text").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Sequence[str] = (), keep: str = "smallest") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns, in the same single shuffle."""
    plain = not normalise
    rest = [docs[c] for c in docs.columns if not (plain and c == text_col)]
    rows = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col], normalise).alias("text"), docs[text_col].isNull().alias("no_text"), F.struct(*rest).alias("rest"))
    stay = _sorted(rows, keep, 2048).filter("kept")
    text = F.when(~F.col("no_text"), F.col("text"))
    return stay.select(*[text.alias(c) if plain and c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
