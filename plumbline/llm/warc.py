"""Merkle fixity audit of WARC replicas.

A replica is a table of records (archive, offset, length, sha256). Its leaves are ranges of RANGE bytes of an archive: the hash
of a leaf covers the offsets, lengths and digests of the records that begin in it, in order; each FANOUT neighbouring ranges
make a node of the next level, up to one root per archive. Two replicas are compared root by root, and only children of nodes
that differ are looked at, down to the records. A group holds at most FANOUT nodes, or the distinct records of one range, so
no archive, however many of the records it has, meets in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import is_empty, map_arrow, materialise, only

RANGE = 1 << 16
FANOUT = 16
PIECE = 1 << 20
RECORD = ["archive", "offset", "length", "sha256"]
#: What the drill alters and loses.
ALTERED, LOST = ("00", "01", "02"), ("fd", "fe", "ff")


def page_records(pages: DataFrame, *, per_archive: int = 1000, extra: dict[str, Column] | None = None) -> DataFrame:
    """Response records of pages (page_id, url, html): page_id, archive, offset, length, sha256, and extra (columns made of `record`, the record itself).

    Pages of page_id div per_archive form an archive, in the order of page_id, url and digest; NULL ids go to 4096 archives from
    -4096 to -1 by their records' digests, NULL urls and pages count as empty. Only digests and what extra makes are shuffled,
    not the records.
    """
    extra = extra or {}
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = only(pages, "page_id", "url", "html")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), text("url"), F.lit("\r\nContent-Length: "), F.octet_length(text("html")).cast("string"), F.lit("\r\n\r\n"))
    rows = rows.select("page_id", text("url").alias("url"), F.concat(head, text("html"), F.lit("\r\n\r\n")).alias("record"))
    rows = rows.select("page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha256"), *[c.alias(n) for n, c in extra.items()])
    unnumbered = -1 - F.conv(F.substring("sha256", 1, 3), 16, 10).cast("long")
    rows = rows.withColumn("archive", F.coalesce(F.floor(F.col("page_id") / per_archive), unnumbered))
    before = Window.partitionBy("archive").orderBy("page_id", "url", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return rows.select("page_id", "archive", "offset", "length", "sha256", *extra)


def _gzip_member(content: memoryview, at: int) -> tuple[int, str] | None:
    """Length and digest of the inflated bytes of the gzip member that begins at `at`; None if it is damaged. Input and output are handled in pieces of PIECE bytes."""
    inflate, digest, end = zlib.decompressobj(31), hashlib.sha256(), at
    try:
        while not inflate.eof:
            piece = inflate.unconsumed_tail or content[end : end + PIECE]
            if not len(piece):
                return None
            if not inflate.unconsumed_tail:
                end += len(piece)
            digest.update(inflate.decompress(piece, PIECE))
    except zlib.error:
        return None
    return end - len(inflate.unused_data) - at, digest.hexdigest()


def _begins(content: memoryview, at: int) -> bool:
    """Whether a gzip member that holds a record begins at `at`."""
    try:
        return zlib.decompressobj(31).decompress(content[at : at + 256], 5) == b"WARC/"
    except zlib.error:
        return False


def _next(content: bytes, view: memoryview, at: int, zipped: bool) -> int:
    """Where the first record after `at` begins that can be told; the end if none can."""
    if not zipped:
        found = content.find(b"\r\n\r\nWARC/", at)
        return found + 4 if found >= 0 else len(content)
    at = content.find(b"\x1f\x8b\x08", at + 1)
    while at >= 0 and not _begins(view, at):
        at = content.find(b"\x1f\x8b\x08", at + 1)
    return at if at >= 0 else len(content)


def records_of(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(offset, length, digest) of the records of an archive, in one pass. A damaged record is one up to the next that can be told, with the digest of its bytes as they are."""
    view, at = memoryview(content), 0
    zipped = content[:5] != b"WARC/" and b"\r\n\r\nWARC/" not in content
    while at < len(content):
        if zipped:
            found = _gzip_member(view, at)
        else:
            found, end = None, content.find(b"\r\n\r\n", at) if content[at : at + 5] == b"WARC/" else -1
            fields = dict(x.split(b":", 1) for x in content[at:end].split(b"\r\n")[1:] if b":" in x) if end >= 0 else {}
            said = next((v.strip() for k, v in fields.items() if k.strip().lower() == b"content-length"), b"")
            if said.isdigit() and (stop := end + 4 + int(said) + 4) <= len(content) and content[stop - 4 : stop] == b"\r\n\r\n":
                found = stop - at, hashlib.sha256(view[at:stop]).hexdigest()
        if not found:
            stop = _next(content, view, at, zipped)
            found = stop - at, hashlib.sha256(view[at:stop]).hexdigest()
        yield at, *found
        at += found[0]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = list(records_of(content.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain, or one gzip member a record; digests are of the inflated bytes).

    A record that is damaged, by flipped bits, a false length or the file's early end, is one row up to the next record that can
    be told from its first bytes, with the digest of the bytes as they are: an audit finds it there. Each archive is one task's
    row, so archives are of less than 2 GB, and a task takes an archive's size twice.
    """
    return map_arrow(spark.read.format("binaryFile").load(path).select("path", "content"), _parsed, "archive string, offset long, length long, sha256 string")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from leaves to roots, each (archive, level, node, hash); the root of an archive is its node 0 of the last level."""
    rows = records.select(*RECORD).distinct().withColumn("node", F.floor(F.col("offset") / RANGE))
    line = F.struct("offset", F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce("sha256", F.lit(""))).alias("line"))
    digest = lambda c, field: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x[field]), ",").cast("binary"), 256)
    levels = [materialise(rows.groupBy("archive", "node").agg(digest(line, "line").alias("hash")), "leaves")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last > 0:
        child = F.struct("node", F.concat_ws("=", F.col("node").cast("string"), F.col("hash")).alias("line"))
        up = levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).alias("parent")).agg(digest(child, "line").alias("hash"))
        levels.append(up.select("archive", F.col("parent").alias("node"), "hash"))
        last //= FANOUT
    return levels


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(archive, node) of the leaves that differ, found from the roots down."""
    height = max(len(a), len(b))

    def grown(levels: list[DataFrame]) -> list[DataFrame]:
        while len(levels) < height:
            child = F.struct("node", F.concat_ws("=", F.col("node").cast("string"), F.col("hash")).alias("line"))
            up = levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).alias("parent")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["line"]), ",").cast("binary"), 256).alias("hash"))
            levels = [*levels, up.select("archive", F.col("parent").alias("node"), "hash")]
        return levels

    a, b, open_nodes = grown(a), grown(b), None
    for x, y in zip(reversed(a), reversed(b)):
        if open_nodes is not None:
            parents = open_nodes.select(F.col("archive"), F.col("node").alias("parent"))
            below = lambda t: t.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(parents, ["archive", "parent"], "left_semi").drop("parent")  # noqa: E731, B023
            x, y = below(x), below(y)
        both = x.withColumnRenamed("hash", "h1").join(y.withColumnRenamed("hash", "h2"), ["archive", "node"], "full")
        open_nodes = materialise(both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select("archive", "node"), "differing")
        if is_empty(open_nodes):
            break
    return open_nodes


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records at which two replicas differ: archive, offset, status, with the first's length and sha256 (the second's for extra ones).

    status: corrupt (both have a record there, of other length or digest), missing (only the first has it), extra (only the
    second). Repeated rows count once; rows of NULL archive or offset are left out; NULL digests differ from all others. Equal
    replicas, and two empty ones, give no rows; further columns are ignored.
    """
    a, b = (x.select(*RECORD).filter("archive IS NOT NULL AND offset IS NOT NULL").distinct() for x in (first, second))
    leaves = differing(tree(a), tree(b))
    inside = lambda t: t.withColumn("node", F.floor(F.col("offset") / RANGE)).join(leaves, ["archive", "node"], "left_semi").drop("node")
    x, y = inside(a).alias("x"), inside(b).alias("y")
    both = x.join(y, ["archive", "offset"], "full").filter(~(F.col("x.length").eqNullSafe(F.col("y.length")) & (F.col("x.sha256") == F.col("y.sha256"))) | F.col("x.length").isNull() | F.col("y.length").isNull())
    status = F.when(F.col("y.length").isNull(), "missing").when(F.col("x.length").isNull(), "extra").otherwise("corrupt")
    return both.select("archive", "offset", status.alias("status"), F.coalesce("x.length", "y.length").alias("length"), F.coalesce("x.sha256", "y.sha256").alias("sha256"))


def drill(spark, sf_dir: str) -> DataFrame:
    """The pages as archives, and a second replica in which some records' first character is replaced and some are lost (by the first two digits of the id's md5: ALTERED, LOST); one row per record with what the audit says of it."""
    damaged = F.sha2(F.concat(F.lit("?"), F.expr("substring(record, 2)")).cast("binary"), 256)
    records = page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"), extra={"other_sha256": damaged})
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    both = materialise(records.withColumns({"copy_sha256": F.when(mark.isin(*ALTERED), F.col("other_sha256")).otherwise(F.col("sha256")), "lost": mark.isin(*LOST)}).drop("other_sha256"), "records")
    replica = both.filter("NOT lost").select("archive", "offset", "length", F.col("copy_sha256").alias("sha256"))
    found = audit(both, replica).select("archive", "offset", "status")
    return both.join(found, ["archive", "offset"], "left").select("page_id", "archive", "offset", "length", "sha256", F.coalesce("status", F.lit("intact")).alias("status"))


def query(spark, sf_dir: str) -> DataFrame:
    return drill(spark, sf_dir)


SQL = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', coalesce(page_id::varchar, ''), '>', chr(13), chr(10),
    'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, ''))::varchar, chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages
), d AS (SELECT page_id, coalesce(floor(page_id / 1000)::bigint, -1 - ('0x' || substr(sha256(record), 1, 3))::bigint) AS archive, url, strlen(record)::bigint AS length, sha256(record) AS sha256, substr(md5(coalesce(page_id::varchar, '')), 1, 2) AS mark FROM r)
SELECT page_id, archive, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, url, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset", length, sha256,
  CASE WHEN mark IN {LOST} THEN 'missing' WHEN mark IN {ALTERED} THEN 'corrupt' ELSE 'intact' END AS status
FROM d
"""
