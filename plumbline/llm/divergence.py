"""How far the sources of a language lie apart in their words: distances of smoothed term frequencies, by inclusion and exclusion.

Every group, a source of a language, gives each of the language's V terms a price, p = 1 + floor(unit * (count + a) / (N + a * V)), and
a term it lacks its constant, z. The distance of two groups is the sum over all V terms of the difference of
prices, but no group is ever spelt out over V terms:

* what one of them has costs |p - z of the other|: a histogram of a group's prices, sorted with the constants of all other
  groups, prices all of these at once by running sums;
* what both have was counted twice and is corrected: their postings are joined by term;
* what neither has costs |z - z|, times the number of such terms by inclusion and exclusion.

So the work is in proportion to postings, to the overlaps of sources, and to the pairs of sources that are asked for. Terms are
counted by workers over whole UTF-8 buffers: 64-bit hashes find a block's equal terms, whose bytes are then compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import Scratch, map_arrow
from plumbline.llm.textbytes import LOWER, buffers, hash_spans, mix, runs_of, slices

MIN_DOCS, SMOOTHING, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text in which equal terms are counted together before they leave a worker.
TEXT_BYTES = 4 << 20
#: Sources of a language that one task pairs with all others.
SOURCES_PER_TASK = 256
#: Bytes of terms: letters A to Z in either case, and all of what lies beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _same(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> bool:
    """Whether each span holds the same bytes as the span at its head."""
    return bool((sizes == sizes[heads]).all()) and bool((low[_flat(starts, sizes)] == low[_flat(starts[heads], sizes)]).all())


def counted(text: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, texts) of each distinct term of each group."""
    data, offsets = buffers(text)
    low = LOWER[data]
    starts, ends, rows = runs_of(TERM[data], offsets)
    if not len(starts):
        return np.zeros(0, group.dtype), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = mix(hash_spans(data, starts, ends) + mix(group.astype(np.uint64) + np.uint64(1))[rows])
    order = np.argsort(key, kind="stable")
    key, starts, sizes, rows = key[order], starts[order], (ends - starts)[order], rows[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    head = first[np.cumsum(new) - 1]
    if not (group[rows] == group[rows[head]]).all() or not _same(low, starts, sizes, head):
        return _counted_one_by_one(low, starts, sizes, rows, group)
    document = new.copy()
    document[1:] |= rows[1:] != rows[:-1]
    n, texts = np.diff(np.append(first, len(key))), np.add.reduceat(document.astype(np.int64), first)
    at = np.concatenate(([0], np.cumsum(sizes[first]))).astype(np.int64)
    term = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(low[_flat(starts[first], sizes[first])]))
    return group[rows[first]], term.cast(pa.string()), n, texts


def _counted_one_by_one(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """As counted, for a block in which two terms share a hash."""
    held = low.tobytes()
    of = Counter((int(r), held[s : s + m].decode()) for s, m, r in zip(starts.tolist(), sizes.tolist(), rows.tolist()))
    n, texts = Counter(), Counter()
    for (r, term), times in of.items():
        n[int(group[r]), term] += times
        texts[int(group[r]), term] += 1
    keys = list(n)
    return np.array([g for g, _ in keys], group.dtype), pa.array([t for _, t in keys], pa.string()), np.array([n[k] for k in keys]), np.array([texts[k] for k in keys])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each block of texts; each group also has a row of the empty term, which no text holds."""
    for batch in batches:
        for run in slices(batch, "text", TEXT_BYTES):
            names = pa.StructArray.from_arrays([run.column("lang"), run.column("source")], ["lang", "source"])
            place: dict[tuple, int] = {}
            group = np.array([place.setdefault((x["lang"], x["source"]), len(place)) for x in names.to_pylist()], np.int64)
            of, term, n, docs = counted(run.column("text"), group)
            lang, source = (pa.array(c, pa.string()) for c in zip(*place))
            every = np.concatenate((of, np.arange(len(place))))
            none = np.zeros(len(place), np.int64)
            terms = pa.concat_arrays([term, pa.array([""] * len(place), pa.string())])
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(every)), source.take(pa.array(every)), terms, pa.array(np.concatenate((n, none))), pa.array(np.concatenate((docs, none)))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and texts of each term of each group, and a row of the empty term for each group."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    blocks = map_arrow(rows, _term_counts, "lang string, source string, term string, n long, docs long")
    return blocks.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _one_sided(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value): the sum over the source's terms of |p - z of the other|, and once for each pair the terms that neither has, both as if no term were shared."""
    parts = max(1, -(-(groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // SOURCES_PER_TASK))
    left = groups.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int"))
    right = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("price"), F.col("terms").alias("other_terms"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    pairs = left.join(right, ["lang", "part"]).filter("source <> other")
    neither = F.when(F.col("source") < F.col("other"), (F.col("v") - F.col("terms") - F.col("other_terms")) * F.abs(F.col("z") - F.col("price"))).otherwise(0)
    asked = pairs.select("lang", "source", "other", "price", F.lit(0).cast("long").alias("h"), neither.alias("neither"))
    none = F.lit(None)
    have = priced.groupBy("lang", "source", F.col("p").alias("price")).agg(F.count(F.lit(1)).alias("h")).select("lang", "source", none.cast("string").alias("other"), "price", "h", none.cast("long").alias("neither"))
    order = Window.partitionBy("lang", "source").orderBy("price", "other")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    worth = F.col("h") * F.col("price")
    sums = have.unionByName(asked).select("*", F.sum("h").over(whole).alias("all_h"), F.sum(worth).over(whole).alias("all_p"), F.sum("h").over(below).alias("low_h"), F.sum(worth).over(below).alias("low_p"))
    value = F.expr("all_p - 2 * low_p - price * (all_h - 2 * low_h) + neither")
    return sums.filter(F.col("other").isNotNull()).select("lang", "source", "other", value.alias("value"))


def _overlaps(priced: DataFrame) -> DataFrame:
    """(lang, source, other, value) with source before other: what a term of both adds to what it costs as a term of one, of the other, and of neither."""
    a = priced.select("lang", "term", "source", "p", "z")
    b = priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("z").alias("other_z"))
    value = F.expr("abs(p - other_p) - abs(p - other_z) - abs(other_p - z) + abs(z - other_z)")
    return a.join(b, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other").agg(F.sum(value).alias("value"))


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, unit: int = UNIT, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: the distance of a source to each other one of its language, farthest first. Part `term`: the `top` terms that it has and that have a higher price in it than in the language.

    NULL texts, languages and sources count as empty ones, which are a language and a source like others. Terms are runs of
    letters A to Z, lower-cased, and of all characters beyond ASCII; a language keeps those of at least min_docs of its rows.
    Every row is a document, ids don't matter. A source without terms has all constants; a language without terms has
    distances of 0 and no terms; a language of one source has no pairs. Ties are ordered by the UTF-8 bytes of the item. An empty table gives
    an empty result. Further columns are ignored. A text beyond TEXT_BYTES is handled alone and takes some 30 times its size.
    """
    store = Scratch()
    counts = store(term_counts(docs, text_col, lang_col, source_col), "counts")
    vocabulary = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    postings = store(counts.join(vocabulary, ["lang", "term"]).select("lang", "term", "source", "n", "lang_n"), "postings")
    price = lambda n, total: F.expr(f"1 + (CAST({unit} AS DECIMAL(10,0)) * ({n} + {smoothing})) div ({total} + {smoothing} * v)")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = counts.filter("term = ''").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total", "terms"])
    groups = groups.withColumn("z", F.when(F.col("v") > 0, price("0", "total")).otherwise(0))
    groups = store(groups.coalesce(1), "groups")
    priced = postings.join(groups.drop("terms"), ["lang", "source"]).select("lang", "term", "source", price("n", "total").alias("p"), "z", price("lang_n", "lang_total").alias("q"))
    priced = store(priced, "priced")
    once = _one_sided(priced, groups).select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), "value")
    apart = once.unionByName(_overlaps(priced)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = apart.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
words AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
vocabulary AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
every AS (
    SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.lang_n
    FROM (SELECT DISTINCT lang, source FROM d) g JOIN vocabulary v ON v.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
priced AS MATERIALIZED (
    SELECT lang, source, term, n,
        1 + CAST({UNIT} AS HUGEINT) * (n + {SMOOTHING}) // (sum(n) OVER g + {SMOOTHING} * count(*) OVER g) AS p,
        1 + CAST({UNIT} AS HUGEINT) * (lang_n + {SMOOTHING}) // (sum(lang_n) OVER g + {SMOOTHING} * count(*) OVER g) AS q
    FROM every WINDOW g AS (PARTITION BY lang, source)),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
    FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
found AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP}
"""
