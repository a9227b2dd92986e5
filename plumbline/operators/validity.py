"""Where other judgements and generated text may mislead: coverage gaps of proxy metrics, and artefacts of generation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import grams
from plumbline.functions.text import alnum_tokens
from plumbline.operators.metrics import count_if
from plumbline.sources.scratch import written

#: Pass mark and discriminative margin of a proxy metric.
PASS, MARGIN = 0.5, 0.05
#: Characters of text whose n-grams' hashes meet in one task, and shared hashes that are sent to the workers.
RANGE_CHARS, SENT_HASHES = 64 << 20, 4 << 20
#: The bits of the filter of more hashes, and those of a piece of it that one task makes, as powers of two.
FILTER_BITS, PIECE_BITS = 30, 20
PROXIES = ("faithfulness", "answer_relevance", "context_relevance")


def failure() -> Column:
    """The purpose-built verdict of a scored row, NULL where there is none: in noise a NULL verdict is left out, unlike in accuracy."""
    answerable = ~F.coalesce("answer_correct", F.lit(False))
    return (
        F.when(F.col("dimension") == "refusal", F.when(F.col("is_answerable"), answerable).otherwise(F.col("category") != "refusal"))
        .when(F.col("dimension") == "conflict", F.col("crs_score") == 0).when(F.col("dimension") == "noise", ~F.col("answer_correct"))
    )


def unpivoted(rows: DataFrame, keep: Sequence[str], proxies: Sequence[str] = PROXIES) -> DataFrame:
    return rows.unpivot(list(keep), list(proxies), "metric", "score")


def coverage_gap(rows: DataFrame, by: Sequence[str] = ("metric", "dimension"), threshold: float = PASS) -> DataFrame:
    """rows (by..., score, failed): how often a failed response still gets the pass mark, with ratios over scored rows and NULL where undefined."""
    s, bad = F.col("score"), F.col("failed")
    out = rows.filter("failed IS NOT NULL").groupBy(*by).agg(
        F.count("*").alias("n_instances"), count_if(bad).alias("n_failures"), count_if(bad & (s >= threshold)).alias("n_missed"), count_if(bad & s.isNull()).alias("n_undefined"),
        count_if(~bad & (s >= threshold)).alias("n_successes_passing"), count_if(~bad & s.isNotNull()).alias("n_successes_scored"), F.avg(F.when(bad, s)).alias("mean_on_failures"), F.avg(F.when(~bad, s)).alias("mean_on_successes"),
    )
    out = out.withColumns({
        "miss_rate": F.try_divide(F.col("n_missed"), F.col("n_failures") - F.col("n_undefined")),
        "pass_rate_on_successes": F.try_divide(F.col("n_successes_passing"), F.col("n_successes_scored")),
        "separation": F.col("mean_on_successes") - F.col("mean_on_failures"),
    })
    return out.withColumn("discriminative", F.coalesce(F.col("separation") >= MARGIN, F.lit(False)))


def definedness(rows: DataFrame, by: Sequence[str] = ("metric", "dimension")) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("score").alias("n_defined"), (F.count("score") / F.count("*")).alias("share"), F.avg("score").alias("mean"))


def ratio_of(hits: Column, n: Column) -> Column:
    """Share of hits, NULL for an empty denominator."""
    return F.try_divide(hits.cast("double"), n)


def document_ngrams(docs: DataFrame, n: int, text: str = "text", least: int = 2) -> DataFrame:
    """(gram, documents): n-grams of at least `least` documents, each counted once a document.

    Hardly any n-gram is in two documents. Workers count the hashes of their texts' n-grams; arrays of hashes and counts meet by
    ranges of hashes, so a row is shuffled for each task and range and 12 bytes for each n-gram of a task. What enough
    documents have (or share by chance) is spelt out and counted as text; each task adds up its own before they are shuffled. The hashes are sent to the workers, if they are at most SENT_HASHES,
    and else as a filter of 1 << FILTER_BITS bits: what it lets through beside them is counted, and left out by its count.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    texts = docs.select(F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    ranges = -(-(texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 1) // RANGE_CHARS)
    parts = texts.mapInArrow(lambda batches: grams.counted(batches, n, ranges), "range int, hashes binary, counts binary")
    parts = parts.repartition(ranges, "range").sortWithinPartitions("range")
    hashes = written(parts.mapInArrow(lambda batches: grams.frequent(batches, least), "h long"), "shared-hashes")
    if hashes.count() <= SENT_HASHES:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(hashes.toPandas()["h"].to_numpy(np.int64).view(np.uint64)))
        rows = texts.mapInArrow(lambda batches: grams.spelt(batches, n, wanted.value), "gram string")
    else:
        piece = F.shiftrightunsigned("h", 64 - FILTER_BITS + PIECE_BITS)
        bits = np.zeros((1 << (FILTER_BITS - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8)
        for r in hashes.repartition(piece).mapInArrow(lambda batches: grams.marked(batches, FILTER_BITS, PIECE_BITS), "piece long, marks binary").toLocalIterator():  # as many bits in all as the filter has
            bits[r["piece"]] = np.frombuffer(bytes(r["marks"]), np.uint8)
        sent = docs.sparkSession.sparkContext.broadcast(bits.ravel())
        rows = texts.mapInArrow(lambda batches: grams.spelt_marked(batches, n, sent.value, FILTER_BITS), "gram string")
    return rows.groupBy("gram").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least)


def n_shared_ngrams(docs: DataFrame, n: int, text: str = "text", least: int = 2) -> DataFrame:
    """One row, one number: how many n-grams `document_ngrams` has.

    None is spelt out: n-grams meet by ranges of 64 bits of a hash with 32 bits of another, by which two of a billion collide with
    probability 1e-11. So work and shuffle grow with the texts, however many n-grams they share.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    texts = docs.select(F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    ranges = -(-(texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 1) // RANGE_CHARS)
    parts = texts.mapInArrow(lambda batches: grams.checked(batches, n, ranges), "range int, hashes binary, checks binary, counts binary")
    parts = parts.repartition(ranges, "range").sortWithinPartitions("range")
    return parts.mapInArrow(lambda batches: grams.shared(batches, least), "n long").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(alnum_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def over_represented(generated: DataFrame, original: DataFrame, least: int = 5, k: int = 25) -> DataFrame:
    """The k tokens of generated text whose rate most exceeds that in the originals (kind over), and the k most frequent that the originals lack (kind only); ties by token."""
    g, o = token_counts(generated), token_counts(original).withColumnRenamed("n", "n_original")
    totals = g.agg(F.sum("n").alias("g_total")).crossJoin(o.agg(F.sum("n_original").alias("o_total")))  # one row
    rows = g.filter(F.col("n") >= least).join(o, "token", "left").crossJoin(F.broadcast(totals))
    rows = rows.withColumn("rate_ratio", (F.col("n") / F.col("g_total")) / (F.col("n_original") / F.col("o_total")))
    over = rows.filter("rate_ratio > 1").orderBy(F.col("rate_ratio").desc(), "token").limit(k).select(F.lit("over").alias("kind"), "token", "n", "rate_ratio")
    only = rows.filter("n_original IS NULL").orderBy(F.col("n").desc(), "token").limit(k).select(F.lit("only").alias("kind"), "token", "n", "rate_ratio")
    return over.unionByName(only)


def generated_only_share(generated: DataFrame, original: DataFrame, least: int = 2, doc: str = "doc_id") -> DataFrame:
    """(token, documents, share) of tokens that no original has and at least `least` generated documents do."""
    own = generated.select(F.explode(F.array_distinct(alnum_tokens(F.col("text")))).alias("token"))
    fresh = own.groupBy("token").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least).join(token_counts(original).select("token"), "token", "left_anti")
    return fresh.crossJoin(F.broadcast(generated.agg(F.count("*").alias("all_documents")))).select("token", "documents", (F.col("documents") / F.col("all_documents")).alias("share"))  # one row


def length_ratio(pairs: DataFrame) -> DataFrame:
    """Mean and extreme ratio of generated to original tokens; 1 where the original has none."""
    g, o = F.size(alnum_tokens(F.col("generated"))), F.size(alnum_tokens(F.col("original")))
    r = F.when(o == 0, F.lit(1.0)).otherwise(g / o)
    return pairs.agg(F.count("*").alias("n"), F.avg(r).alias("mean_ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"))


def conflict_pairs(cases: DataFrame) -> DataFrame:
    """(case_id, original, generated) of conflict cases: the passage that gen_params names as contradicted, and the one whose id is that with -contra; NULLs where a case has no such pair, so that it can be counted as skipped."""
    of = lambda pid: F.get(F.filter("passages", lambda p: p["passage_id"] == pid), F.lit(0))["text"]
    original = F.try_element_at("gen_params", F.lit("contradicted_passage_id"))
    rows = cases.select("case_id", of(original).alias("o"), of(F.concat(original, F.lit("-contra"))).alias("g"))
    both = F.col("o").isNotNull() & F.col("g").isNotNull()
    return rows.select("case_id", F.when(both, F.col("o")).alias("original"), F.when(both, F.col("g")).alias("generated"))


def artefact_report(pairs: DataFrame, sizes: Sequence[int] = (4, 5, 6, 7, 8), *, rewritten: float = 0.5, template_share: float = 0.25, excess: float = 2.0) -> DataFrame:
    """One row over pairs (case_id, original, generated): n_pairs, mean, median and greatest edit fraction, pairs over half rewritten, mean length ratio, greatest document share of a token that no original has, shared n-grams of both sides by size, flags and verdict.

    A flag is raised by a token in more than template_share of the generated texts, by a mean edit fraction above rewritten, and
    for each size at which generated texts share more than excess times as many n-grams as the originals, if these share any.
    No pairs give no row.
    """
    from plumbline.functions.python_udfs import edit_fraction

    own, made = pairs.select(F.col("case_id").alias("doc_id"), F.col("original").alias("text")), pairs.select(F.col("case_id").alias("doc_id"), F.col("generated").alias("text"))
    fraction = pairs.select(edit_fraction("original", "generated").alias("f"))
    out = fraction.agg(F.count("*").alias("n_pairs"), F.avg("f").alias("mean_edit"), F.percentile("f", F.lit(0.5)).alias("median_edit"), F.max("f").alias("max_edit"), count_if(F.col("f") > rewritten).alias("n_rewritten")).filter("n_pairs > 0")
    out = out.crossJoin(length_ratio(pairs).select("mean_ratio")).crossJoin(generated_only_share(made, own).agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("max_share")))  # one row each
    excessive = {}
    for n in sizes:
        a, b = (n_shared_ngrams(t, n).toDF(c) for t, c in ((made, f"generated_{n}"), (own, f"original_{n}")))
        out = out.crossJoin(a).crossJoin(b)  # one row each
        excessive[n] = F.col(f"generated_{n}") > excess * F.col(f"original_{n}")
    flags = [F.when(F.col("max_share") > template_share, "a token of no original is in many generated texts"), F.when(F.col("mean_edit") > rewritten, "rewritten as a whole")]
    flags += [F.when((F.col(f"original_{n}") > 0) & more, f"{n}-grams shared across cases") for n, more in excessive.items()]
    out = out.withColumn("flags", F.filter(F.array(*flags), lambda x: x.isNotNull()))
    return out.withColumn("verdict", F.when(F.size("flags") == 0, "no artefact by these measures").otherwise("possible artefact"))


def ledger(rows: DataFrame, artefacts: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """(id, verdict, actual) of ledger rows (id, stated, artefact, path) against artefacts (artefact, document): no artefact, no value, differs or holds.

    path is dotted, places in lists being numbers. Numbers hold if they differ by less than the tolerance, texts if they are equal.
    """
    known = artefacts.select("artefact", "document", F.lit(True).alias("there"))
    step = lambda x: F.when(F.rlike(x, F.lit(r"^\d+$")), F.concat(F.lit("["), x, F.lit("]"))).otherwise(F.concat(F.lit("['"), x, F.lit("']")))
    at = F.concat(F.lit("$"), F.array_join(F.transform(F.split("path", r"\."), step), ""))
    out = rows.join(known, "artefact", "left").withColumn("actual", F.call_function("get_json_object", F.col("document"), at))
    near = F.abs(F.col("actual").try_cast("double") - F.col("stated").try_cast("double")) < tolerance
    verdict = F.when(F.col("there").isNull(), "no artefact").when(F.col("actual").isNull(), "no value").when((F.col("actual") == F.col("stated")) | F.coalesce(near, F.lit(False)), "holds").otherwise("differs")
    return out.select("id", verdict.alias("verdict"), "actual")
