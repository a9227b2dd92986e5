"""Experiment matrix, result log, cache, replay: relational state of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.metrics import count_if
from plumbline.operators.ranking import last_wins, round_robin

#: The classes with the family of generators each takes, and the retrievers.
CLASSES = (("naive", "standard"), ("reasoning", "reasoning"), ("agentic", "reasoning"))
RETRIEVERS = ("bm25", "dpr")


def config_id() -> Column:
    return F.concat_ws("|", "pipeline_class", "retriever", "generator_key")


def matrix(spark: SparkSession, classes: Sequence[tuple[str, str]] = CLASSES, retrievers: Sequence[str] = RETRIEVERS, generators: int = 2) -> DataFrame:
    """All configurations in the order class, retriever, generator: config_no, config_id and its parts."""
    rows = [(c, r, f"{g}_{k}") for c, g in classes for r in retrievers for k in range(1, generators + 1)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "config_no int, pipeline_class string, retriever string, generator_key string")
    return df.withColumn("config_id", config_id())


def coverage(configs: DataFrame, rows: DataFrame) -> DataFrame:
    """The configurations with how many rows, and how many cases, a log or a scored table has of each."""
    there = rows.groupBy("config_id").agg(F.count("*").alias("n_scored"), F.count_distinct("case_id").alias("n_cases"))
    return configs.join(there, "config_id", "left").na.fill(0, ["n_scored", "n_cases"])


def pending(cases: DataFrame, configs: DataFrame, done: DataFrame) -> DataFrame:
    """Every case under every configuration but for keys already done. The configurations are a handful and are broadcast."""
    work = cases.crossJoin(F.broadcast(configs)).withColumn("key", F.concat(F.col("config_id"), F.lit("::"), F.col("case_id")))
    return work.join(done.select("key").distinct(), "key", "left_anti")


def interleaved(work: DataFrame) -> DataFrame:
    """Adds turn and stream: generators in turn, and within a generator its configurations and cases in order."""
    first = work.groupBy("generator_key").agg(F.min("config_no").alias("first"))
    streams = first.withColumn("stream", F.row_number().over(Window.orderBy("first")) - 1)  # a row per generator
    rows = work.join(F.broadcast(streams.drop("first")), "generator_key").withColumn("own", F.struct("case_id", "config_no"))
    return round_robin(rows, "stream", "own").drop("own")


def plan(work: DataFrame) -> DataFrame:
    return work.groupBy("generator_key").agg(F.count("*").alias("pending"), F.count_distinct("case_id").alias("cases"), F.count_distinct("config_id").alias("configs"))


def log_state(log: DataFrame) -> DataFrame:
    """Last row of each key, with done and failed: a later success supersedes an error and the reverse; an empty error is none."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return last_wins(log.filter("key IS NOT NULL"), ["key"], "line_no").withColumn("failed", failed).withColumn("done", ~F.col("failed"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries and tokens per model and in all (model NULL)."""
    return cache.groupingSets([["model"], []], "model").agg(F.count("*").alias("n"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


def lookup(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their cached values; hit tells which were found."""
    return requests.join(cache.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def replayed(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """As lookup, but a miss is an error when it is read."""
    found = lookup(requests, cache, key)
    return found.withColumn(key, F.when(F.col("hit"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not in the cache: "), F.col(key))).cast("string"))).drop("hit")


def sibling_arms(results: DataFrame, ids: str = "passage_ids") -> DataFrame:
    """Each result beside that of the other retriever: shared is whether both saw the same passages in the same order, NULL without a sibling."""
    other = F.when(F.col("retriever") == "bm25", "dpr").otherwise("bm25")
    key = ["case_id", "pipeline_class", "generator_key", "retriever"]
    twin = results.select("case_id", "pipeline_class", "generator_key", other.alias("retriever"), F.col(ids).alias("other_ids"))
    return results.join(twin, key, "left").withColumn("shared", F.col(ids) == F.col("other_ids")).drop("other_ids")


def provenance(results: DataFrame, index: DataFrame, text: str = "raw_text") -> DataFrame:
    """Results whose text's SHA-1 is in the index of their generator (generator_key, sha1)."""
    return results.withColumn("sha1", F.sha1(F.col(text).cast("binary"))).join(index, ["generator_key", "sha1"], "left_semi")


def stale_reviews(reviewed: Sequence[DataFrame], cases: DataFrame, discarded: DataFrame) -> DataFrame:
    """Distinct reviewed case ids that are neither in the benchmark nor discarded."""
    out = reviewed[0].select("case_id")
    for r in reviewed[1:]:
        out = out.union(r.select("case_id"))
    return out.distinct().join(cases.select("case_id"), "case_id", "left_anti").join(discarded.select("case_id"), "case_id", "left_anti")


def review_failures(sheets: DataFrame, question: str = "question") -> DataFrame:
    """Cases with a "no": their distinct reasons `question [note]` in the order of line_no."""
    no = sheets.filter(F.lower(F.trim("answer")) == "no")
    reason = F.when(F.trim(F.coalesce("notes", F.lit(""))) != "", F.concat(F.col(question), F.lit(" ["), F.trim("notes"), F.lit("]"))).otherwise(F.col(question))
    first = no.groupBy("case_id", reason.alias("reason")).agg(F.min("line_no").alias("line"))
    return first.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "reason"))), lambda x: x["reason"]).alias("reasons"))


def seed_overlap(cases: DataFrame) -> DataFrame:
    """Shared seeds of each two dimensions, 0 included."""
    seeds = cases.select("dimension", "seed_id").distinct()
    kinds = seeds.select("dimension").distinct()
    pairs = kinds.select(F.col("dimension").alias("a")).join(kinds.select(F.col("dimension").alias("b")), F.col("a") < F.col("b"))  # pairs of dimensions
    both = seeds.select(F.col("dimension").alias("a"), "seed_id").join(seeds.select(F.col("dimension").alias("b"), "seed_id"), "seed_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(by, names of shares): the value at rank ceil(share * n) of each group's values that aren't NULL, exactly; NULL for groups without one.

    An approximate percentile brackets the rank within n / accuracy on both sides. What lies below is counted, and only distinct
    values of the bracket, with their numbers, are put in order: no task holds a group.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    ends = [e for p in shares.values() for e in (max(p - 3 / accuracy, 0.0), min(p + 3 / accuracy, 1.0))]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy)).alias("cuts"))
    told = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.lit(p) * F.col("n")).alias("rank"), F.get("cuts", F.lit(2 * i)).alias("low"), F.get("cuts", F.lit(2 * i + 1)).alias("high")) for i, (name, p) in enumerate(shares.items())])
    brackets = found.select(*by, F.inline(told))
    met = rows.join(F.broadcast(brackets), list(by)) if by else rows.crossJoin(F.broadcast(brackets))  # a row per group and share
    key = [*by, "name"]
    counts = met.groupBy(*key, "rank", F.when(F.col("v").between(F.col("low"), F.col("high")), F.col("v")).alias("inside"), (F.col("v") < F.col("low")).alias("below")).agg(F.count("*").alias("c"))
    under = counts.filter("below").select(*key, F.col("c").alias("under"))
    w = Window.partitionBy(*key).orderBy("inside")
    upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("under", F.lit(0))
    inside = counts.filter("inside IS NOT NULL").join(under, key, "left").withColumn("upto", upto).filter(F.col("upto") >= F.col("rank"))
    out = inside.groupBy(*key).agg(F.min("inside").alias("v"))
    return out.groupBy(*by).pivot("name", list(shares)).agg(F.first("v"))


def arm_stats(samples: DataFrame) -> DataFrame:
    """Per arm: ok, failed, mean tokens of successes, nearest-rank p50 and p95 of their latency (0 without successes)."""
    ok = F.col("ok")
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    ranks = nearest_rank(samples.filter(ok), ["arm"], "latency_s", {"p50": 0.5, "p95": 0.95})
    out = samples.groupBy("arm").agg(count_if(ok).alias("n_ok"), count_if(~ok).alias("n_failed"), mean("prompt_tokens").alias("mean_prompt"), mean("completion_tokens").alias("mean_completion"))
    return out.join(ranks, "arm", "left").withColumns({p: F.coalesce(p, F.lit(0.0)) for p in ("p50", "p95")})


def projection(samples: DataFrame, *, wall_clock_s: float, total_calls: int, gpu_hourly_usd: float, budget_hours: float) -> DataFrame:
    """One row: rate of successes over wall-clock time, hours and cost of the whole run, and how that stands to the budget (0.5, 0.8 and 1.5 of it). NULL metrics without a success."""
    if min(wall_clock_s, total_calls, budget_hours) <= 0:
        raise ValueError("wall clock, calls and budget must be positive")
    out = samples.agg(count_if(F.col("ok")).alias("n_ok"), count_if(~F.col("ok")).alias("n_failed"))
    out = out.withColumn("observed_rps", F.when(F.col("n_ok") > 0, F.col("n_ok") / wall_clock_s))
    out = out.withColumn("projected_hours", total_calls / F.col("observed_rps") / 3600.0).withColumn("projected_usd", F.col("projected_hours") * gpu_hourly_usd)
    h = F.col("projected_hours") / budget_hours
    return out.withColumn("verdict", F.when(h <= 0.5, "comfortable").when(h <= 0.8, "fits").when(h <= 1.5, "tight").when(h.isNotNull(), "does not fit"))
