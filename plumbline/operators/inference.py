"""Percentile bootstrap by sufficient statistics.

Every statistic here is a function of sums over units (cases or seeds). A resample is then a weighting of units, and of units
with equal sums together. Draw j of resample b of a group picks the unit at a place that a hash of seed, group, b and j
gives, units being in order of their sums, however many there are. Draws depend on nothing but their key, so results are the same for any partitioning, and
paired arms share their draws. Workers draw in parallel by group and resample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import NOISE_GRID, count_if, f1, non_terminating, ratio
from plumbline.operators.ranking import running
from plumbline.sources.scratch import written

#: Resamples, confidence, seed, and differences that count as practical.
RESAMPLES, CONFIDENCE, SEED = 1000, 0.95, 20260721
#: Units up to which `weights` makes draws one by one. Queries don't use it: all their draws are made one by one.
LEAF = 4096
#: Kinds of units in a block, parts that the resamples of a block are dealt over, and draws that are held at a time.
KINDS, CHUNKS, PIECE = 1 << 19, 16, 1 << 20
PRACTICAL = {"refusal_f1": 0.05, "crs": 0.25, "ndc_auc": 0.05}


def _refusal(rows: DataFrame, key: list[str]) -> DataFrame:
    refused, ok = F.col("category") == "refusal", F.col("is_answerable")
    return rows.filter("dimension = 'refusal'").groupBy(*key, F.col("case_id").alias("unit")).agg(count_if(~ok & refused).alias("s0"), count_if(ok & refused).alias("s1"), count_if(~ok & ~refused).alias("s2"), count_if(ok & ~refused).alias("s3"))


def _crs(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.filter("dimension = 'conflict' AND crs_score IS NOT NULL").groupBy(*key, F.col("case_id").alias("unit")).agg(F.sum("crs_score").alias("s0"), F.count("*").alias("s1"))


def _ndc(rows: DataFrame, key: list[str]) -> DataFrame:
    at = lambda r: F.col("noise_ratio") == r
    hit = F.coalesce("answer_correct", F.lit(False))
    rows = rows.filter("dimension = 'noise' AND noise_ratio IS NOT NULL").groupBy(*key, F.coalesce("seed_id", "case_id").alias("unit"))
    return rows.agg(*[count_if(at(r) & hit).alias(f"s{i}") for i, r in enumerate(NOISE_GRID)], *[count_if(at(r)).alias(f"s{i + 5}") for i, r in enumerate(NOISE_GRID)])


def _refusal_value() -> Column:
    tp, fp, fn, tn = (F.col(f"s{i}") for i in range(4))
    return F.when((tp + fn > 0) & (fp + tn > 0), f1(ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)))


def _ndc_value() -> Column:
    acc = [ratio(F.col(f"s{i}"), F.col(f"s{i + 5}")) for i in range(5)]
    area = F.lit(0.0)
    for i in range(4):
        area = area + F.lit(NOISE_GRID[i + 1] - NOISE_GRID[i]) * (acc[i] + acc[i + 1]) / 2
    return area / (NOISE_GRID[-1] - NOISE_GRID[0])


#: metric -> (sums by unit, number of sums, value of the sums). Further statistics need only an entry here.
STATISTICS = {
    "refusal_f1": (_refusal, 4, _refusal_value),
    "crs": (_crs, 2, lambda: ratio(F.col("s0"), F.col("s1"))),
    "ndc_auc": (_ndc, 10, _ndc_value),
}


def drawn(n: int, size: int, *key: object, first: int = 0) -> np.ndarray:
    """n draws from 0 to size - 1, from number `first` on, a multiple of four: four from each md5 of the key, without its NULLs, and a running number."""
    prefix = "|".join(str(x) for x in key if x is not None) + "|"
    digests = b"".join(hashlib.md5(f"{prefix}{q}".encode()).digest() for q in range(first // 4, -(-(first + n) // 4)))
    return np.frombuffer(digests, ">u4")[:n] % np.uint64(size)


def split(n: int, sizes: np.ndarray, *key: object) -> np.ndarray:
    """How many of n draws fall on each of several parts, by a chain of binomial draws that the key seeds: as many as parts, whatever n is."""
    digest = hashlib.md5("|".join(str(x) for x in key if x is not None).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest))).multinomial(n, sizes / sizes.sum())


def weights(n: int, m: np.ndarray, *key: object) -> np.ndarray:
    """How often each kind of m units is drawn in n draws: one by one from at most LEAF units, else by splitting n over the kinds."""
    size = int(m.sum())
    if size > LEAF:
        return split(n, m, *key)
    return np.bincount(np.searchsorted(np.cumsum(m), drawn(n, size, *key), "right"), minlength=len(m))


def times_drawn(starts: np.ndarray, stop: int, size: int, *key: object) -> np.ndarray:
    """How often each kind is drawn in `size` plain draws from as many places; kinds lie at successive places from starts, the last up to stop."""
    out = np.zeros(len(starts), np.int64)
    for first in range(0, size, PIECE):
        at = drawn(min(PIECE, size - first), size, *key, first=first).astype(np.int64)
        at = at[(at >= starts[0]) & (at < stop)]
        out += np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(starts))
    return out


def _resampled(stats: DataFrame, group: list[str], arms: list[str], metric: str, resamples: int, seed: int | str) -> tuple[DataFrame, DataFrame]:
    """(group, arms, observed) and (group, arms, b, value). A unit missing from an arm has no sums there.

    Units of equal sums are one kind: a resample needs only how often each kind is drawn. Draws are never rows: a task makes
    those of some resamples of a group, piece by piece, and counts them by kind. Of a group with more than KINDS kinds, successive ones are a block, and a
    task counts the draws that fall on its block, so none holds more than that.
    """
    _, k, value = STATISTICS[metric]
    spark = stats.sparkSession
    sums = [f"s{i}" for i in range(k)]
    observed = stats.groupBy(*group, *arms).agg(*[F.sum(c).alias(c) for c in sums]).select(*group, *arms, value().alias("observed"))
    sides = [tuple(r) for r in stats.select(*arms).distinct().orderBy(*arms).collect()] if arms else [()]  # a handful
    here = lambda side: reduce(lambda x, y: x & y, [F.col(c) == v for c, v in zip(arms, side)], F.lit(True))
    units = stats.groupBy(*group, "unit").agg(*[F.coalesce(F.sum(F.when(here(side), F.col(c))), F.lit(0)).alias(f"{c}_{i}") for i, side in enumerate(sides) for c in sums])
    wide = [c for c in units.columns if c not in (*group, "unit")]
    kinds = units.groupBy(*group, *wide).agg(F.count("*").alias("m")).withColumn("gid", F.to_json(F.struct(*group)) if group else F.lit("{}"))
    kinds = written(kinds, "kinds")  # read several times
    sizes = kinds.groupBy("gid").agg(F.sum("m").alias("size"), F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > KINDS:
        kinds = running(running(kinds, ["gid"], wide, F.col("m"), "start"), ["gid"], wide, F.lit(1), "nth").withColumn("block", F.floor(F.col("nth") / KINDS)).drop("nth")
    else:
        kinds = kinds.withColumns({"start": F.lit(0).cast("long"), "block": F.lit(0).cast("long")})
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in group])
    chunk = F.explode(F.sequence(F.lit(0), F.lit(min(CHUNKS, resamples) - 1))).alias("chunk")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(wide)
        m, held = own["m"].to_numpy(), own[wide].to_numpy(np.float64).reshape(len(own), len(sides), k)
        key, c, size = own["name"].iloc[0], int(own["chunk"].iloc[0]), int(own["size"].iloc[0])
        ends = own["start"].iloc[0] + np.cumsum(m)
        of = tuple(own[g].iloc[0] for g in group)
        rows = []
        for b in range(c, resamples, CHUNKS):
            weight = times_drawn(ends - m, int(ends[-1]), size, key, b)
            rows += [(*of, *side, b, *total) for side, total in zip(sides, np.tensordot(weight.astype(np.float64), held, 1).tolist())]
        return pd.DataFrame(rows, columns=[*group, *arms, "b", *sums])

    fields = [f"{c} {stats.schema[c].dataType.simpleString()}" for c in (*group, *arms)]
    at = ["gid", "block", "chunk"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, since small rows with much work mustn't be put together
    own = kinds.join(sizes.drop("n"), "gid").select("gid", *group, *wide, "m", "start", "size", name.alias("name"), "block", chunk).repartition(parts, *at)
    made = own.groupBy(*at).applyInPandas(run, ", ".join([*fields, "b long", *[f"{c} double" for c in sums]]))
    totals = made.groupBy(*group, *arms, "b").agg(*[F.sum(c).alias(c) for c in sums])
    return observed, totals.select(*group, *arms, "b", value().alias("value"))


def _interval(values: DataFrame, key: list[str], confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    return values.groupBy(*key).agg(F.percentile("value", F.lit(tail)).alias("lower"), F.percentile("value", F.lit(1 - tail)).alias("upper"), count_if(F.col("value").isNull()).alias("n_failed"))


def _excludes_zero() -> Column:
    return (F.col("lower") > 0) | (F.col("upper") < 0)


def intervals(scored: DataFrame, metric: str, by: Sequence[str], *, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED, exclude_non_terminating: bool = False) -> DataFrame:
    """Observed value and percentile interval of a metric per group; resamples at which it is undefined are counted and left out."""
    if exclude_non_terminating:
        scored = scored.filter(~non_terminating())
    group = list(by)
    observed, values = _resampled(STATISTICS[metric][0](scored, group), group, [], metric, resamples, seed)
    return observed.join(_interval(values, group, confidence), group).withColumn("excludes_zero", _excludes_zero())


def paired_differences(scored: DataFrame, metric: str, *, arm: str = "pipeline_class", resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """Difference of a metric between each two arms over the units that both have, both arms on the same draws."""
    stats = STATISTICS[metric][0](scored, [arm])
    names = stats.select(F.col(arm).alias("arm")).distinct()
    a, b = names.select(F.col("arm").alias("arm_a")), names.select(F.col("arm").alias("arm_b"))
    pairs = a.join(b, F.col("arm_a") < F.col("arm_b"))  # pairs of arms, of which there are few
    both = stats.select(F.col(arm).alias("arm_a"), "unit").join(F.broadcast(pairs), "arm_a").join(stats.select(F.col(arm).alias("arm_b"), "unit"), ["arm_b", "unit"])
    shared = both.select("arm_a", "arm_b", "unit")
    sums = [c for c in stats.columns if c not in (arm, "unit")]
    side = lambda s: shared.join(stats.withColumnRenamed(arm, f"arm_{s}"), [f"arm_{s}", "unit"]).select("arm_a", "arm_b", "unit", F.lit(s).alias("side"), *sums)
    observed, values = _resampled(side("a").unionByName(side("b")), ["arm_a", "arm_b"], ["side"], metric, resamples, seed)
    minus = lambda t, v, *k: t.groupBy("arm_a", "arm_b", *k).agg((F.max(F.when(F.col("side") == "a", F.col(v))) - F.max(F.when(F.col("side") == "b", F.col(v)))).alias(v))
    out = minus(observed, "observed").join(_interval(minus(values, "value", "b"), ["arm_a", "arm_b"], confidence), ["arm_a", "arm_b"])
    out = out.join(shared.groupBy("arm_a", "arm_b").agg(F.count("*").alias("n_units")), ["arm_a", "arm_b"])
    return _verdicts(out.withColumn("metric", F.lit(metric)), metric)


def _verdicts(out: DataFrame, metric: str) -> DataFrame:
    out = out.withColumn("significant", F.coalesce(_excludes_zero(), F.lit(False)))
    return out.withColumn("practical", F.col("significant") & (F.abs("observed") >= PRACTICAL[metric]))


def unpaired_differences(scored: DataFrame, metric: str, *, group: str, side: str, sides: tuple[str, str], resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """Difference of a metric between two disjoint sets of units within each group, each resampled at its own size with draws of its own; a unit in both is an error."""
    stats = STATISTICS[metric][0](scored.filter(F.col(side).isin(*sides)), [group, side])
    twice = stats.groupBy(group, "unit").agg(F.count_distinct(side).alias("k"))
    stats = stats.join(twice, [group, "unit"]).withColumn("unit", F.when(F.col("k") == 1, F.col("unit")).otherwise(F.raise_error(F.lit("a unit is in both groups")).cast("string"))).drop("k")
    observed, values = _resampled(stats, [group, side], [], metric, resamples, seed)
    minus = lambda t, v, *k: t.groupBy(group, *k).agg((F.max(F.when(F.col(side) == sides[0], F.col(v))) - F.max(F.when(F.col(side) == sides[1], F.col(v)))).alias(v))
    out = minus(observed, "observed").join(_interval(minus(values, "value", "b"), [group], confidence), group)
    return _verdicts(out.withColumn("metric", F.lit(metric)), metric)


def comparisons(scored: DataFrame, pairs: Sequence[tuple[str, str]] = (("reasoning", "naive"), ("agentic", "reasoning"), ("agentic", "naive")), **options) -> DataFrame:
    """A row (metric, arm_a, arm_b, observed a - b, lower, upper, significant, practical, n_units, n_failed, error) for every metric and pair of classes that both have rows of the metric's kind.

    Where a difference can't be told, error says why and the other columns are NULL: no shared units, or no value on all of
    them. Other comparisons aren't affected.
    """
    spark = scored.sparkSession
    wanted = spark.createDataFrame([(a, b, min(a, b), max(a, b)) for a, b in pairs], "arm_a string, arm_b string, low string, high string")  # a handful
    out = []
    for metric in STATISTICS:
        made = paired_differences(scored, metric, **options).withColumnsRenamed({"arm_a": "low", "arm_b": "high"})
        there = STATISTICS[metric][0](scored, ["pipeline_class"]).select("pipeline_class").distinct()
        both = wanted.join(there.withColumnRenamed("pipeline_class", "arm_a"), "arm_a").join(there.withColumnRenamed("pipeline_class", "arm_b"), "arm_b")
        rows = both.join(made.drop("metric"), ["low", "high"], "left")
        turned = F.col("arm_a") != F.col("low")
        minus = lambda c: F.when(turned, -F.col(c)).otherwise(F.col(c))  # noqa: E731, B023
        lower, upper = F.when(turned, -F.col("upper")).otherwise(F.col("lower")), F.when(turned, -F.col("lower")).otherwise(F.col("upper"))
        error = F.when(F.col("n_units").isNull(), "no shared units").when(F.col("observed").isNull(), "undefined on the shared units").when(F.col("lower").isNull(), "undefined on all resamples")
        out.append(rows.select(F.lit(metric).alias("metric"), "arm_a", "arm_b", minus("observed").alias("observed"), lower.alias("lower"), upper.alias("upper"), "significant", "practical", "n_units", "n_failed", error.alias("error")))
    made = out[0]
    for rows in out[1:]:
        made = made.unionByName(rows)
    blank = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("observed", "lower", "upper", "significant", "practical")]
    return made.select("metric", "arm_a", "arm_b", *blank, "n_units", "n_failed", "error")


def described(scored: DataFrame, by: str = "pipeline_class", **options) -> DataFrame:
    """(by, metric, variant, value, lower, upper, n_failed, error): each class's headline metrics with their intervals, and the rubric score without responses that never ended (variant). A metric that a class has no value of says so in error; classes without rows of its kind are left out."""
    out = []
    for metric in STATISTICS:
        for variant, left_out in (("all", False), ("terminating", True)):
            if left_out and metric != "crs":
                continue
            rows = intervals(scored, metric, [by], exclude_non_terminating=left_out, **options)
            error = F.when(F.col("observed").isNull(), "undefined").when(F.col("lower").isNull(), "undefined on all resamples")
            out.append(rows.select(by, F.lit(metric).alias("metric"), F.lit(variant).alias("variant"), F.col("observed").alias("value"), "lower", "upper", "n_failed", error.alias("error")))
    made = out[0]
    for rows in out[1:]:
        made = made.unionByName(rows)
    return made


def rounded(record: DataFrame, digits: int = 4) -> DataFrame:
    """A record as it is published: numbers rounded half to even, as text formats do, NULL staying NULL; other columns and the order of columns as they are."""
    return record.select(*[F.bround(f.name, digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in record.schema.fields])
