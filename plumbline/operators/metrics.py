"""Scored responses to metrics: refusal F1, conflict resolution, noise degradation, variation between configurations.

All are one hash aggregation over the scored table with derived columns; `by` names the grouping columns. NULL means
undefined and is never replaced by a number, except in noise accuracy, where a missing verdict is a miss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The noise grid, the accuracy at which a curve counts as degraded, and the ratio of the fixed point.
NOISE_GRID = (0.0, 0.25, 0.5, 0.75, 0.9)
HALF, FIXED_POINT = 0.5, 0.75


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    q = F.when(b != 0, a / b)
    return q if empty is None else F.coalesce(q, F.lit(empty))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 where both are 0."""
    return ratio(2 * precision * recall, precision + recall, 0.0)


def refusal_f1(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Refusal as the positive class: an unparseable response is no refusal; degenerate tells which class is absent."""
    rows = scored.filter("dimension = 'refusal'")
    refused, ok = F.col("category") == "refusal", F.col("is_answerable")
    out = rows.groupBy(*by).agg(
        count_if(~ok & refused).alias("tp"), count_if(ok & refused).alias("fp"), count_if(~ok & ~refused).alias("fn"), count_if(ok & ~refused).alias("tn"),
        count_if(ok & (F.col("category") == "answer") & F.coalesce("answer_correct", F.lit(False))).alias("right"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"n": tp + fp + fn + tn, "precision": ratio(tp, tp + fp, 0.0), "recall": ratio(tp, tp + fn, 0.0)})
    out = out.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "plain_accuracy": ratio(F.col("right"), F.col("n"), 0.0), "negative_rejection_rate": F.col("recall")})
    degenerate = F.when((tp + fn == 0) & (fp + tn == 0), "no responses").when(tp + fn == 0, "no unanswerable cases").when(fp + tn == 0, "no answerable cases")
    return out.withColumn("degenerate", degenerate).drop("right")


def conflict_resolution(scored: DataFrame, by: Sequence[str] = (), *, exclude_non_terminating: bool = False) -> DataFrame:
    """Mean rubric score (0 to 4) over judged conflict rows, its quarter, and the zero-filled distribution; scores outside the rubric are an error."""
    rows = scored.filter("dimension = 'conflict' AND crs_score IS NOT NULL")
    if exclude_non_terminating:
        rows = rows.filter(~non_terminating())
    score = F.when(F.col("crs_score").between(0, 4), F.col("crs_score")).otherwise(F.raise_error(F.lit("rubric scores lie between 0 and 4")).cast("int"))
    out = rows.withColumn("crs_score", score).groupBy(*by).agg(F.avg("crs_score").alias("mean"), F.count("*").alias("n"), *[count_if(F.col("crs_score") == k).alias(f"n{k}") for k in range(5)])
    return out.withColumn("normalised", F.col("mean") / 4)


def correct_side(flags: DataFrame, by: Sequence[str] = (), flag: str = "correct_side") -> DataFrame:
    """Share of correct-side answers over all rows and over those that committed (flag not NULL)."""
    hit = count_if(F.coalesce(flag, F.lit(False)))
    return flags.groupBy(*by).agg(F.count("*").alias("n"), count_if(F.col(flag).isNull()).alias("n_no_commitment"), (hit / F.count("*")).alias("over_all"), ratio(hit, F.count(flag)).alias("over_committed"))


def non_terminating() -> Column:
    return F.coalesce("truncated", F.lit(False)) & F.col("final_answer").isNull()


def non_termination(scored: DataFrame, by: Sequence[str] = ("dimension",)) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), count_if(non_terminating()).alias("non_terminating")).withColumn("rate", F.col("non_terminating") / F.col("n"))


def noise_accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy at each noise ratio; a NULL verdict is a miss, a row without ratio is left out."""
    rows = scored.filter("dimension = 'noise' AND noise_ratio IS NOT NULL")
    return rows.groupBy(*by, "noise_ratio").agg(F.avg(F.when(F.col("answer_correct"), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))


def degradation_curve(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Curve (noise_ratio, accuracy) to auc, ndc50, censoring, slope, cliff, fixed_point and ndc50_text.

    Groups that lack a ratio of the grid have NULL metrics. auc is the trapezoid over the span; ndc50 the first downward
    crossing of one half, linearly interpolated, and NULL if censored: left where the curve starts below, right where it
    never falls below. slope is the mean of the drops that are positive, cliff the largest drop, zero at least.
    """
    w = Window.partitionBy(*by).orderBy("noise_ratio")
    steps = curve.filter(F.col("noise_ratio").isin(*NOISE_GRID)).withColumns({"x1": F.lead("noise_ratio").over(w), "y1": F.lead("accuracy").over(w)})
    x0, y0, x1, y1 = (F.col(c) for c in ("noise_ratio", "accuracy", "x1", "y1"))
    drop = y0 - y1
    cross = F.when((y0 >= HALF) & (y1 < HALF), x0 + (y0 - HALF) / (y0 - y1) * (x1 - x0))
    out = steps.groupBy(*by).agg(
        F.count("*").alias("ratios"), (F.sum((x1 - x0) * (y0 + y1) / 2) / (F.max("noise_ratio") - F.min("noise_ratio"))).alias("auc"),
        F.min(cross).alias("crossing"), F.min_by("accuracy", "noise_ratio").alias("start"),
        F.coalesce(F.avg(F.when(drop > 0, drop)), F.lit(0.0)).alias("slope"), F.greatest(F.max(drop), F.lit(0.0)).alias("cliff"),
        F.max(F.when(x0 == FIXED_POINT, y0)).alias("fixed_point"),
    )
    whole = F.col("ratios") == len(NOISE_GRID)
    out = out.withColumn("censored", F.when(whole, F.when(F.col("start") < HALF, "left").when(F.col("crossing").isNull(), "right").otherwise("none")))
    out = out.withColumn("ndc50", F.when(F.col("censored") == "none", F.col("crossing")))
    text = F.when(F.col("censored") == "left", "< 0.00").when(F.col("censored") == "right", "> 0.90").otherwise(F.format_string("%.3f", "ndc50"))
    return out.select(*by, *[F.when(whole, F.col(c)).alias(c) for c in ("auc", "slope", "cliff", "fixed_point")], "ndc50", "censored", F.when(whole, text).alias("ndc50_text"))


def mean_ndc50(curves: DataFrame) -> DataFrame:
    """Mean over uncensored curves with how many there are; NULL if all are censored."""
    return curves.agg(F.avg("ndc50").alias("mean_ndc50"), F.count("ndc50").alias("n_uncensored"), F.count("*").alias("n"))


def metric_table(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long table (by..., metric, value) of the three headline metrics; undefined ones are left out."""
    refusal = refusal_f1(scored, by).filter("degenerate IS NULL").select(*by, F.lit("refusal_f1").alias("metric"), F.col("f1").alias("value"))
    crs = conflict_resolution(scored, by).select(*by, F.lit("crs").alias("metric"), F.col("mean").alias("value"))
    auc = degradation_curve(noise_accuracy(scored, by), by).select(*by, F.lit("ndc_auc").alias("metric"), F.col("auc").alias("value"))
    return refusal.unionByName(crs).unionByName(auc).filter("value IS NOT NULL")


def class_variation(scored: DataFrame) -> DataFrame:
    """Per class and metric: spread over configurations, and the effect of each axis as the range of its marginal means (of metric values, not of rows; NULL with one level)."""
    base = metric_table(scored, ["config_id"])
    part = F.split("config_id", r"\|")
    base = base.select(part[0].alias("pipeline_class"), part[1].alias("retriever"), part[2].alias("generator_key"), "metric", "value")
    key = ["pipeline_class", "metric"]
    out = base.groupBy(*key).agg((F.max("value") - F.min("value")).alias("spread"), F.count("*").alias("n_configs"))
    for axis, name in (("retriever", "retriever_effect"), ("generator_key", "generator_effect")):
        marginal = base.groupBy(*key, axis).agg(F.avg("value").alias("m")).groupBy(*key).agg(F.when(F.count("*") > 1, F.max("m") - F.min("m")).alias(name))
        out = out.join(marginal, key)
    return out


def between_within(scored: DataFrame) -> DataFrame:
    """Per metric: largest spread within a class, its class (first in order of name), largest difference between classes, and which is greater."""
    spread = class_variation(scored).groupBy("metric").agg(F.max("spread").alias("max_within"), F.min_by("pipeline_class", F.struct(-F.col("spread"), F.col("pipeline_class"))).alias("worst_class"))
    own = metric_table(scored, ["pipeline_class"]).groupBy("metric").agg((F.max("value") - F.min("value")).alias("max_between"))
    return spread.join(own, "metric").withColumn("between_exceeds_within", F.col("max_between") > F.col("max_within"))


def divergent_cases(scored: DataFrame, limit: int = 20) -> DataFrame:
    """First cases per dimension at which the classes differ: by two rubric levels or more in conflict, else in any two values (NULL is a value). Of a class's configurations, the last by name speaks."""
    last = scored.groupBy("dimension", "case_id", "pipeline_class").agg(F.max_by(F.struct("answer_correct", "category", "crs_score"), "config_id").alias("r"))
    verdict = F.when(F.col("dimension") == "refusal", F.col("r.category")).otherwise(F.coalesce(F.col("r.answer_correct").cast("string"), F.lit("None")))
    cases = last.groupBy("dimension", "case_id").agg((F.max("r.crs_score") - F.min("r.crs_score")).alias("gap"), F.count_distinct(verdict).alias("kinds"))
    out = cases.filter(F.when(F.col("dimension") == "conflict", F.coalesce(F.col("gap") >= 2, F.lit(False))).otherwise(F.col("kinds") >= 2))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy("case_id"))).filter(F.col("rank") <= limit).select("dimension", "case_id", "rank")


def seed_source(seed_id: str = "seed_id") -> Column:
    return F.when(F.col(seed_id).startswith("nq-"), "nq").when(F.col(seed_id).startswith("tqa-"), "tqa").otherwise("unknown")
