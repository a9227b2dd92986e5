"""Agreement of two raters from their contingency table, which is aggregated once whatever the number of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import count_if

#: Raw agreement at or above which a kappa at or below the other counts as paradoxical; the gate for use.
PARADOX_OBSERVED, PARADOX_KAPPA, GATE = 0.80, 0.40, 0.60


def _cells(ratings: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    return ratings.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))


def diagnostics(ratings: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, observed, expected, kappa, ac1, pabak, prevalence_index, bias_index and paradox by group.

    Kappa is 1 where chance agreement is certain; AC1 is 1 with a single label. The last indices exist for two labels only.
    """
    cells = _cells(ratings, a, b, by)
    key = list(by)
    total = cells.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    sides = cells.select(*key, F.col("a").alias("label"), F.col("c").alias("ca"), F.lit(0).alias("cb")).unionByName(cells.select(*key, F.col("b").alias("label"), F.lit(0).alias("ca"), F.col("c").alias("cb")))
    labels = sides.groupBy(*key, "label").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    labels = labels.join(total, key) if key else labels.crossJoin(F.broadcast(total))  # one row
    pa, pb = F.col("ca") / F.col("n"), F.col("cb") / F.col("n")
    pi = (pa + pb) / 2
    out = labels.groupBy(*key).agg(
        F.max("n").alias("n"), F.max(F.col("same") / F.col("n")).alias("observed"), F.sum(pa * pb).alias("expected"), F.count("*").alias("q"), F.sum(pi * (1 - pi)).alias("spread"),
        F.min_by("ca", "label").alias("low_a"), F.min_by("cb", "label").alias("low_b"), F.max_by("ca", "label").alias("high_a"),
    )
    two = F.col("q") == 2
    po, pe = F.col("observed"), F.col("expected")
    chance = F.when(F.col("q") > 1, F.col("spread") / (F.col("q") - 1))
    out = out.withColumns({
        "kappa": F.when(pe >= 1, F.lit(1.0)).otherwise(F.try_divide(po - pe, 1 - pe)),
        "ac1": F.when(F.col("q") < 2, F.lit(1.0)).otherwise(F.try_divide(po - chance, 1 - chance)),
        "pabak": F.when(two, 2 * po - 1),
        # share of both-high less share of both-low cells, from the marginals
        "prevalence_index": F.when(two, F.abs((F.col("n") - F.col("low_a") - F.col("low_b")) / F.col("n"))),
        "bias_index": F.when(two, F.abs((F.col("low_a") - F.col("low_b")) / F.col("n"))),
    })
    out = out.withColumn("paradox", (po >= PARADOX_OBSERVED) & (F.col("kappa") <= PARADOX_KAPPA))
    return out.select(*key, "n", "observed", "expected", "kappa", "ac1", "pabak", "prevalence_index", "bias_index", "paradox")


def weighted_kappa(ratings: DataFrame, a: str, b: str, by: Sequence[str] = (), levels: int = 5) -> DataFrame:
    """Quadratic-weighted kappa of levels 0 to levels - 1, from the moments of the contingency table: the expected squared distance needs means and mean squares only; 1 where it is 0."""
    cells = _cells(ratings, a, b, by).withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")})
    m = lambda e: F.sum(e * F.col("c")) / F.sum("c")
    x, y = F.col("a"), F.col("b")
    out = cells.groupBy(*by).agg(F.sum("c").alias("n"), m((x - y) ** 2).alias("seen"), m(x).alias("mx"), m(y).alias("my"), m(x * x).alias("xx"), m(y * y).alias("yy"))
    chance = F.col("xx") + F.col("yy") - 2 * F.col("mx") * F.col("my")
    return out.select(*by, "n", F.when(chance == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.col("seen"), chance)).alias("weighted_kappa"))


def judge_agreement(ratings: DataFrame, human: str, judge: str) -> DataFrame:
    """One row: n, kappa, weighted_kappa, exact, within_one, usable (kappa at the gate or above), and both distributions over 0 to 4."""
    rows = ratings.filter(F.col(human).isNotNull() & F.col(judge).isNotNull())
    h, j = F.col(human), F.col(judge)
    counts = rows.agg(F.avg((h == j).cast("double")).alias("exact"), F.avg((F.abs(h - j) <= 1).cast("double")).alias("within_one"), *[count_if(h == k).alias(f"human_{k}") for k in range(5)], *[count_if(j == k).alias(f"judge_{k}") for k in range(5)])
    d = diagnostics(rows, human, judge).select("n", "kappa")
    return d.crossJoin(weighted_kappa(rows, human, judge).select("weighted_kappa")).crossJoin(counts).withColumn("usable", F.col("kappa") >= GATE)  # one row each


def label_agreement(first: DataFrame, second: DataFrame, *, by: str = "dimension") -> DataFrame:
    """Agreement of two label sheets (case_id, question_no, dimension, answer) on shared answered questions: all together and per dimension of two rows or more, with the number of questions that only one answered."""
    told = lambda t, n: t.withColumn(n, F.lower(F.trim("answer"))).filter(F.col(n).isin("yes", "no")).select("case_id", "question_no", by, n)
    both = told(first, "a").join(told(second, "b").drop(by), ["case_id", "question_no"], "full")
    shared = both.filter("a IS NOT NULL AND b IS NOT NULL")
    blank = both.filter("a IS NULL OR b IS NULL").agg(F.count("*").alias("skipped_blank"))
    whole = diagnostics(shared, "a", "b").withColumn(by, F.lit("(all)"))
    out = whole.unionByName(diagnostics(shared.filter(F.col(by).isNotNull()), "a", "b", [by]).filter("n >= 2"))
    return out.crossJoin(blank)  # one row
