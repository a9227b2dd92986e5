"""Deduplication, ranking and sampling with a total order, so that results don't depend on partitioning.

Random order is the order of a hash of a stated key. Places in a whole group are prefix sums over ranges of it; operators that want
the first rows of a group limit them in each task. None ranks a whole table or group in one task, unless it is a list of strata.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import written


def shuffled(seed: int | str, *key: str) -> Column:
    """A pseudo-random value of the key: md5 of seed and key, as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def last_wins(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row of each key that comes last in order: one aggregation with map-side combine, whatever a key's number of rows."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*key, "row.*").select(*rows.columns)


def first_wins(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*key, "row.*").select(*rows.columns)


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank. Spark turns the filter on row_number into a limit per group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Equal names, NULLs being equal too; those of b carry a mark."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"{c}__of"]) for c in names], F.lit(True))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of the amounts of all rows of the group that come before this one in a total order; 0 for the first.

    Rows are dealt out in ranges of group and order, as Spark samples them; sums within a range are added to those of the ranges before
    it, of which a group has no more than there are partitions. So no task holds more than a range, however large a group is.
    """
    ranged = written(rows.withColumn("amount__", amount).repartitionByRange(*by, *order).withColumn("range__", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranged.groupBy(*by, "range__").agg(F.sum("amount__").alias("sum__")).withColumn("before__", F.coalesce(F.sum("sum__").over(ahead), F.lit(0)))
    sums = sums.drop("sum__").withColumnsRenamed({c: f"{c}__of" for c in [*by, "range__"]})
    within = Window.partitionBy(*by, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("within__", F.coalesce(F.sum("amount__").over(within), F.lit(0)))
    out = local.join(sums, _same(local, sums, [*by, "range__"]))
    return out.select(*rows.columns, (F.col("before__") + F.col("within__")).alias(name))


def average_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, value, rank) of the distinct values of each group, ties sharing their mean rank; weight: how many rows a row stands for.

    Rows are counted by value before they are ordered, so ties cost a row.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    values = running(rows.groupBy(*by, value).agg(n.alias("n__")), by, [value], F.col("n__"), "below__")
    return values.select(*by, value, (F.col("below__") + (F.col("n__") + 1) / F.lit(2.0)).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per group over rows where both are defined; NULL below three rows or where a side is constant. Equal pairs of values are counted first."""
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("w"))
    pairs = written(pairs, "pairs")
    for c in ("x", "y"):
        ranks = average_ranks(pairs, c, by, "w").withColumnsRenamed({k: f"{k}__of" for k in [*by, c]}).withColumnRenamed("rank", f"r{c}")
        pairs = pairs.join(ranks, _same(pairs, ranks, [*by, c])).drop(*[f"{k}__of" for k in [*by, c]])
    w, mean = F.col("w"), lambda c: F.sum(F.col("w") * c) / F.sum("w")
    rx, ry = F.col("rx"), F.col("ry")
    out = pairs.groupBy(*by).agg(F.sum(w).alias("n"), (F.sum(w) + 1).alias("twice"), mean(rx * ry).alias("xy"), mean(rx * rx).alias("xx"), mean(ry * ry).alias("yy"), ((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))).alias("vary"))
    middle = (F.col("twice") / 2.0) ** 2  # ranks have the same mean, with or without ties
    vx, vy = F.col("xx") - middle, F.col("yy") - middle
    return out.select(*by, "n", F.when((F.col("n") >= 3) & F.col("vary"), (F.col("xy") - middle) / F.sqrt(vx * vy)).alias("rho"))


def sample(rows: DataFrame, n: int, seed: int | str, *key: str) -> DataFrame:
    """n rows without replacement in hash order, all if there are fewer; a bounded top-n, merged from per-task top-n."""
    return rows.orderBy(shuffled(seed, *key), *key).limit(n)


def sample_per_stratum(rows: DataFrame, strata: Sequence[str], n: int, seed: int | str, *key: str) -> DataFrame:
    return top_k(rows, strata, [shuffled(seed, *key), *[F.col(k) for k in key]], n)


def quotas(strata: DataFrame, key: str, size: str, total: int, name: str = "quota") -> DataFrame:
    """Largest-remainder apportionment of total over strata (key, size), one row each: (key, size, name)."""
    whole = Window.partitionBy()
    exact = F.col(size) * F.lit(float(total)) / F.sum(size).over(whole)
    rows = strata.withColumn("exact", exact).withColumn("floor", F.floor("exact"))
    spare = F.lit(total) - F.sum("floor").over(whole)
    order = F.row_number().over(Window.partitionBy().orderBy((F.col("exact") - F.col("floor")).desc(), key))
    return rows.select(key, size, (F.col("floor") + (order <= spare).cast("int")).cast("int").alias(name))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def stratified_sample(cases: DataFrame, *, fraction: float, second: int, seed: int | str, stratum: str = "dimension", base: str = "seed_id", case: str = "case_id") -> DataFrame:
    """Proportional sample over base cases (stratum, base), each represented by one member in rotation, and a subsample for a second rater.

    A stratum's quota is its number of base cases times fraction, halves up. Base cases are taken in hash order; the i-th is
    represented by its member i modulo the number of its members. second rows go to the second rater: per stratum a prefix, by
    largest remainder. Columns: stratum, base, case, place, second_rater.
    """
    members = cases.select(stratum, base, case).distinct().withColumn("nth", F.row_number().over(Window.partitionBy(stratum, base).orderBy(case)) - 1)
    bases = members.groupBy(stratum, base).agg(F.count("*").alias("members"))
    bases = running(bases.withColumn("h", shuffled(seed, stratum, base)), [stratum], ["h", base], F.lit(1), "place").drop("h")
    sizes = bases.groupBy(stratum).agg(half_up(F.count("*") * fraction).alias("quota"))
    chosen = bases.join(F.broadcast(sizes), stratum).filter(F.col("place") < F.col("quota"))  # a row per stratum
    share = quotas(sizes, stratum, "quota", second, "share").select(stratum, "share") if second else sizes.select(stratum, F.lit(0).alias("share"))
    rows = chosen.join(members, [stratum, base]).filter(F.col("nth") == F.col("place") % F.col("members")).join(F.broadcast(share), stratum)
    return rows.select(stratum, base, case, "place", (F.col("place") < F.col("share")).alias("second_rater"))


def balanced_sample(rows: DataFrame, group: str, n: int, seed: int | str, *key: str) -> DataFrame:
    """n rows: of each group its n div k first in hash order, then the rest from all groups in hash order; fewer if there are fewer."""
    # of no group are more than its own and n further rows taken, so that many are all that leaves a task
    ranked = top_k(rows.withColumn("h", shuffled(seed, *key)), [group], [F.col(c) for c in ("h", *key)], 2 * n).withColumnRenamed("rank", "place")
    k = rows.agg(F.count_distinct(group).alias("k"))
    ranked = ranked.crossJoin(F.broadcast(k)).withColumn("own", F.col("place") <= F.floor(n / F.col("k")))  # one row
    return ranked.orderBy(F.col("own").desc(), "h", *key).limit(n).drop("h", "place", "k", "own")


def round_robin(work: DataFrame, stream: str, order: str) -> DataFrame:
    """Adds turn, the place within a stream: the order (turn, stream) takes from each stream alternately."""
    return running(work, [stream], [order], F.lit(1), "turn").withColumn("turn", F.col("turn") + 1)


def budget_fill(pool: DataFrame, group: Sequence[str], order: Sequence[str], tokens: str, budget: str, least: int = 15) -> DataFrame:
    """Rows taken in order until the budget is used: adds used, the words taken of each, and truncated.

    A row is taken if at least `least` of the budget is left before it; the last one is cut to what is left.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col(budget) - F.coalesce(F.sum(tokens).over(w), F.lit(0))
    rows = pool.withColumn("rest", rest).filter(F.col("rest") >= least)
    return rows.withColumn("used", F.least(F.col(tokens), F.floor("rest")).cast("int")).withColumn("truncated", F.col(tokens) > F.col("rest")).drop("rest")


def consume_until(pool: DataFrame, order: Sequence[str], ok: str, first: int, then: int, group: Sequence[str] = ()) -> DataFrame:
    """Walk a pool in order until `first` rows with ok are found; the next `then` rows of any kind follow. Adds role (found or control); rows passed over are left out, and without enough finds there are no controls.

    Both are the first rows of a group in some order, so each task passes on a limited number of them: no task walks the pool.
    """
    rows = pool.withColumn("at", F.struct(*order)).withColumn("walk", F.struct(*group) if group else F.struct(F.lit(0)))
    found = top_k(rows.filter(ok), ["walk"], [F.col("at")], first).drop("rank")
    stops = found.groupBy("walk").agg(F.max("at").alias("stop"), F.count("*").alias("n")).filter(F.col("n") == first).drop("n")
    after = rows.join(stops, "walk").filter(F.col("at") > F.col("stop")).drop("stop")
    controls = top_k(after, ["walk"], [F.col("at")], then).drop("rank")
    out = found.withColumn("role", F.lit("found")).unionByName(controls.withColumn("role", F.lit("control")))
    return out.drop("at", "walk")


def protected_trim(rows: DataFrame, protected: str, key: str, target: int) -> DataFrame:
    """target rows, protected ones and those late by key staying longest."""
    return rows.orderBy(F.col(protected).desc(), F.col(key).desc()).limit(target)
