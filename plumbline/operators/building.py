"""Building a benchmark end to end: synthetic cases, the noise testbed, verification of what was built, slices of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import NO_ANSWER, on_word_boundary, strip
from plumbline.operators.metrics import NOISE_GRID
from plumbline.operators.ranking import sample, shuffled
from plumbline.operators.testbeds import PASSAGE, achieved_ratio, answer_bearing, contradiction_verdict, noise_fill, passage, reject_reason, seed_problems

#: Words of a seed's own evidence and of a distractor, and the mix of kinds that a throughput trial draws from.
SIGNAL_TOKENS, DISTRACTOR_TOKENS = 700, 200
CASE_MIX = [("refusal", 0.15), ("conflict", 0.15), ("noise-0.25", 0.15), ("noise-0.75", 0.25), ("noise-0.90", 0.30)]
WARNINGS = 20


def uniform(seed: int | str, *key: str) -> Column:
    """A number from 0 up to 1 of the key."""
    return F.conv(F.substring(shuffled(seed, *key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def weighted_choice(u: Column, options: Sequence[tuple[str, float]]) -> Column:
    """The option in whose share of the cumulative weights u, from 0 up to 1, falls."""
    total = float(sum(w for _, w in options))
    if not options or total <= 0 or min(w for _, w in options) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    at, choice = 0.0, None
    for name, weight in options[:-1]:
        at += weight
        test = u * F.lit(total) < F.lit(at)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return choice.otherwise(options[-1][0]) if choice is not None else F.lit(options[0][0])


def synthetic_cases(spark: SparkSession, n: int, seed: int = 11, mix: Sequence[tuple[str, float]] = CASE_MIX) -> DataFrame:
    """n cases with the token profile of the real benchmark: (kind, i, and a case's columns). A noise case of ratio r has SIGNAL_TOKENS * r / (1 - r) words of distractors, in passages of DISTRACTOR_TOKENS, one at least."""
    phrase = "the tower district construction record entry "
    body = lambda k: F.array_join(F.slice(F.split(F.lit((phrase * (max(SIGNAL_TOKENS, DISTRACTOR_TOKENS) // 6 + 1)).strip()), " "), 1, k), " ")
    signal = passage(F.lit("p0"), F.concat(F.lit("The tower was completed in 1889. "), body(SIGNAL_TOKENS)), True, False)
    rival = passage(F.lit("p1"), body(SIGNAL_TOKENS), False, True)
    rows = spark.range(n).select(F.col("id").alias("i")).withColumn("kind", weighted_choice(uniform(seed, "i"), mix))
    ratio = F.when(F.col("kind").startswith("noise"), F.split("kind", "-")[1].cast("double"))
    rows = rows.withColumn("noise_ratio", ratio)
    extra = F.greatest(F.lit(1), F.floor(F.floor(SIGNAL_TOKENS * F.col("noise_ratio") / (1 - F.col("noise_ratio"))) / DISTRACTOR_TOKENS)).cast("int")
    distractors = F.transform(F.sequence(F.lit(1), extra), lambda k: passage(F.concat(F.lit("p"), k.cast("string")), body(DISTRACTOR_TOKENS), False, True))
    passages = F.when(F.col("kind") == "refusal", F.array(signal)).when(F.col("kind") == "conflict", F.array(signal, rival)).otherwise(F.concat(F.array(signal), distractors))
    dimension = F.when(ratio.isNotNull(), "noise").otherwise(F.col("kind"))
    label = F.when(ratio.isNotNull(), F.concat(F.lit("noise"), F.floor(F.col("noise_ratio") * 100).cast("string"))).otherwise(F.col("kind"))
    perturbation = F.when(F.col("kind") == "refusal", "answer_passage_retained").when(F.col("kind") == "conflict", "contradiction_injected").otherwise("distractors_added")
    return rows.select(
        "kind", "i", F.concat(F.lit("spike-"), label, F.lit("-"), F.col("i").cast("string")).alias("case_id"), F.lit("In what year was the tower completed?").alias("query"), passages.cast(f"array<{PASSAGE}>").alias("passages"), F.lit("1889").alias("answer"),
        dimension.alias("dimension"), perturbation.alias("perturbation_type"), "noise_ratio", F.concat(F.lit("s"), F.col("i").cast("string")).alias("seed_id"),
    )


def noise_testbed(seeds: DataFrame, pool: DataFrame, n_seeds: int, ratios: Sequence[float] = NOISE_GRID, seed: int = 202) -> tuple[DataFrame, DataFrame]:
    """(filled, warnings) for the first n_seeds seeds (place, seed_id, passage_id, tokens): what noise_fill makes of those with a pool, and a row (seed_id, warning) for each that has none, and for a shortfall of seeds (seed_id NULL).

    A seed without pool is left out whole: with too few distractors the ratio would mean something else.
    """
    known = seeds.groupBy("seed_id").agg(F.min("place").alias("place")).orderBy("place", "seed_id").limit(n_seeds).select("seed_id")
    stocked = known.join(pool.select("seed_id").distinct(), "seed_id", "left_semi")
    empty = known.join(stocked, "seed_id", "left_anti").select("seed_id", F.lit("empty distractor pool, skipped").alias("warning"))
    found = known.agg(F.count("*").alias("n")).filter(F.col("n") < n_seeds)
    short = found.select(F.lit(None).cast("string").alias("seed_id"), F.concat(F.lit(f"SHORTFALL: requested {n_seeds} seeds, only "), F.col("n").cast("string"), F.lit(" available")).alias("warning"))
    own = seeds.join(stocked, "seed_id", "left_semi").select("seed_id", "passage_id", "tokens")
    return noise_fill(own, pool.join(stocked, "seed_id", "left_semi"), ratios, seed), short.unionByName(empty)


def noise_stats(filled: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: seeds and instances that were built, the number of warnings, and the first WARNINGS of them by seed, a shortfall first."""
    built = filled.agg(F.count_distinct("seed_id").alias("n_seeds"), F.count_distinct("seed_id", "noise_ratio").alias("n_instances"))
    counted = warnings.agg(F.count("*").alias("n_warnings"))
    text = F.concat(F.coalesce(F.concat(F.col("seed_id"), F.lit(": ")), F.lit("")), F.col("warning"))
    first = warnings.orderBy(F.col("seed_id").asc_nulls_first(), "warning").limit(WARNINGS)
    shown = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("seed_id", F.lit("")).alias("s"), text.alias("t")))), lambda x: x["t"]).alias("warnings"))
    return built.crossJoin(counted).crossJoin(shown)  # one row each


def seed_stage(candidates: DataFrame, quotas: dict[str, int], seed: int = 20260721, least: int = 50, most: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, rejected, problems) of candidate seeds (seed_id, source, answer, passages): per source a sample of its quota in hash order, less what the filters reject (reason, n); problems are flags of kept seeds that their text doesn't bear out, and must be empty to build on."""
    parts = [sample(candidates.filter(F.col("source") == name), n, seed + i, "seed_id") for i, (name, n) in enumerate(quotas.items())]
    drawn = parts[0]
    for p in parts[1:]:
        drawn = drawn.unionByName(p)
    drawn = drawn.withColumn("reason", reject_reason(least, most))
    kept = drawn.filter("reason IS NULL").drop("reason")
    return kept, drawn.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")), seed_problems(kept)


def partition(seeds: DataFrame, n: int, seed: int) -> DataFrame:
    """The n seeds that a testbed draws from, in hash order of its own seed, so that testbeds draw apart."""
    return sample(seeds, n, seed, "seed_id")


def violations(cases: DataFrame, threshold: float = 0.70, drift: float = 0.01) -> DataFrame:
    """(case_id, problem) of built cases, re-derived from what they hold. Problems of a whole testbed have a NULL case_id.

    Refusal: as many unanswerable as answerable cases; the sentinel and no answer passage in the former, an answer passage in
    the latter. Conflict: two passages, one of each position, the answer in the true one only, a contradiction score at the
    threshold, the recorded position as it is, and the true passage first in a quarter to three quarters of the cases. Noise: an
    answer passage, and a ratio within drift. All: flags that the text bears out.
    """
    bearing = F.exists("passages", lambda p: p["is_answer_bearing"])
    shut = F.col("answer") == NO_ANSWER
    true, rival = F.get(answer_bearing(), F.lit(0)), F.get(F.filter("passages", lambda p: p["is_injected"]), F.lit(0))
    sides = (F.size("passages") == 2) & (F.size(answer_bearing()) == 1) & (F.size(F.filter("passages", lambda p: p["is_injected"])) == 1)
    holds = lambda p: F.contains(F.lower(p["text"]), F.lower("answer"))
    position = F.array_position(F.transform("passages", lambda p: p["is_answer_bearing"]), True) - 1
    says = F.coalesce(F.try_element_at("gen_params", F.lit("contradiction_score")).try_cast("double"), F.lit(0.0))
    conflict, noise = F.col("dimension") == "conflict", F.col("dimension") == "noise"
    checks = [
        ("unanswerable with an answer passage", shut & bearing), ("no answer passage", ~shut & ~bearing & ~conflict), ("unanswerable outside refusal", shut & (F.col("dimension") != "refusal")),
        ("not two opposed passages", conflict & ~sides), ("answer in the contradiction", conflict & sides & holds(rival)), ("answer not in the original", conflict & sides & ~holds(true)), ("contradiction score below the threshold", conflict & (says < threshold)),
        ("recorded position is wrong", conflict & sides & ~F.try_element_at("gen_params", F.lit("true_passage_position")).try_cast("long").eqNullSafe(position)),
        ("ratio off target", noise & (F.abs(achieved_ratio() - F.coalesce("noise_ratio", F.lit(0.0))) >= drift)),
    ]
    named = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks]), lambda x: x.isNotNull())
    each = cases.select("case_id", F.explode(named).alias("problem"))
    flags = cases.filter(~shut).select("case_id", "answer", F.explode(answer_bearing()).alias("p")).filter(~on_word_boundary(F.col("answer"), F.col("p.text")))
    flagged = flags.select("case_id", F.concat(F.lit("answer not in the text of "), F.col("p.passage_id")).alias("problem"))
    counts = cases.agg(
        F.count_if((F.col("dimension") == "refusal") & shut).alias("shut"), F.count_if((F.col("dimension") == "refusal") & ~shut).alias("open"),
        F.count_if(conflict & F.coalesce(position == 0, F.lit(False))).alias("first"), F.count_if(conflict).alias("conflicts"),
    )
    share = F.try_divide(F.col("first"), F.col("conflicts"))
    whole = F.filter(F.array(F.when(F.col("shut") != F.col("open"), "refusal is unbalanced"), F.when((share <= 0.25) | (share >= 0.75), "order of conflict is not random")), lambda x: x.isNotNull())
    return each.unionByName(flagged).unionByName(counts.select(F.lit(None).cast("string").alias("case_id"), F.explode(whole).alias("problem")))


def smoke_slice(cases: DataFrame, n: int) -> DataFrame:
    """A miniature of the benchmark by sorted case id: half of n unanswerable refusal cases and controls for the rest of n, n conflict cases, and all cases of n noise seeds, in the order in which their first case comes."""
    shut = F.col("answer") == NO_ANSWER
    half = max(1, n // 2)
    by_id = Window.partitionBy("dimension", shut).orderBy("case_id")
    rows = cases.withColumn("place", F.row_number().over(by_id))
    refusal = rows.filter("dimension = 'refusal'")
    found = refusal.agg(F.least(F.count_if(shut), F.lit(half)).alias("taken"))
    refusal = refusal.crossJoin(F.broadcast(found)).filter(F.when(shut, F.col("place") <= half).otherwise(F.col("place") <= n - F.col("taken"))).drop("taken")  # one row
    noise = rows.filter("dimension = 'noise'")
    chosen = noise.groupBy("seed_id").agg(F.min("case_id").alias("first")).orderBy("first").limit(n).select("seed_id")
    return refusal.unionByName(rows.filter(f"dimension = 'conflict' AND place <= {n}")).unionByName(noise.join(F.broadcast(chosen), "seed_id", "left_semi")).drop("place")  # n seeds


def seen_in_order(steps: Column | str = "steps", ids: str = "passage_ids") -> Column:
    """Passage ids over an array of steps, each once, in the order in which they were first seen; steps that are NULL or have none add nothing."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.flatten(F.transform(steps, lambda s: F.coalesce(s[ids], none)))), none)


def shortfall(rows: DataFrame, strata: Sequence[str], wanted: int, counted: Column | None = None) -> DataFrame:
    """(strata, missing): how many rows each stratum lacks of what is wanted of it; with counted, of rows for which it holds."""
    n = F.count("*") if counted is None else F.count_if(counted)
    return rows.groupBy(*strata).agg(F.greatest(F.lit(0).cast("long"), wanted - n).alias("missing"))


def rotated(members: DataFrame, base: str, member: str, turn: Column) -> DataFrame:
    """Of each base its member number turn modulo their count, in order of the member."""
    w = Window.partitionBy(base)
    rows = members.select(base, member).distinct().withColumns({"nth": F.row_number().over(w.orderBy(member)) - 1, "n": F.count("*").over(w)})
    return rows.filter(F.col("nth") == turn % F.col("n")).select(base, member)


def conflict_stage(pool: DataFrame, target: int, order: str, threshold: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """(accepted, reasons) of walking a pool (seed columns, original, answer, generated, score, error, truncated) in order until `target` generated contradictions are accepted: those rows, and how many rows before that were rejected for which reason (reason, n). Rows after it aren't looked at; a pool that is too small is walked whole.

    A failed call is generation_failed, a blank reply empty_response, a cut one truncated; the others are judged by what they say.
    """
    text = F.coalesce("generated", F.lit(""))
    reason = F.when(F.coalesce(F.col("error") != "", F.lit(False)), "generation_failed").when(strip(text) == "", "empty_response").when(F.coalesce("truncated", F.lit(False)), "truncated")
    rows = pool.withColumn("reason", F.coalesce(reason, contradiction_verdict(F.col("original"), F.col("generated"), F.col("answer"), F.col("score"), threshold)))
    accepted = rows.filter("reason IS NULL").orderBy(order).limit(target)
    stop = accepted.agg(F.when(F.count("*") == target, F.max(order)).alias("stop"))
    before = rows.filter("reason IS NOT NULL").crossJoin(F.broadcast(stop)).filter(F.col("stop").isNull() | (F.col(order) < F.col("stop")))  # one row
    return accepted.drop("reason"), before.groupBy("reason").agg(F.count("*").alias("n"))
