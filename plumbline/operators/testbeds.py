"""Seeds to test cases: filters, perturbations, invariants and repairs, as projections over nested passages."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import NO_ANSWER, on_exact_boundary, on_word_boundary, trim_blanks, word_count
from plumbline.operators.metrics import NOISE_GRID
from plumbline.operators.ranking import budget_fill, shuffled

PASSAGE = "struct<passage_id:string,text:string,is_answer_bearing:boolean,is_injected:boolean>"
#: The perturbations that each dimension allows.
ALLOWED = {"refusal": ("answer_passage_removed", "answer_passage_retained"), "conflict": ("contradiction_injected",), "noise": ("distractors_added",)}


def passage(pid: Column, text: Column, bearing: Column | bool, injected: Column | bool) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, bool) else x
    return F.struct(pid.alias("passage_id"), text.alias("text"), lit(bearing).alias("is_answer_bearing"), lit(injected).alias("is_injected"))


def answer_bearing(passages: str = "passages", yes: bool = True) -> Column:
    return F.filter(passages, lambda p: p["is_answer_bearing"] if yes else ~p["is_answer_bearing"])


def tokens_of(passages: str = "passages") -> Column:
    return F.aggregate(passages, F.lit(0), lambda s, p: s + word_count(p["text"]))


def achieved_ratio(passages: str = "passages") -> Column:
    """Words of injected passages over all words; 0 without words."""
    injected = F.aggregate(passages, F.lit(0), lambda s, p: s + F.when(p["is_injected"], word_count(p["text"])).otherwise(0))
    return F.coalesce(F.try_divide(injected.cast("double"), tokens_of(passages)), F.lit(0.0))


def reject_reason(least: int = 50, most: int = 2000) -> Column:
    """First failing filter of a seed (answer, passages): NULL for seeds that stay."""
    answer, n = F.trim("answer"), tokens_of()
    return (
        F.when(F.size(answer_bearing()) == 0, "no_answer_passage").when(F.length(answer) < 2, "ambiguous_answer")
        .when(F.contains(answer, F.lit(";")) | F.contains(answer, F.lit(" | ")) | F.contains(answer, F.lit("||")), "multi_answer")
        .when(n < least, "evidence_too_short").when(n > most, "evidence_too_long")
    )


def seed_problems(seeds: DataFrame, folded: bool = True) -> DataFrame:
    """(seed_id, passage_id, problem): empty answers, flags that the text doesn't bear out, seeds without an answer passage.

    Accents are folded, so that 'Bogota' stands in a text with 'Bogotá'; with folded=False they tell words apart, and a passage without text is no problem.
    """
    stands = on_word_boundary if folded else on_exact_boundary
    empty = trim_blanks(F.col("answer")) == ""
    whole = seeds.select("seed_id", F.lit(None).cast("string").alias("passage_id"), F.when(empty, "empty answer").when(F.size(answer_bearing()) == 0, "no answer-bearing passage").alias("problem")).filter("problem IS NOT NULL")
    flagged = seeds.filter(~empty).select("seed_id", "answer", F.explode("passages").alias("p")).filter(F.col("p.is_answer_bearing") & ~stands(F.col("answer"), F.col("p.text")))
    return whole.unionByName(flagged.select("seed_id", F.col("p.passage_id").alias("passage_id"), F.lit("answer not in the text").alias("problem")))


def invariant_problem() -> Column:
    """First invariant that a case (dimension, perturbation_type, noise_ratio, answer, passages) breaks; NULL if none."""
    bearing, removed = F.exists("passages", lambda p: p["is_answer_bearing"]), F.col("perturbation_type") == "answer_passage_removed"
    ok = F.lit(False)
    for dimension, kinds in ALLOWED.items():
        ok = ok | ((F.col("dimension") == dimension) & F.col("perturbation_type").isin(*kinds))
    noise, ratio = F.col("dimension") == "noise", F.col("noise_ratio")
    return (
        F.when(F.size("passages") <= 0, "no passages").when(noise & ratio.isNull(), "ratio missing").when(noise & ~ratio.isin(*NOISE_GRID), "ratio off the grid").when(~noise & ratio.isNotNull(), "ratio outside noise")
        .when(~ok, "perturbation not allowed").when(removed & (F.col("answer") != NO_ANSWER), "unanswerable with an answer").when(removed & bearing, "unanswerable with an answer passage")
        .when(~removed & (F.col("answer") == NO_ANSWER), "answerable without an answer").when(~removed & ~bearing, "answerable without an answer passage")
    )


def checked(cases: DataFrame) -> DataFrame:
    """The cases; reading one that breaks an invariant is an error."""
    bad = invariant_problem()
    return cases.withColumn("case_id", F.when(bad.isNull(), F.col("case_id")).otherwise(F.raise_error(F.concat(F.col("case_id"), F.lit(": "), bad)).cast("string")))


def served(passages: str = "passages") -> Column:
    """Passages as a pipeline sees them: id and text only."""
    return F.transform(passages, lambda p: F.struct(p["passage_id"].alias("passage_id"), p["text"].alias("text")))


def distractor(p: Column) -> Column:
    """A passage as distractor: id with prefix, not answer-bearing, injected."""
    return passage(F.concat(F.lit("dist-"), p["passage_id"]), p["text"], False, True)


def unanswerable(seeds: DataFrame, replacement: str = "replacement") -> DataFrame:
    """Refusal cases: answer passages go, the replacement comes last, the sentinel is the answer."""
    return seeds.select(
        F.concat(F.lit("refusal-"), F.col("seed_id"), F.lit("-u")).alias("case_id"), "query", F.concat(answer_bearing(yes=False), F.array(F.col(replacement))).alias("passages"), F.lit(NO_ANSWER).alias("answer"),
        F.lit("refusal").alias("dimension"), F.lit("answer_passage_removed").alias("perturbation_type"), F.lit(None).cast("double").alias("noise_ratio"), "seed_id",
    )


def answerable(seeds: DataFrame) -> DataFrame:
    return seeds.select(
        F.concat(F.lit("refusal-"), F.col("seed_id"), F.lit("-a")).alias("case_id"), "query", "passages", "answer", F.lit("refusal").alias("dimension"), F.lit("answer_passage_retained").alias("perturbation_type"),
        F.lit(None).cast("double").alias("noise_ratio"), "seed_id",
    )


def conflict(seeds: DataFrame, text: str = "contradiction", seed: int = 303) -> DataFrame:
    """Conflict cases: the first answer passage and its contradiction in hash order, with the true passage's position."""
    true = F.get(answer_bearing(), F.lit(0))
    rows = seeds.withColumns({"t": true}).withColumn("c", passage(F.concat(F.col("t.passage_id"), F.lit("-contra")), F.col(text), False, True))
    key = lambda p: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("seed_id"), F.col(p)).cast("binary"))
    first = key("t.passage_id") < key("c.passage_id")
    return rows.select(
        F.concat(F.lit("conflict-"), F.col("seed_id")).alias("case_id"), "query", F.when(first, F.array("t", "c")).otherwise(F.array("c", "t")).alias("passages"), "answer", F.lit("conflict").alias("dimension"),
        F.lit("contradiction_injected").alias("perturbation_type"), F.lit(None).cast("double").alias("noise_ratio"), "seed_id", F.when(first, 0).otherwise(1).alias("true_position"),
    )


def contradiction_verdict(original: Column, generated: Column, answer: Column, score: Column, threshold: float = 0.70) -> Column:
    """First reason to reject a generated contradiction; NULL if it is accepted."""
    from plumbline.functions.text import claim_sentence

    needle = F.lower(F.trim(answer))
    return F.when(F.trim(generated) == F.trim(original), "unchanged").when(F.contains(F.lower(generated), needle), "true answer still present").when(claim_sentence(original, answer).isNull(), "answer sentence not found").when(F.coalesce(score, F.lit(0.0)) < threshold, "below threshold")


def noise_fill(seeds: DataFrame, pool: DataFrame, ratios: Sequence[float] = NOISE_GRID, seed: int = 202) -> DataFrame:
    """(seed_id, noise_ratio, passage_id, used, truncated, injected, order): the seed's own passages and the pool's in order of place, cut so that injected words make up the ratio; order is a hash order per seed and ratio.

    seeds: (seed_id, passage_id, tokens); pool: (seed_id, place, passage_id, tokens). The budget is s * r / (1 - r) words for s
    own words.
    """
    if any(r >= 1 for r in ratios):
        raise ValueError("a noise ratio must be below 1")
    grid = F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("noise_ratio")
    own = seeds.select("seed_id", "passage_id", F.col("tokens").alias("used"), F.lit(False).alias("truncated"), F.lit(False).alias("injected"), grid)
    size = seeds.groupBy("seed_id").agg(F.sum("tokens").alias("s")).select("seed_id", "s", grid).withColumn("budget", F.col("s") * F.col("noise_ratio") / (1 - F.col("noise_ratio")))
    filled = budget_fill(pool.join(size, "seed_id"), ["seed_id", "noise_ratio"], ["place"], "tokens", "budget")
    filled = filled.select("seed_id", F.when(F.col("truncated"), F.concat(F.col("passage_id"), F.lit("-trunc"))).otherwise(F.col("passage_id")).alias("passage_id"), "used", "truncated", F.lit(True).alias("injected"), "noise_ratio")
    return own.unionByName(filled).withColumn("order", shuffled(seed, "seed_id", "noise_ratio", "passage_id"))


def noise_case_id() -> Column:
    return F.concat(F.lit("noise-"), F.col("seed_id"), F.lit("-r"), F.lpad(F.floor(F.col("noise_ratio") * 100 + 1e-9).cast("string"), 2, "0"))


def pruned(cases: DataFrame, failed: DataFrame) -> DataFrame:
    """Cases without failed ones (case_id); a noise seed goes whole if one of its cases failed."""
    bad_seeds = cases.filter("dimension = 'noise'").join(failed.select("case_id"), "case_id", "left_semi").select("seed_id").distinct().withColumn("dimension", F.lit("noise"))
    return cases.join(failed.select("case_id"), "case_id", "left_anti").join(bad_seeds, ["dimension", "seed_id"], "left_anti")


def manifest(cases: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """One row: counts by dimension and answerability, and the first 16 digits of the SHA-256 of all cases' hashes, sorted and joined: the published digest of a benchmark.

    The digest is of one sequence and so made in one place, but never of a list in memory: the driver reads the sorted hashes
    partition by partition.
    """
    digest = hashlib.sha256()
    for r in cases.select(hash_col).orderBy(hash_col).toLocalIterator(prefetchPartitions=True):
        digest.update((r[0] or "").encode())
    return cases.agg(
        F.count("*").alias("n_cases"), *[F.count_if(F.col("dimension") == d).alias(f"n_{d}") for d in ALLOWED], F.count_if(F.col("answer") != NO_ANSWER).alias("n_answerable"), F.lit(digest.hexdigest()[:16]).alias("content_hash"),
    )
