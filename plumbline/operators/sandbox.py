"""The sandbox of a case: what retrieval for it can reach, its own passages and then a pool of distractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import NO_ANSWER
from plumbline.operators.ranking import top_k
from plumbline.operators.retrieval import Lexicon, lexicon


def built(cases: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """(case_id, idx, is_case, passage_id, text, is_answer_bearing, is_injected): a case's passages in their order, then those of its pool (case_id, place, passage...).

    A pool passage that bears the answer defeats the perturbation: reading it is an error. A case without pool has its own
    passages only; pool rows of unknown cases are left out.
    """
    names = ["passage_id", "text", "is_answer_bearing", "is_injected"]
    own = cases.select("case_id", F.posexplode("passages").alias("idx", "p")).select("case_id", F.col("idx").cast("long"), F.lit(True).alias("is_case"), *[F.col(f"p.{n}").alias(n) for n in names])
    if pool is None:
        return own
    leak = F.raise_error(F.concat(F.col("case_id"), F.lit(": the distractor pool has an answer-bearing passage, "), F.col("passage_id"))).cast("string")
    sizes = cases.select("case_id", F.size("passages").alias("n"))
    extra = pool.withColumn("passage_id", F.when(F.coalesce("is_answer_bearing", F.lit(False)), leak).otherwise(F.col("passage_id"))).join(sizes, "case_id")
    place = F.row_number().over(_by_case("place", "passage_id")) - 1
    return own.unionByName(extra.select("case_id", (F.col("n") + place).cast("long").alias("idx"), F.lit(False).alias("is_case"), *names))


def _by_case(*order):
    return Window.partitionBy("case_id").orderBy(*order)


def leaks(sandbox: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, passage_id) of answer-bearing passages that an unanswerable case can reach."""
    closed = cases.filter(F.col("answer") == NO_ANSWER).select("case_id")
    return sandbox.filter("is_answer_bearing").join(closed, "case_id", "left_semi").select("case_id", "passage_id")


def asserted(sandbox: DataFrame, cases: DataFrame) -> DataFrame:
    """The sandbox; reading a passage that leaks an unanswerable case's answer is an error."""
    closed = cases.filter(F.col("answer") == NO_ANSWER).select("case_id", F.lit(True).alias("closed"))
    rows = sandbox.join(closed, "case_id", "left")
    bad = F.coalesce(F.col("closed") & F.col("is_answer_bearing"), F.lit(False))
    say = F.raise_error(F.concat(F.col("case_id"), F.lit(": an unanswerable case reaches "), F.col("passage_id"))).cast("string")
    return rows.withColumn("passage_id", F.when(bad, say).otherwise(F.col("passage_id"))).select(*sandbox.columns)


def indexed(sandbox: DataFrame, there: bool = False) -> Lexicon:
    """The index of a sandbox, for as many queries as come. A passage may stand in a sandbox twice: its place, not its id, is what is scored. there: the sandbox is `dealt` by case."""
    return lexicon(sandbox.select("case_id", "idx", F.struct("passage_id", "is_case").alias("p"), "text"), "case_id", "idx", "p", there=there)


def scores(sandbox: DataFrame, cases: DataFrame, index: Lexicon | None = None) -> DataFrame:
    """(case_id, passage_id, idx, is_case, score): lexical scores over the whole sandbox, so that both rankings below share their term statistics. index: of this sandbox, if it is there already."""
    made = (index or indexed(sandbox)).scores(cases.select("case_id", "query"))
    return made.select("case_id", "idx", "p.passage_id", "p.is_case", "score")


def retrieved(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best of the whole sandbox, ties by place, with rank from 1: what an agent retrieves again."""
    return top_k(scored, ["case_id"], [F.col("score").desc(), F.col("idx")], k)


def ranked_case_passages(scored: DataFrame) -> DataFrame:
    """All of the case's own passages in order of score, ties by place, with rank from 1: what every pipeline sees first, its membership unchanged."""
    return scored.filter("is_case").withColumn("rank", F.row_number().over(_by_case(F.col("score").desc(), "idx")))
