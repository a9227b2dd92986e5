"""Proxy and judge scores beside the purpose-built ones: joins on instances, live judge scores, blind rating sheets, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.vector import strict_cosine
from plumbline.operators.ranking import last_wins, spearman
from plumbline.operators.validity import PROXIES, failure, ratio_of, unpivoted


def instance_key():
    return F.concat(F.col("config_id"), F.lit("::"), F.col("case_id"))


def judge_rows_joined(ratios: DataFrame, scored: DataFrame) -> DataFrame:
    """Proxy scores (key, dimension, metrics) beside the scored row of their instance; instances that aren't scored are left out. Adds failed, the purpose-built verdict."""
    base = scored.withColumn("key", instance_key()).withColumn("failed", failure())
    return ratios.join(base.select("key", "crs_score", "failed", "category", "answer_correct", "is_answerable"), "key")


def correlations(joined: DataFrame, proxies: Sequence[str] = PROXIES) -> DataFrame:
    """(dimension, metric, n, rho): rank correlation of each proxy with the rubric score in conflict, else with success (1) or failure (0)."""
    target = F.when(F.col("dimension") == "conflict", F.col("crs_score").cast("double")).otherwise((~F.col("failed")).cast("double"))
    return spearman(unpivoted(joined.withColumn("target", target), ["dimension", "target"], proxies), "score", "target", ["dimension", "metric"])


def instance_contexts(keys: DataFrame, results: DataFrame, cases: DataFrame, order: str = "line_no") -> DataFrame:
    """(key, query, passage_ids) of the logged instances among keys: the last row of a key, an empty query for unknown cases, no ids for NULL ones."""
    own = last_wins(results.join(keys.select("key"), "key", "left_semi"), ["key"], order)
    ids = F.coalesce("retrieved_passage_ids", F.array().cast("array<string>")).alias("passage_ids")
    return own.join(cases.select("case_id", "query"), "case_id", "left").select("key", F.coalesce("query", F.lit("")).alias("query"), ids)


def faithfulness_by_class(ratios: DataFrame) -> DataFrame:
    """(pipeline_class, faithfulness): mean over conflict instances where it is defined; classes without one are left out."""
    rows = ratios.filter("dimension = 'conflict' AND faithfulness IS NOT NULL")
    return rows.groupBy("pipeline_class").agg(F.avg("faithfulness").alias("faithfulness"))


def rating_sheet(sample: DataFrame) -> DataFrame:
    """What a blind rater fills in, for a sample numbered by item: no judge's verdict anywhere."""
    return sample.select("item", "case_id", "config_id", F.lit("").alias("your_score_0_to_4"), F.lit("").alias("notes"))


def judge_sheet(sample: DataFrame) -> DataFrame:
    return sample.select("item", "case_id", "config_id", F.col("crs_score").alias("judge_score"))


def numbered(sample: DataFrame, *order: str) -> DataFrame:
    """Adds item from 1 in the given order. The sample is of a stated, small size."""
    return sample.withColumn("item", F.row_number().over(Window.orderBy(*order)))


def live_judge_pairs(ratings: DataFrame, snapshot: DataFrame, scored: DataFrame) -> DataFrame:
    """(item, human, judge, stale) for every item of the snapshot (judge_sheet) that is still scored.

    judge is the current score of the item's configuration and case, not the snapshot's; stale tells that the two differ.
    human is NULL where the rating sheet is blank. Items whose instance is gone are left out.
    """
    text = F.trim(F.coalesce(F.col("your_score_0_to_4").cast("string"), F.lit("")))
    human = ratings.select("item", F.when(text != "", text.try_cast("int")).alias("human"))
    live = scored.filter("crs_score IS NOT NULL").groupBy("config_id", "case_id").agg(F.max("crs_score").alias("judge"))
    rows = snapshot.join(live, ["config_id", "case_id"]).join(human, "item", "left")
    return rows.select("item", "human", "judge", (F.col("judge") != F.col("judge_score")).alias("stale"))


def judge_counts(pairs: DataFrame) -> DataFrame:
    """One row: items with a judge's score, rated ones, unrated ones (excluded, never defaulted), and stale ones."""
    return pairs.agg(F.count("*").alias("n_judged"), F.count("human").alias("n_rated"), (F.count("*") - F.count("human")).alias("n_unrated"), F.count_if("stale").alias("n_stale"))


def rank_within_metric(values: DataFrame, metric: str = "metric", value: str = "value", order: str = "place") -> DataFrame:
    """Adds rank, 1 for the greatest value of a metric; ties in the order given."""
    return values.withColumn("rank", F.row_number().over(Window.partitionBy(metric).orderBy(F.col(value).desc(), order)))


def proxy_scores(replies: DataFrame) -> DataFrame:
    """(key, n_statements, n_supported, faithfulness, n_questions, answer_relevance, n_sentences, n_relevant, context_relevance) of an answer's judge replies.

    Faithfulness: statements of statements_reply that verdict_reply supports; NULL without statements (an abstention asserts
    nothing: 0 of 0 isn't 0) or without a verdict for each. Answer relevance: mean cosine of query_vector and question_vectors,
    of as many as questions_reply has; a blank answer has no questions. Context relevance: sentences of context that
    selection_reply names. A reply that failed is NULL, and so is what needs it.
    """
    none = F.array().cast("array<string>")
    rows = replies.withColumns({
        "statements": F.coalesce(T.statements(F.col("statements_reply")), none),
        "questions": F.when(T.strip(F.coalesce("answer", F.lit(""))) == "", none).otherwise(F.coalesce(T.generated_questions(F.col("questions_reply")), none)),
        "sentences": F.coalesce(T.sentences(F.col("context")), none),
    })
    rows = rows.withColumns({"verdicts": F.when(F.size("statements") > 0, T.verdicts(F.col("verdict_reply"), F.size("statements"))), "selected": F.when(F.size("sentences") > 0, T.selected_sentences(F.col("selection_reply"), F.size("sentences")))})
    likeness = F.transform(F.slice("question_vectors", F.lit(1), F.size("questions")), lambda v: strict_cosine(F.col("query_vector"), v))
    supported = F.size(F.filter("verdicts", lambda v: v))
    return rows.select(
        "key", F.size("statements").alias("n_statements"), supported.alias("n_supported"), ratio_of(supported, F.size("verdicts")).alias("faithfulness"), F.size("questions").alias("n_questions"),
        F.when(F.size("questions") > 0, F.aggregate(likeness, F.lit(0.0), lambda s, x: s + x) / F.size("questions")).alias("answer_relevance"),
        F.size("sentences").alias("n_sentences"), F.size("selected").alias("n_relevant"), ratio_of(F.size("selected"), F.size("sentences")).alias("context_relevance"),
    )
