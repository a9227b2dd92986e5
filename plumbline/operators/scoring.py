"""From raw result rows to scored responses: errors set apart, cases joined, answers recovered, classified and graded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.text import NO_ANSWER
from plumbline.operators.ranking import last_wins

SCORED = [
    "config_id", "case_id", "dimension", "category", "answer_correct", "is_answerable", "noise_ratio", "final_answer", "classification_method", "exact_match", "token_f1", "seed_id", "truncated", "recovery_method",
]


def is_error() -> Column:
    """An error is a text that isn't empty."""
    return F.coalesce(F.col("error") != "", F.lit(False))


def newest_results(log: DataFrame, order: str = "line_no") -> DataFrame:
    """The last row of each key; rows of older logs without key have it made of configuration and case."""
    key = F.coalesce("key", F.concat(F.col("config_id"), F.lit("::"), F.col("case_id")))
    return last_wins(log.withColumn("key", key), ["key"], order)


def result_counts(results: DataFrame) -> DataFrame:
    """One row: n_rows that are scored, n_errored that aren't, and n_truncated before an answer, of both."""
    return results.agg(F.count_if(~is_error()).alias("n_rows"), F.count_if(is_error()).alias("n_errored"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("n_truncated"))


def without_errors(results: DataFrame) -> DataFrame:
    return results.filter(~is_error())


def with_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results beside their case's query, answer and kind; results of unknown cases are left out. The case's columns win over the result's of the same name."""
    known = cases.select("case_id", "query", F.col("answer").alias("gold"), "dimension", "noise_ratio", "seed_id", (F.col("answer") != NO_ANSWER).alias("is_answerable"))
    return results.drop(*[c for c in known.columns if c != "case_id"]).join(known, "case_id")


def recovered(rows: DataFrame) -> DataFrame:
    """final_answer taken from the raw text where the field was missing, recovery_method, and whether a response that says something couldn't be read (unrecoverable)."""
    rows = rows.withColumn("found", F.when(F.col("final_answer").isNull(), T.recover(F.col("raw_text"))))
    missing = F.col("final_answer").isNull()
    return rows.withColumns({
        "recovery_method": F.col("found.method"), "unrecoverable": missing & F.col("found.method").isNull() & (T.strip(F.coalesce("raw_text", F.lit(""))) != ""),
        "final_answer": F.coalesce("final_answer", F.col("found.answer")),
    }).drop("found")


def recovery_counts(rows: DataFrame) -> DataFrame:
    """(recovery_method, generator_key, n): by method and generator, by method, and in all; rows that nothing was recovered of don't count."""
    kept = rows.filter("recovery_method IS NOT NULL")
    return kept.groupingSets([["recovery_method", "generator_key"], ["recovery_method"], []], "recovery_method", "generator_key").agg(F.count("*").alias("n"))


def fallback_requests(rows: DataFrame) -> DataFrame:
    """(key, query, field) that the rules aren't sure of: what a model is asked about, each once."""
    unsure = ~T.classify_field(F.col("final_answer")).getField("confident")
    return rows.filter(unsure).select("key", "query", F.coalesce("final_answer", F.lit("")).alias("field")).distinct()


def classified(rows: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Adds category, classification_method and classification_warning.

    The rules decide where they are sure (method rule). Elsewhere a model's reply (key, text, error) does, if it names a label
    and is no error (llm_fallback); without one the rules' verdict stays, and says so (rule_unconfident_no_fallback, with the
    reason). Only rows that the rules aren't sure of meet the replies.
    """
    rows = rows.withColumn("verdict", T.classify_field(F.col("final_answer")))
    sure = F.col("verdict.confident")
    if replies is None:
        label, why = F.lit(None).cast("string"), F.lit("no fallback")
    else:
        asked = replies.select(F.col("key").alias("asked"), F.col("text").alias("reply"), F.coalesce(F.col("error") != "", F.lit(False)).alias("failed"))
        rows = rows.join(asked, (F.col("key") == F.col("asked")) & ~sure, "left")
        label = F.when(~F.col("failed"), T.reply_label(F.col("reply")))
        why = F.when(F.col("asked").isNull(), "no fallback").when(F.col("failed"), "fallback failed").otherwise("no usable label")
    rows = rows.withColumn("label", label).withColumn("why", why)
    rows = rows.withColumns({
        "category": F.when(~sure, F.coalesce("label", F.col("verdict.category"))).otherwise(F.col("verdict.category")),
        "classification_method": F.when(sure, "rule").when(F.col("label").isNotNull(), "llm_fallback").otherwise("rule_unconfident_no_fallback"),
        "classification_warning": F.when(~sure & F.col("label").isNull(), F.col("why")),
    })
    return rows.drop("verdict", "label", "why", "asked", "reply", "failed")


def graded(rows: DataFrame) -> DataFrame:
    """Adds exact_match, token_f1 and answer_correct of committed answers to cases that have one; NULL elsewhere."""
    counts = (F.col("category") == "answer") & (F.col("gold") != NO_ANSWER)
    said, gold = F.coalesce("final_answer", F.lit("")), F.col("gold")
    exact = T.exact_match(said, gold)
    return rows.withColumns({"exact_match": F.when(counts, exact), "token_f1": F.when(counts, T.token_f1(said, gold)), "answer_correct": F.when(counts, exact | T.contains_answer(said, gold))})


def scored(results: DataFrame, cases: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """The scored rows of newest results: no errors, known cases only. Truncation and recovery travel with them for the analysis."""
    rows = graded(classified(recovered(with_cases(without_errors(results), cases)), replies))
    return rows.withColumn("truncated", F.coalesce("truncated", F.lit(False))).select(*SCORED)


def provider_errors(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Scored rows of failed results, where they are to count: unparseable, graded as nothing."""
    rows = with_cases(results.filter(is_error()), cases)
    none = lambda kind: F.lit(None).cast(kind)
    made = {"category": F.lit("unparseable"), "classification_method": F.lit("provider_error"), "final_answer": none("string"), "answer_correct": none("boolean"), "exact_match": none("boolean"), "token_f1": none("double"), "recovery_method": none("string")}
    return rows.withColumns(made | {"truncated": F.coalesce("truncated", F.lit(False))}).select(*SCORED)


def method_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("classification_method").agg(F.count("*").alias("n"))


def hit_output_cap(responses: Column | str = "responses") -> Column:
    """Whether any response (an array of structs with meta, a map) stopped for want of output budget; NULL responses and such without meta didn't."""
    return F.coalesce(F.exists(responses, lambda r: F.coalesce(F.try_element_at(r["meta"], F.lit("finish_reason")) == "length", F.lit(False))), F.lit(False))


def result_record(rows: DataFrame) -> DataFrame:
    """Pipeline results as they are logged: lists that are NULL as empty ones, and n_steps."""
    lists = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("retrieved_passage_ids", "steps", "warnings")}
    order = [
        "case_id", "pipeline_class", "final_answer", "raw_text", "reasoning_trace", "retrieved_passage_ids", "generator_calls", "prompt_tokens", "completion_tokens", "n_steps", "steps", "warnings", "truncated", "error",
    ]
    return rows.withColumns(lists).withColumn("n_steps", F.size("steps")).select(*order)
