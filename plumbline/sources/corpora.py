"""Rows of question corpora as seeds: the table or stream of a corpus, however it is fetched, is the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.testbeds import passage
from plumbline.sources.schemas import PASSAGE

#: Words of evidence for a question.
EVIDENCE_TOKENS = 700
#: Share of the evidence budget that the passage with the answer has beside a companion.
ANSWER_SHARE = 0.7
_NONE = f"array<{PASSAGE}>"


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """With a column computed once per row. A filter on a column of a projection is pushed below it and computes it again, in every place in which it stands; a generator's output stays where it is."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _first(items: Column, make, kind: str) -> Column:
    """What is made of the first item of which anything is made; nothing is made of later ones."""
    return F.aggregate(items, F.lit(None).cast(kind), lambda found, x: F.when(found.isNotNull(), found).otherwise(make(x)))


def _counts(rows: DataFrame, *reasons: str) -> DataFrame:
    return rows.agg(F.count("*").alias("seen"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons], F.count_if(F.col("reason").isNull()).alias("kept"))


def _seeds(rows: DataFrame, prefix: str, passages: Column, extras: Column) -> DataFrame:
    kept = rows.filter("reason IS NULL")
    return kept.select(F.concat(F.lit(f"{prefix}-"), F.col("i").cast("string")).alias("seed_id"), F.lit(prefix).alias("source"), F.col("question").alias("query"), "answer", passages.cast(_NONE).alias("passages"), extras.cast(_NONE).alias("extra_passages"))


def _named(prefix: str, tail: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.col("i").cast("string"), F.lit(tail) if isinstance(tail, str) else tail)


def document_seeds(rows: DataFrame, limit: int, evidence_tokens: int = EVIDENCE_TOKENS, windows: int = 16, prefix: str = "nq") -> tuple[DataFrame, DataFrame]:
    """(seeds, counts) of the first `limit` rows (i, question, short_answers, tokens): a window of the document around the first short answer, which bears the answer if its own text does, and as extras the document's windows without it.

    Rows without a short answer, and documents that don't hold it, are counted and left out.
    """
    rows = rows.filter(F.col("i") < limit).withColumns({"answer": F.nullif(F.get("short_answers", F.lit(0)), F.lit("")), "document": F.array_join("tokens", " ")})
    rows = _once(rows, "window", T.answer_window(F.col("document"), F.col("answer"), evidence_tokens))
    rows = rows.withColumn("reason", F.when(F.col("answer").isNull(), "no_short_answer").when(F.col("window").isNull(), "answer_not_in_document"))
    first = F.array(passage(_named(prefix, "-p0"), F.col("window"), T.on_word_boundary(F.col("answer"), F.col("window")), False))
    others = F.transform(T.context_windows(F.col("document"), F.col("answer"), evidence_tokens, windows), lambda w, k: passage(_named(prefix, F.concat(F.lit("-x"), k.cast("string"))), w, False, False))
    return _seeds(rows, prefix, first, others), _counts(rows, "no_short_answer", "answer_not_in_document")


def context_seeds(rows: DataFrame, limit: int, evidence_tokens: int = EVIDENCE_TOKENS, windows: int = 8, prefix: str = "tqa") -> tuple[DataFrame, DataFrame]:
    """(seeds, counts) of the first `limit` rows (i, question, answer, contexts): a window around the answer in the first context that holds it, then the beginning of the first other context that doesn't state it, and as extras all contexts' windows without it.

    Rows without an answer or contexts, and such whose contexts don't hold it, are counted and left out.
    """
    budget = int(evidence_tokens * ANSWER_SHARE)
    rows = rows.filter(F.col("i") < limit).withColumns({"answer": F.nullif("answer", F.lit("")), "contexts": F.coalesce("contexts", F.array().cast("array<string>"))})
    numbered = F.transform("contexts", lambda c, j: F.struct(j.alias("j"), c.alias("c")))
    hit = lambda x: T.let(T.answer_window(x["c"], F.col("answer"), budget), lambda w: F.when(w.isNotNull(), F.struct(x["j"].alias("j"), w.alias("w"))))
    rows = _once(rows, "hit", _first(numbered, hit, "struct<j:int,w:string>"))
    rows = rows.withColumn("reason", F.when(F.col("answer").isNull() | (F.size("contexts") == 0), "no_answer_or_context").when(F.col("hit").isNull(), "answer_not_in_context"))
    other = lambda x: T.let(F.array_join(T.first_words(x["c"], evidence_tokens - budget), " "), lambda w: F.when((w != "") & ~T.states_answer(w, F.col("answer")), w))
    rows = rows.withColumn("companion", _first(numbered, lambda x: F.when(x["j"] != F.col("hit.j"), other(x)), "string"))
    # word boundaries need a value of the row, not of a lambda
    first = passage(_named(prefix, "-p0"), F.col("hit.w"), T.on_word_boundary(F.col("answer"), F.col("hit.w")), False)
    second = passage(_named(prefix, "-p1"), F.col("companion"), False, False)
    passages = F.when(F.col("companion").isNotNull(), F.array(first, second)).otherwise(F.array(first))
    each = F.transform("contexts", lambda c, j: F.transform(T.context_windows(c, F.col("answer"), evidence_tokens, windows), lambda w, k: passage(_named(prefix, F.concat(F.lit("-x"), j.cast("string"), F.lit("_"), k.cast("string"))), w, False, False)))
    return _seeds(rows, prefix, passages, F.flatten(each)), _counts(rows, "no_answer_or_context", "answer_not_in_context")
