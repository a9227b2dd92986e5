"""Lexical and dense retrieval within groups of passages, and similarity joins in bands.

Groups are indexed once, by their terms, and passages scored where those of a group meet its query. Similarity joins have a stated set of anchors against all candidates; the anchors are broadcast in blocks of a
stated size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import lower_words
from plumbline.functions.python_udfs import matches
from plumbline.sources.scratch import written

#: Parameters of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
BROADCAST_ANCHORS = 2000
ANCHOR_BYTES = 32 << 20
#: Each range of candidates of a pool is so many times as large as the one before, the first so many times the pool's size.
POOL_GROWTH, POOL_ROUNDS = 4, 4


@dataclass(frozen=True)
class Lexicon:
    """An index of passages: (group, pid, pos, text), and of their groups (group, n, avgdl, floor)."""

    group: str
    pid: str
    pos: str
    passages: DataFrame
    groups: DataFrame

    def scores(self, queries: DataFrame, query: str = "query") -> DataFrame:
        """(group, pid, pos, score) of every passage of the index for its group's query; a repeated query word counts each time.

        A group's passages meet its query once, as texts; what goes on from there are their numbers of words and of the query's words,
        and all further steps find them where they are.
        """
        by = [self.group, self.pid, self.pos]
        words = queries.select(self.group, F.explode(lower_words(F.col(query))).alias("term")).groupBy(self.group, "term").agg(F.count("*").alias("times"))
        asked = words.groupBy(self.group).agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("asked"))  # a query's words
        rows = self.passages.join(asked, self.group, "left").withColumn("w", lower_words(F.col("text__")))
        terms = F.transform("asked", lambda a: a["term"])
        rows = rows.select(*by, "asked", F.size("w").alias("dl"), F.filter("w", lambda x: F.array_contains(terms, x)).alias("hits"))
        tf = F.transform("asked", lambda a: F.struct(a["term"], a["times"], F.size(F.filter("hits", lambda x: x == a["term"])).alias("tf")))
        rows = rows.select(*by, "dl", F.explode_outer(tf).alias("a")).select(*by, "dl", "a.*")
        rows = rows.withColumn("df", F.count_if(F.col("tf") > 0).over(Window.partitionBy(self.group, "term"))).join(self.groups, self.group, "left")
        raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, F.col("floor")).otherwise(raw)
        part = F.when(F.col("tf") > 0, F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
        parts = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("term", part.alias("part"))))).alias("parts"))  # in one order, so that sums of equal texts are equal
        return parts.select(*by, F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))


def lexicon(passages: DataFrame, group: str = "case_no", pid: str = "passage_id", pos: str = "pos", text: str = "text", keep: bool = True, there: bool = False) -> Lexicon:
    """Index passages, of which no two have the same group, pid and pos; a term that most passages of a group have gets EPSILON times the group's mean idf. keep: write what is known of the groups, for more queries than those of one job. there: the table is `dealt` by group already.

    Else texts are dealt by group, once; a group's terms are counted where its texts are. The passages aren't copied: the table given is read by each `scores`.
    """
    rows = passages.select(group, pid, pos, F.col(text).alias("text__"))
    w = lower_words(F.col("text__"))
    # a row of no term stands for the passage itself
    terms = F.concat(F.coalesce(F.array_distinct("w"), F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    texts = rows.select(group, "text__")
    counted = (texts if there else texts.repartition(group)).select(group, w.alias("w")).select(group, F.size("w").alias("dl"), F.explode(terms).alias("term"))
    counted = counted.groupBy(group, "term").agg(F.count("*").alias("df"), F.avg(F.when(F.col("term").isNull(), F.col("dl"))).alias("avgdl"))
    by_df = counted.groupBy(group, F.col("term").isNull().alias("whole"), "df").agg(F.count("*").alias("terms"), F.max("avgdl").alias("avgdl"))
    whole = F.col("whole")
    known = by_df.groupBy(group).agg(F.max(F.when(whole, F.col("df"))).alias("n"), F.max("avgdl").alias("avgdl"), F.array_sort(F.collect_list(F.when(~whole, F.struct("df", "terms")))).alias("dfs"))  # no more than passages
    raw = lambda x: F.log(F.col("n") - x["df"] + 0.5) - F.log(x["df"] + 0.5)
    mean = F.aggregate("dfs", F.lit(0.0), lambda s, x: s + x["terms"] * raw(x)) / F.aggregate("dfs", F.lit(0).cast("long"), lambda s, x: s + x["terms"])
    groups = known.select(group, "n", "avgdl", F.when(F.size("dfs") > 0, EPSILON * mean).alias("floor"))
    return Lexicon(group, pid, pos, rows, written(groups, "groups") if keep else groups)


def bm25(passages: DataFrame, queries: DataFrame, group: str = "case_no", pid: str = "passage_id", pos: str = "pos", text: str = "text", query: str = "query") -> DataFrame:
    """(group, passage, pos, score) of every passage for its group's query, from an index that serves these queries alone."""
    return lexicon(passages, group, pid, pos, text, keep=False).scores(queries, query)


def ranked(scores: DataFrame, group: str, pos: str = "pos") -> DataFrame:
    """Adds rank by score, ties by position."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc(), pos)))


def band_join(anchors: DataFrame, candidates: DataFrame, low: float, high: float, *, k: int | None = None, key: Sequence[str] = ("anchor_id", "anchor"), other: Sequence[str] = ("candidate_id", "vector")) -> DataFrame:
    """(anchor_id, candidate_id, similarity) with low <= cosine <= high, similarities rounded to 12 digits; with k, of each Arrow batch of candidates only the k best of each anchor and their equals, which is all that `nearest` needs.

    anchors is a stated query set. It is sent to the workers in blocks of at most ANCHOR_BYTES, and each block meets all
    candidates in one pass: a product of two matrices for each batch. An anchor doesn't meet the candidate of its own id.
    """
    spark = anchors.sparkSession
    ids = anchors.schema[key[0]].dataType.simpleString()
    asked = anchors.select(F.col(key[0]).alias("id"), F.col(key[1]).cast("array<double>").alias("v"))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-n * 8 * max(width, 1) // ANCHOR_BYTES))
    rows = candidates.select(F.col(other[0]).alias("id"), F.col(other[1]).cast("array<double>").alias("v"))
    made = []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast(own.toArrow())  # at most ANCHOR_BYTES on average
        found = rows.mapInArrow(lambda batches, block=block: matches(batches, block.value, low, high, k), f"anchor_id {ids}, candidate_id {rows.schema['id'].dataType.simpleString()}, similarity double")
        if blocks > 1:  # one block at a time is held by the driver and the workers
            found = written(found, "matches")
            block.destroy()
        made.append(found)
    return reduce(DataFrame.unionAll, made).select(F.col("anchor_id").alias(key[0]), F.col("candidate_id").alias(other[0]), "similarity")


def nearest(pairs: DataFrame, k: int, *tie: Column) -> DataFrame:
    """The k most similar candidates of each anchor; ties in the order given, else by candidate."""
    w = Window.partitionBy("anchor_id").orderBy(F.col("similarity").desc(), *(tie or (F.col("candidate_id"),)))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def safe_pool(answers: DataFrame, candidates: DataFrame, size: int = 20, answer: str = "answer", text: str = "text", pos: str = "pos", bearing: str = "is_answer_bearing") -> DataFrame:
    """(answer, pos, rank): per distinct answer the first `size` candidates by position that bear no answer and don't contain it in any case. answers is a stated query set.

    Hardly any answer is in most candidates, so a few ranges of positions, each POOL_GROWTH times as large as the one before,
    give nearly all answers their pool: the candidates of a range, of a stated number, are broadcast to the answers that still
    lack some. Answers that lack some after POOL_ROUNDS ranges meet all further candidates, in blocks of BROADCAST_ANCHORS.
    """
    asked = answers.select(answer).distinct()
    rows = candidates.filter(~F.col(bearing)).select(pos, text)
    held = lambda a: F.contains(F.col("low"), F.lower(F.trim(a)))
    found, last, take = None, None, POOL_GROWTH * size
    for _ in range(POOL_ROUNDS):
        ahead = rows if last is None else rows.filter(F.col(pos) > last)
        stop = ahead.select(pos).orderBy(pos).limit(take).agg(F.max(pos)).first()[0]
        if stop is None:
            break
        lacking = asked
        if found is not None:
            full = found.groupBy(answer).agg(F.count("*").alias("n")).filter(F.col("n") >= size)
            lacking = asked.join(full, answer, "left_anti")
            if not lacking.take(1):
                break
        block = ahead.filter(F.col(pos) <= stop).select(pos, F.lower(text).alias("low"))
        new = lacking.join(F.broadcast(block), ~held(F.col(answer))).select(answer, pos)  # take candidates
        found = new if found is None else found.unionByName(new)
        last, take = stop, take * POOL_GROWTH
    if found is None:
        return asked.select(answer, F.lit(None).cast(candidates.schema[pos].dataType).alias(pos), F.lit(1).alias("rank")).limit(0)
    w = Window.partitionBy(answer).orderBy(pos)
    full = found.groupBy(answer).agg(F.count("*").alias("n")).filter(F.col("n") >= size)
    rest = asked.join(full, answer, "left_anti")
    ahead = rows.filter(F.col(pos) > last)
    if rest.take(1) and ahead.take(1):
        blocks = max(1, -(-rest.count() // BROADCAST_ANCHORS))
        for b in range(blocks):
            own = F.broadcast(rest if blocks == 1 else rest.filter(F.pmod(F.xxhash64(answer), F.lit(blocks)) == b))
            pairs = ahead.select(pos, F.lower(text).alias("low")).join(own, ~held(F.col(answer))).select(answer, pos)
            found = found.unionByName(pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).drop("rank"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


def ordered_texts(lists: DataFrame, passages: DataFrame, key: str, ids: str, pid: str = "passage_id", text: str = "text") -> DataFrame:
    """(key, context): each list of passage ids as texts in its order, unknown ids left out, joined by blank lines."""
    rows = lists.select(key, F.posexplode(ids).alias("place", pid)).join(passages.select(pid, text), pid)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text))), lambda x: x[text]), "\n\n").alias("context"))
