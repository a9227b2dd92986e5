"""Replaying stored runs: the stored corpus, provenance of responses, misses and their causes, and the casebook made of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.python_udfs import json_hash
from plumbline.functions.text import final_answer, numbered
from plumbline.operators.ranking import first_wins, last_wins
from plumbline.operators.runs import sibling_arms

KEPT = [
    "key", "case_id", "pipeline_class", "retriever", "generator_key", "final_answer", "raw_text", "retrieved_passage_ids", "generator_calls", "steps", "truncated",
]
STEP = "struct<node:string,query:string,subqueries:array<string>,passage_ids:array<string>,output:string>"


def request(prompt: Column, *, system: Column | None = None, max_tokens: int = 1024, temperature: float = 0.0, seed: int | None = None, thinking: Column | bool = False, stop: Sequence[str] = ()) -> Column:
    """What identifies a request to a model: the seven fields, and nothing else."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        prompt.alias("prompt"), (F.lit(None).cast("string") if system is None else system).alias("system"), F.lit(max_tokens).alias("max_tokens"), F.lit(float(temperature)).alias("temperature"), F.lit(seed).cast("long").alias("seed"), lit(thinking).alias("thinking"),
        F.array(*[F.lit(x) for x in stop]).cast("array<string>").alias("stop"),
    )


def request_key(model: Column, family: Column, asked: Column) -> Column:
    """SHA-256 of a request to a model: of its fields, the model and its family as JSON with sorted keys. Two equal requests have one key whatever asked for them."""
    names = ("prompt", "system", "max_tokens", "temperature", "seed", "thinking", "stop")
    body = F.struct(model.alias("model"), family.alias("family"), *[asked[n].alias(n) for n in names])
    return json_hash(F.to_json(body, {"ignoreNullFields": "false"}), F.lit(64))


def put(cache: DataFrame, fresh: DataFrame, order: str = "created_at") -> DataFrame:
    """The cache with fresh responses put in: of a key the newest stays, failed responses are never put."""
    ok = fresh.filter(~F.coalesce(F.col("error") != "", F.lit(False))).select(*cache.columns)
    return last_wins(cache.unionByName(ok), ["key"], order)


def corpus(results: DataFrame, scored: DataFrame, order: str = "line_no") -> DataFrame:
    """The stored rows, last of each key and kept columns only, with the scored row of the same configuration and case as a struct, NULL without one."""
    rows = last_wins(results, ["key"], order)
    own = scored.select(F.concat(F.col("config_id"), F.lit("::"), F.col("case_id")).alias("key"), F.struct(*[c for c in scored.columns]).alias("scored"))
    return rows.select(*[c for c in KEPT if c in rows.columns]).join(own, "key", "left")


def provenance_index(stored: DataFrame) -> DataFrame:
    """(generator_key, sha1) of every text that a run recorded: raw responses and outputs of steps."""
    texts = F.array_union(F.array("raw_text"), F.coalesce(F.transform("steps", lambda s: s["output"]), F.array().cast("array<string>")))
    rows = stored.select("generator_key", F.explode(texts).alias("text")).filter("text <> ''")
    return rows.select("generator_key", F.sha1(F.col("text").cast("binary")).alias("sha1")).distinct()


def verified(stored: DataFrame, replies: DataFrame) -> DataFrame:
    """(key, outcome) of replayed instances, stored rows beside replies (key, text, error).

    miss: the replay found no response. reproduced: it gave the stored text. provenance: another text, but one that the run
    recorded for this generator, and the two retrievers' arms shared a request or nothing tells. Else a violation: of
    reproduction where the arms are known not to share, of provenance where the run never recorded the text.
    """
    index = provenance_index(stored).withColumn("recorded", F.lit(True))
    names = ["key", "case_id", "pipeline_class", "retriever", "generator_key", "raw_text", "retrieved_passage_ids"]
    rows = sibling_arms(stored.select(*names), "retrieved_passage_ids").join(replies.select("key", "text", F.col("error").alias("failure")), "key")
    rows = rows.withColumn("sha1", F.sha1(F.col("text").cast("binary"))).join(index, ["generator_key", "sha1"], "left")
    missed = F.coalesce(F.col("failure") != "", F.lit(False)) | F.col("text").isNull()
    apart = F.coalesce(~F.col("shared"), F.lit(False))
    outcome = F.when(missed, "miss").when(F.col("text") == F.col("raw_text"), "reproduced").when(F.col("recorded").isNull(), "violation: provenance").when(apart, "violation: reproduction").otherwise("provenance")
    return rows.select("key", outcome.alias("outcome"))


def decompose_forks(stored: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, cause) of agentic instances (with request_key of their decomposition): whether the cache serves the decomposition that the instance itself recorded. A fork there explains misses of what follows."""
    own = F.get(F.filter("steps", lambda s: s["node"] == "decompose"), F.lit(0))["output"]
    rows = stored.filter("pipeline_class = 'agentic'").join(cache.select(F.col("key").alias("request_key"), F.col("text").alias("served")), "request_key", "left")
    cause = F.when(F.col("served").isNull(), "not in the cache").when(own.isNull(), "no decomposition recorded").when(F.col("served") == own, "same").otherwise("fork")
    return rows.select("key", cause.alias("cause"))


def pipeline_parameters(configs: DataFrame, generators: DataFrame, controls: dict) -> DataFrame:
    """Configurations with what their pipeline is run with. The reasoning form is the generator's, never the class's; naive ones have none; the output budget is one for all; an unknown generator is an error."""
    rows = configs.join(generators.select("generator_key", F.col("thinking").alias("t"), F.col("cot_prompt").alias("c"), F.lit(True).alias("known")), "generator_key", "left")
    naive = F.col("pipeline_class") == "naive"
    form = lambda c: F.when(~naive, F.coalesce(c, F.lit(False)))
    config = F.when(F.col("known"), F.col("config_id")).otherwise(F.raise_error(F.concat(F.lit("unknown generator "), F.col("generator_key"))).cast("string"))
    return rows.select(
        config.alias("config_id"), form(F.col("t")).alias("thinking"), form(F.col("c")).alias("cot_prompt"), F.lit(int(controls.get("max_output_tokens", 4096))).alias("max_tokens"), F.lit(float(controls.get("temperature", 0.0))).alias("temperature"),
        F.lit(controls.get("seed")).cast("long").alias("seed"), F.when(F.col("pipeline_class") == "agentic", int(controls.get("max_agentic_steps", 5))).alias("max_steps"),
    )


def curated(showcase: DataFrame, extra: DataFrame, ratios: Sequence[str] = ("00", "25", "50", "75", "90")) -> DataFrame:
    """(case_id, why) in narrative order (place): showcase rows (place, kind, target, why) name a case or a noise seed, which stands for its cases of all ratios; extra rows (place, case_id, why) follow. A repeated case keeps its first place."""
    ids = F.when(F.col("kind") == "case", F.array("target")).otherwise(F.array(*[F.concat(F.lit("noise-"), F.col("target"), F.lit(f"-r{r}")) for r in ratios]))
    shown = showcase.select("place", "why", F.posexplode(ids).alias("nth", "case_id"))
    rows = shown.select("case_id", "why", F.struct(F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), "nth").alias("at")).unionByName(extra.select("case_id", "why", F.struct(F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), F.lit(0).alias("nth")).alias("at")))
    return first_wins(rows, ["case_id"], "at")


def casebook(cases: DataFrame, chosen: DataFrame, stored: DataFrame, scored: DataFrame, configs: Sequence[str]) -> DataFrame:
    """A row per chosen case (case_id, why, at) with its arms, in the order of configs: those that are both stored and scored. A chosen case that isn't in the benchmark is an error."""
    order = cases.sparkSession.createDataFrame(list(enumerate(configs)), "n int, config_id string")  # a handful
    made = stored.drop("final_answer", "truncated").join(F.broadcast(order), "config_id").join(scored.select("config_id", "case_id", "final_answer", "category", "answer_correct", "crs_score", "truncated"), ["config_id", "case_id"])
    arm = F.struct("n", "config_id", "pipeline_class", "generator_key", "final_answer", "raw_text", "category", "answer_correct", "crs_score", "truncated")
    arms = made.join(chosen.select("case_id"), "case_id", "left_semi").groupBy("case_id").agg(F.array_sort(F.collect_list(arm)).alias("arms"))  # as many as configs at most
    rows = chosen.join(cases.withColumn("known", F.lit(True)), "case_id", "left").join(arms, "case_id", "left")
    case_id = F.when(F.col("known"), F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("not in the benchmark: "), F.col("case_id"))).cast("string"))
    return rows.withColumn("case_id", case_id).withColumn("arms", F.coalesce("arms", F.array().cast(arms.schema["arms"].dataType))).drop("known")


def contexts(ranked: DataFrame, texts: DataFrame, order: str = "rank") -> DataFrame:
    """(case_id, passage_ids, texts) of ranked passages (case_id, idx, rank), with their texts (case_id, idx, passage_id, text) in order of rank: what a pipeline shows a generator."""
    places = ranked.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", order))).alias("places"))  # the passages of a case
    rows = texts.select("case_id", "idx", "passage_id", "text").join(places, "case_id").withColumn(order, F.try_element_at("places", F.col("idx"))).filter(F.col(order).isNotNull())
    held = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(order, "passage_id", "text"))).alias("p"))
    return held.select("case_id", F.transform("p", lambda x: x["passage_id"]).alias("passage_ids"), F.transform("p", lambda x: x["text"]).alias("texts"))


def single_call_requests(cases: DataFrame, shown: DataFrame, parameters: DataFrame, template: str, reasoning_template: str) -> DataFrame:
    """(key, case_id, config_id, passage_ids, prompt, request) of the one call that naive and reasoning configurations (pipeline_parameters) make for each case.

    Templates have {question} and {passages}; configurations that elicit reasoning by prompt use the second. A reasoning
    configuration must have exactly one form of reasoning: another one is an error.
    """
    rows = cases.select("case_id", "query").join(shown, "case_id").crossJoin(F.broadcast(parameters.filter("max_steps IS NULL")))  # a handful of configurations
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{question}"), F.col("query")), F.lit("{passages}"), numbered(F.col("texts")))
    prompt = F.when(F.coalesce("cot_prompt", F.lit(False)), filled(reasoning_template)).otherwise(filled(template))
    forms = F.col("thinking").cast("int") + F.col("cot_prompt").cast("int")
    config = F.when(forms.isNull() | (forms == 1), F.col("config_id")).otherwise(F.raise_error(F.concat(F.col("config_id"), F.lit(": one form of reasoning is needed"))).cast("string"))
    rows = rows.withColumn("config_id", config).withColumn("prompt", prompt)
    asked = F.struct("prompt", F.lit(None).cast("string").alias("system"), "max_tokens", "temperature", "seed", F.coalesce("thinking", F.lit(False)).alias("thinking"), F.array().cast("array<string>").alias("stop"))
    return rows.select(F.concat(F.col("config_id"), F.lit("::"), F.col("case_id")).alias("key"), "case_id", "config_id", "passage_ids", "prompt", asked.alias("request"))


def replayed(requests: DataFrame, models: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, request_key, text, final_answer, missed) of single calls answered from the cache alone, models being (config_id, model, family). A miss is told, not hidden: text is NULL then."""
    rows = requests.join(F.broadcast(models), "config_id")  # a handful
    rows = rows.withColumn("request_key", request_key(F.col("model"), F.col("family"), F.col("request")))
    found = rows.join(cache.select(F.col("key").alias("request_key"), "text"), "request_key", "left")
    return found.select("key", "request_key", "text", final_answer(F.col("text")).alias("final_answer"), F.col("text").isNull().alias("missed"))
