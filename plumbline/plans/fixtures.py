"""Deterministic projections of the driver's tables onto the evaluation data model.

Each fixture is a source table and layers of column expressions in the SQL that Spark and DuckDB share: Spark applies them by
selectExpr, an oracle reads them as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTEXT_NOISE = [0.0, 0.25, 0.5, 0.75, 0.9]

FIXTURES: dict[str, tuple[str, list[dict[str, str]], list[str]]] = {
    "scored": ("events", [
        {"cfg": "cast(event_id % 12 as int)", "case_no": "cast(floor(event_id / 12) as bigint)"},
        {"slot": "cast(case_no % 7 as int)", "g": "cast(floor(case_no / 7) as bigint)",
         "pipeline_class": "case when cfg < 4 then 'naive' when cfg < 8 then 'reasoning' else 'agentic' end",
         "retriever": "case when cfg % 4 < 2 then 'bm25' else 'dpr' end",
         "generator_key": "concat(case when cfg < 4 then 'standard_' else 'reasoning_' end, cast(1 + cfg % 2 as string))"},
        {"dimension": "case when slot = 0 then 'refusal' when slot = 1 then 'conflict' else 'noise' end",
         "noise_ratio": "case slot when 2 then 0.0e0 when 3 then 0.25e0 when 4 then 0.5e0 when 5 then 0.75e0 when 6 then 0.9e0 end",
         "seed_id": "concat(case when g % 2 = 0 then 'nq-' else 'tqa-' end, cast(g as string))",
         "is_answerable": "case when slot = 0 then floor(g / 2) % 2 = 0 else true end",
         "config_id": "concat(pipeline_class, '|', retriever, '|', generator_key)"},
        {"case_id": "concat(dimension, '-', seed_id, '-', cast(slot as string))",
         "category": "case when event_type = 'error' or (not is_answerable and event_type in ('view', 'click', 'purchase')) then 'refusal' when event_type = 'signup' and value < 10 then 'unparseable' else 'answer' end"},
        {"answer_correct": "case when category = 'answer' and is_answerable then value < 60 - 35 * coalesce(noise_ratio, 0e0) + 4 * floor(cfg / 4) end",
         "crs_score": "case when dimension = 'conflict' and not (event_type = 'signup' and value < 2) then cast(least(4, floor(value / 40)) as int) end",
         "truncated": "event_type = 'click' and value < 3"},
        {"final_answer": "case when category = 'unparseable' or truncated then null when category = 'refusal' then 'INSUFFICIENT EVIDENCE' else 'an answer' end"},
    ], ["event_id", "config_id", "pipeline_class", "retriever", "generator_key", "case_id", "seed_id", "dimension", "category", "answer_correct", "is_answerable", "noise_ratio", "crs_score", "final_answer", "truncated", "value"]),
    "results": ("events", [
        {"cfg": "cast(event_id % 12 as int)", "case_no": "cast(floor(event_id / 12) as bigint)", "line_no": "event_id", "pick": "cast(event_id % 7 as int)"},
        {"slot": "cast(case_no % 7 as int)", "g": "cast(floor(case_no / 7) as bigint)",
         "pipeline_class": "case when cfg < 4 then 'naive' when cfg < 8 then 'reasoning' else 'agentic' end",
         "retriever": "case when cfg % 4 < 2 then 'bm25' else 'dpr' end",
         "generator_key": "concat(case when cfg < 4 then 'standard_' else 'reasoning_' end, cast(1 + cfg % 2 as string))"},
        {"dimension": "case when slot = 0 then 'refusal' when slot = 1 then 'conflict' else 'noise' end",
         "seed_id": "concat(case when g % 2 = 0 then 'nq-' else 'tqa-' end, cast(g as string))",
         "config_id": "concat(pipeline_class, '|', retriever, '|', generator_key)"},
        {"case_id": "case when event_id % 97 = 0 then 'gone' else concat(dimension, '-', seed_id, '-', cast(slot as string)) end"},
        {"key": "concat(config_id, '::', case_id)",
         "final_answer": "case pick when 0 then null when 1 then 'INSUFFICIENT EVIDENCE' when 2 then 'It was Paris, I think' when 3 then 'completed in 1889' when 4 then '  ' when 5 then 'no mention of it anywhere in these passages, but I would guess that the year was eighteen eighty nine or so' else 'the Bogota' end",
         "raw_text": "case when pick > 0 then 'text' when event_id % 4 = 0 then 'INSUFFICIENT EVIDENCE' when event_id % 4 = 1 then '<Tina Turner></final_answer>' when event_id % 4 = 2 then 'plain prose with no mark' else ' ' end",
         "error": "case when event_type = 'error' then case when event_id % 2 = 0 then 'timeout' else '' end end",
         "truncated": "event_type = 'click' and value < 3"},
    ], ["line_no", "key", "config_id", "pipeline_class", "retriever", "generator_key", "case_id", "dimension", "seed_id", "final_answer", "raw_text", "error", "truncated", "value"]),
    "case_rows": ("events", [
        {"case_no": "cast(floor(event_id / 12) as bigint)"},
        {"slot": "cast(case_no % 7 as int)", "g": "cast(floor(case_no / 7) as bigint)"},
        {"dimension": "case when slot = 0 then 'refusal' when slot = 1 then 'conflict' else 'noise' end",
         "noise_ratio": "case slot when 2 then 0.0e0 when 3 then 0.25e0 when 4 then 0.5e0 when 5 then 0.75e0 when 6 then 0.9e0 end",
         "seed_id": "concat(case when g % 2 = 0 then 'nq-' else 'tqa-' end, cast(g as string))"},
        {"case_id": "concat(dimension, '-', seed_id, '-', cast(slot as string))",
         "answer": "case when slot = 0 and floor(g / 2) % 2 = 1 then '<<NO_ANSWER_SUPPORTED>>' when g % 4 = 0 then 'Paris' when g % 4 = 1 then '1889' when g % 4 = 2 then 'Bogotá' else 'King George I' end"},
        {"query": "concat('about ', case_id)"},
    ], ["case_id", "query", "answer", "dimension", "noise_ratio", "seed_id", "g", "slot"]),
    "log": ("events", [
        {"line_no": "event_id", "key": "concat('naive|bm25|standard_', cast(1 + event_id % 2 as string), '::case-', cast(cast(floor(event_id / 4) as bigint) as string))", "error": "case when event_type = 'error' then 'timeout' end", "latency_s": "value"},
    ], ["line_no", "key", "error", "latency_s"]),
    "samples": ("events", [
        {"arm": "event_type", "latency_s": "value", "prompt_tokens": "cast(200 + user_id * 7 as bigint)", "completion_tokens": "cast(20 + user_id as bigint)", "ok": "event_type <> 'error' and event_id % 17 <> 0"},
    ], ["arm", "latency_s", "prompt_tokens", "completion_tokens", "ok"]),
    "raters": ("(select doc_id, quality, n_chars, lang from labels join documents using (doc_id))", [
        {"item": "doc_id", "rater_a": "cast(quality as int)", "rater_b": "cast(n_chars >= 300 as int)", "rater_c": "cast(n_chars >= 1489 as int)", "grp": "lang"},
    ], ["item", "rater_a", "rater_b", "rater_c", "grp"]),
    "passages": ("documents", [
        {"passage_id": "concat('d', cast(doc_id as string))", "pos": "doc_id", "is_injected": "doc_id % 3 > 0", "case_no": "cast(floor(doc_id / 10) as bigint)"},
    ], ["case_no", "pos", "passage_id", "text", "is_injected", "lang", "n_chars"]),
    "vectors": ("embeddings", [{"seed": "vec_id % 20 = 0"}], ["vec_id", "embedding", "seed"]),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, layers, keep = FIXTURES[name]
    if source.startswith("("):
        labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
        df = labels.join(docs, "doc_id").select("doc_id", "quality", "n_chars", "lang")
    else:
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    for layer in layers:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in layer.items() if n not in df.columns])
    return df.select(*keep)


def _sql(name: str) -> str:
    source, layers, keep = FIXTURES[name]
    sql = source if not source.startswith("(") else f"{source} base"
    for i, layer in enumerate(layers):
        sql = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {sql}) l{i}"
    return f"{name} AS (SELECT {', '.join(keep)} FROM {sql})"


def having(*names: str, then: str) -> str:
    """DuckDB SQL with the named fixtures in scope."""
    return "WITH " + ",\n".join(_sql(n) for n in names) + "\n" + then
