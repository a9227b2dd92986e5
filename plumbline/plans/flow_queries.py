"""Flows over raw rows: scoring a result log, the sandbox of a case, proxy and judge scores beside it; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import agents, judging, sandbox, scoring, validity
from plumbline.plans.fixtures import fixture, having
from plumbline.plans.text_queries import _NORM, _WORDS, q
from plumbline.sources.scratch import dealt, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def results(s, d):
    return fixture(s, d, "results")


def cases(s, d):
    return fixture(s, d, "case_rows").drop("g", "slot").distinct()


def replies(s, d):
    """A model's replies to what the rules weren't sure of: labels, useless ones and errors."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("line_no"))
    said = F.when(F.col("line_no") % 3 == 0, "REFUSAL").when(F.col("line_no") % 3 == 1, "an ANSWER").otherwise("dunno")
    keys = scoring.newest_results(results(s, d)).select("line_no", "key")
    return keys.join(e, "line_no").filter("line_no % 11 > 0").select("key", said.alias("text"), F.when(F.col("line_no") % 5 == 0, "timeout").alias("error"))


def scored(s, d):
    return scoring.scored(scoring.newest_results(results(s, d)), cases(s, d), replies(s, d))


# --- the SQL of the flow, step by step

_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line_no DESC) AS rn FROM results) WHERE rn = 1)"
_QA = "qa AS (SELECT DISTINCT case_id, query, answer AS gold, dimension, noise_ratio, seed_id, answer <> '<<NO_ANSWER_SUPPORTED>>' AS is_answerable FROM case_rows)"
_JOINED = """joined AS (
  SELECT n.line_no, n.key, n.config_id, n.generator_key, n.case_id, n.final_answer AS said, trim(coalesce(n.raw_text, '')) AS raw, n.truncated, qa.query, qa.gold, qa.dimension, qa.noise_ratio, qa.seed_id, qa.is_answerable
  FROM newest n JOIN qa USING (case_id) WHERE coalesce(n.error, '') = ''
)"""
_READ = """marked AS (
  SELECT *, trim(regexp_extract(raw, '(?i)^<([^<>]{1,120})></final_answer>\\s*$', 1)) AS inner_text FROM joined
), named AS (
  SELECT *, CASE WHEN said IS NOT NULL THEN NULL
    WHEN regexp_matches(raw, '(?is)^[ .<>]*INSUFFICIENT EVIDENCE[ .<>]*$') THEN 'bare_sentinel'
    WHEN regexp_matches(raw, '(?i)(?:^|\\n|:)\\s*<?\\s*INSUFFICIENT EVIDENCE\\s*>?\\s*[.]?\\s*$') THEN 'trailing_sentinel'
    WHEN inner_text <> '' AND lower(inner_text) <> 'final_answer' THEN 'malformed_open_tag' END AS recovery_method FROM marked
), read AS (
  SELECT *, CASE WHEN said IS NOT NULL THEN said WHEN recovery_method IN ('bare_sentinel', 'trailing_sentinel') THEN 'INSUFFICIENT EVIDENCE' WHEN recovery_method IS NOT NULL THEN inner_text END AS final_answer,
    said IS NULL AND recovery_method IS NULL AND raw <> '' AS unrecoverable FROM named
)"""
_ABSTAIN = "regexp_matches(trim(final_answer), " + q("(?i)" + "|".join(f"(?:{p})" for p in T.ABSTENTIONS)) + ")"
_RULES = f"""ruled AS (
  SELECT *, CASE WHEN final_answer IS NULL OR trim(final_answer) = '' THEN 'unparseable' WHEN {_ABSTAIN} THEN 'refusal' ELSE 'answer' END AS by_rule,
    final_answer IS NULL OR trim(final_answer) = '' OR NOT {_ABSTAIN} OR len({_WORDS('trim(final_answer)')}) <= {T.SHORT_FIELD} AS sure FROM read
)"""
_REPLIES = "replies AS (SELECT key, CASE line_no % 3 WHEN 0 THEN 'refusal' WHEN 1 THEN 'answer' END AS label, line_no % 5 = 0 AS failed FROM newest WHERE line_no % 11 > 0)"
_CLASSIFIED = """classified AS (
  SELECT r.*, CASE WHEN sure OR failed OR label IS NULL THEN by_rule ELSE label END AS category,
    CASE WHEN sure THEN 'rule' WHEN NOT failed AND label IS NOT NULL THEN 'llm_fallback' ELSE 'rule_unconfident_no_fallback' END AS classification_method,
    CASE WHEN sure OR (NOT failed AND label IS NOT NULL) THEN NULL WHEN p.key IS NULL THEN 'no fallback' WHEN failed THEN 'fallback failed' ELSE 'no usable label' END AS classification_warning
  FROM ruled r LEFT JOIN replies p USING (key)
)"""
_EDGE = "[^\\p{L}\\p{N}_]"
_GRADED = f"""normal AS (SELECT *, {_NORM("coalesce(final_answer, '')")} AS p, {_NORM('gold')} AS g, category = 'answer' AND gold <> '<<NO_ANSWER_SUPPORTED>>' AS counts FROM classified
), worded AS (SELECT *, {_WORDS('p')} AS pw, {_WORDS('g')} AS gw, g <> '' AND regexp_matches(strip_accents(p), '(^|{_EDGE})' || regexp_escape(strip_accents(g)) || '($|{_EDGE})') AS held FROM normal
), graded AS (
  SELECT *, CASE WHEN counts THEN p = g END AS exact_match, CASE WHEN counts THEN p = g OR held END AS answer_correct,
    CASE WHEN NOT counts THEN NULL WHEN len(pw) = 0 OR len(gw) = 0 THEN (len(pw) = 0 AND len(gw) = 0)::int::double
      ELSE 2.0e0 * list_sum(list_transform(list_distinct(pw), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(gw, lambda y: y = x))))) / (len(pw) + len(gw)) END AS token_f1 FROM worded
)"""


def flow(*ctes: str, then: str) -> str:
    return having("results", "case_rows", then="").rstrip() + ",\n" + ",\n".join(ctes) + "\n" + then


_ALL = (_NEWEST, _QA, _JOINED, _READ, _RULES, _REPLIES, _CLASSIFIED, _GRADED)
_COLUMNS = ", ".join(scoring.SCORED)

register("results_with_cases", flow(_NEWEST, _QA, _JOINED, then="SELECT key, query, gold, dimension, noise_ratio, seed_id, is_answerable FROM joined"))(
    lambda s, d: scoring.with_cases(scoring.without_errors(scoring.newest_results(results(s, d))), cases(s, d)).select("key", "query", "gold", "dimension", "noise_ratio", "seed_id", "is_answerable"))
register("errors_excluded", flow(_NEWEST, then="SELECT count(*) FILTER (coalesce(error, '') = '') AS n_rows, count(*) FILTER (coalesce(error, '') <> '') AS n_errored, count(*) FILTER (truncated) AS n_truncated FROM newest"))(
    lambda s, d: scoring.result_counts(scoring.newest_results(results(s, d))))
register("scored_results", flow(*_ALL, then=f"SELECT {_COLUMNS} FROM graded"))(scored)
register("provider_errors", flow(_NEWEST, _QA, then="SELECT config_id, case_id, qa.dimension, 'unparseable' AS category, 'provider_error' AS classification_method, is_answerable, qa.noise_ratio FROM newest JOIN qa USING (case_id) WHERE coalesce(error, '') <> ''"))(
    lambda s, d: scoring.provider_errors(scoring.newest_results(results(s, d)), cases(s, d)).select("config_id", "case_id", "dimension", "category", "classification_method", "is_answerable", "noise_ratio"))


def _read(s, d):
    return scoring.recovered(scoring.with_cases(scoring.without_errors(scoring.newest_results(results(s, d))), cases(s, d)))


register("classification_methods", flow(*_ALL, then="SELECT classification_method, classification_warning, count(*) AS n FROM classified GROUP BY 1, 2"))(
    lambda s, d: scoring.classified(_read(s, d), replies(s, d)).groupBy("classification_method", "classification_warning").agg(F.count("*").alias("n")))
register("fallback_requests", flow(_NEWEST, _QA, _JOINED, _READ, _RULES, then="SELECT DISTINCT key, query, coalesce(final_answer, '') AS field FROM ruled WHERE NOT sure"))(lambda s, d: scoring.fallback_requests(_read(s, d)))
register("recovery_counts", flow(_NEWEST, _QA, _JOINED, _READ, then="SELECT recovery_method, generator_key, count(*) AS n FROM read WHERE recovery_method IS NOT NULL GROUP BY GROUPING SETS ((recovery_method, generator_key), (recovery_method), ())"))(
    lambda s, d: scoring.recovery_counts(_read(s, d)))
register("unrecoverable_responses", flow(_NEWEST, _QA, _JOINED, _READ, then="SELECT generator_key, count(*) FILTER (unrecoverable) AS n FROM read GROUP BY 1"))(
    lambda s, d: _read(s, d).groupBy("generator_key").agg(F.count_if("unrecoverable").alias("n")))


def _responses(s, d):
    """Three responses of each user's event: their finish reasons, one of them without meta."""
    meta = lambda k: F.when((F.col("event_id") + k) % 3 == 0, F.create_map(F.lit("finish_reason"), F.when((F.col("event_id") + k) % 4 == 0, "length").otherwise("stop")))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.array(*[F.struct(F.lit("t").alias("text"), meta(k).alias("meta")) for k in range(3)], F.lit(None)).alias("responses"))


register("finish_reasons", "SELECT event_id, (event_id % 3 = 0 AND event_id % 4 = 0) OR ((event_id + 1) % 3 = 0 AND (event_id + 1) % 4 = 0) OR ((event_id + 2) % 3 = 0 AND (event_id + 2) % 4 = 0) AS capped FROM events")(
    lambda s, d: _responses(s, d).select("event_id", scoring.hit_output_cap().alias("capped")))
register("result_records", flow(then="SELECT case_id, [] AS retrieved_passage_ids, line_no % 3 AS n_steps, [] AS warnings FROM results"))(
    lambda s, d: scoring.result_record(results(s, d).withColumns({
        "reasoning_trace": F.lit(None).cast("string"), "retrieved_passage_ids": F.lit(None).cast("array<string>"), "generator_calls": F.lit(1), "prompt_tokens": F.lit(1), "completion_tokens": F.lit(1),
        "steps": F.when(F.col("line_no") % 3 > 0, F.array_repeat(F.lit("step"), (F.col("line_no") % 3).cast("int"))), "warnings": F.lit(None).cast("array<string>"),
    })).select("case_id", "retrieved_passage_ids", F.col("n_steps").cast("long").alias("n_steps"), "warnings"))

# --- the sandbox: five documents a case, three more in its pool

SENTINEL = T.NO_ANSWER


def _sandbox_cases(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").withColumn("n", (F.col("doc_id") / 8).cast("long"))
    p = F.struct(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("passage_id"), "text", (F.col("doc_id") % 24 == 0).alias("is_answer_bearing"), F.lit(False).alias("is_injected"))
    rows = docs.filter("doc_id % 8 < 5").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("doc_id", p.alias("p")))).alias("x"))
    case_id = F.concat(F.lit("c"), F.col("n").cast("string"))
    query = F.array_join(F.slice(T.words(F.get("x", F.lit(0))["p"]["text"]), 3, 4), " ")
    return rows.select(case_id.alias("case_id"), query.alias("query"), F.when(F.col("n") % 2 == 1, SENTINEL).otherwise("a").alias("answer"), F.transform("x", lambda v: v["p"]).alias("passages"))


def _sandbox_pool(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").filter("doc_id % 8 > 4")
    return docs.select(F.concat(F.lit("c"), (F.col("doc_id") / 8).cast("long").cast("string")).alias("case_id"), F.col("doc_id").alias("place"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("passage_id"), "text", F.lit(False).alias("is_answer_bearing"), F.lit(True).alias("is_injected"))


def _sandbox(s, d):
    return sandbox.built(_sandbox_cases(s, d), _sandbox_pool(s, d))


def boxed(s, d):
    """(cases, sandboxes), each made once, however often it is read."""
    cases = written(_sandbox_cases(s, d), "cases")
    return cases, dealt(sandbox.built(cases, _sandbox_pool(s, d)), "case_id", "sandboxes")


def sandbox_scores(s, d):
    cases, box = boxed(s, d)
    return sandbox.scores(box, cases, sandbox.indexed(box, there=True)).withColumn("score", F.round("score", 9))


_BOX = f"""own AS (
  SELECT 'c' || (doc_id // 8)::varchar AS case_id, doc_id % 8 < 5 AS is_case, doc_id, 'p' || doc_id::varchar AS passage_id, text, doc_id % 24 = 0 AS bearing, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1 AS idx,
    count(*) FILTER (doc_id % 8 < 5) OVER (PARTITION BY doc_id // 8) AS n_own, doc_id // 8 AS n FROM documents
), box AS (SELECT case_id, is_case, passage_id, text, idx, CASE WHEN is_case THEN bearing ELSE false END AS bearing, n FROM own WHERE n_own > 0
), asked AS (SELECT case_id, array_to_string({_WORDS('text')}[3:6], ' ') AS query FROM box WHERE idx = 0)"""
register("sandbox_passages", f"WITH {_BOX} SELECT case_id, idx, is_case, passage_id FROM box")(lambda s, d: _sandbox(s, d).select("case_id", "idx", "is_case", "passage_id"))
register("sandbox_leaks", f"WITH {_BOX} SELECT case_id, passage_id FROM box WHERE bearing AND n % 2 = 1")(lambda s, d: sandbox.leaks(_sandbox(s, d), _sandbox_cases(s, d)))


def _sound(s, d):
    """The sandboxes that hold; reading one of the others is an error, which a test sees to."""
    box = _sandbox(s, d)
    return sandbox.asserted(box.join(sandbox.leaks(box, _sandbox_cases(s, d)), "case_id", "left_anti"), _sandbox_cases(s, d))


register("sandbox_asserted", f"WITH {_BOX} SELECT case_id, count(*) AS n FROM box WHERE case_id NOT IN (SELECT case_id FROM box WHERE bearing AND n % 2 = 1) GROUP BY 1")(lambda s, d: _sound(s, d).groupBy("case_id").agg(F.count("passage_id").alias("n")))
_TERMS = f"""words AS (SELECT case_id, idx, is_case, passage_id, {_WORDS('lower(text)')} AS w FROM box
), tf AS (SELECT case_id, idx, term, count(*) AS tf FROM (SELECT case_id, idx, unnest(w) AS term FROM words) GROUP BY ALL
), size AS (SELECT case_id, count(*) AS n, avg(len(w)) AS avgdl FROM words GROUP BY 1
), df AS (SELECT case_id, term, ln(any_value(n) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS raw FROM tf JOIN size USING (case_id) GROUP BY ALL
), flat AS (SELECT case_id, 0.25e0 * avg(raw) AS floor FROM df GROUP BY 1
), wanted AS (SELECT case_id, term, count(*) AS times FROM (SELECT case_id, unnest({_WORDS('lower(query)')}) AS term FROM asked) GROUP BY ALL
), scores AS (
  SELECT w.case_id, w.idx, w.is_case, w.passage_id, coalesce((
    SELECT sum(times * (CASE WHEN raw < 0 THEN floor ELSE raw END) * tf.tf * 2.5e0 / (tf.tf + 1.5e0 * (0.25e0 + 0.75e0 * len(w.w) / avgdl)))
    FROM tf JOIN wanted USING (case_id, term) JOIN df USING (case_id, term) JOIN flat USING (case_id) JOIN size USING (case_id) WHERE tf.case_id = w.case_id AND tf.idx = w.idx), 0) AS score FROM words w
)"""
register("sandbox_retrieved", f"WITH {_BOX}, {_TERMS} SELECT case_id, passage_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, idx) AS rank FROM scores) WHERE rank <= 5")(
    lambda s, d: sandbox.retrieved(sandbox_scores(s, d)).select("case_id", "passage_id", "rank"))
register("sandbox_case_ranks", f"WITH {_BOX}, {_TERMS} SELECT case_id, passage_id, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, idx) AS rank FROM scores WHERE is_case")(
    lambda s, d: sandbox.ranked_case_passages(sandbox_scores(s, d)).select("case_id", "passage_id", "rank"))

# --- proxy and judge scores

_RATIOS = """ratios AS (
  SELECT key, dimension, pipeline_class, CASE WHEN category <> 'refusal' THEN value / 500 END AS faithfulness, least(1, value / 100) AS answer_relevance, least(1, value / 1000) AS context_relevance
  FROM (SELECT *, config_id || '::' || case_id AS key FROM scored WHERE event_id % 4 <> 0) UNION ALL SELECT 'nobody::x', 'noise', 'naive', 0.5e0, 0.5e0, 0.5e0
), base AS (SELECT config_id || '::' || case_id AS key, crs_score, CASE dimension WHEN 'refusal' THEN CASE WHEN is_answerable THEN NOT coalesce(answer_correct, false) ELSE category <> 'refusal' END WHEN 'conflict' THEN crs_score = 0 WHEN 'noise' THEN NOT answer_correct END AS failed FROM scored WHERE event_id % 9 <> 0)"""


def judged(s, d):
    return fixture(s, d, "scored").filter("event_id % 9 <> 0")


def ratios(s, d):
    rows = fixture(s, d, "scored").filter("event_id % 4 <> 0").select(judging.instance_key().alias("key"), "dimension", "pipeline_class", F.when(F.col("category") != "refusal", F.col("value") / 500).alias("faithfulness"), F.least(F.lit(1.0), F.col("value") / 100).alias("answer_relevance"), F.least(F.lit(1.0), F.col("value") / 1000).alias("context_relevance"))
    return rows.unionByName(s.createDataFrame([("nobody::x", "noise", "naive", 0.5, 0.5, 0.5)], rows.schema))


J = lambda then: having("scored", then="").rstrip() + ",\n" + _RATIOS + "\n" + then
register("judge_rows_joined", J("SELECT key, dimension, faithfulness, answer_relevance, context_relevance, crs_score, failed FROM ratios JOIN base USING (key)"))(
    lambda s, d: judging.judge_rows_joined(ratios(s, d), judged(s, d)).select("key", "dimension", "faithfulness", "answer_relevance", "context_relevance", "crs_score", "failed"))
register("proxy_correlations", J("""SELECT dimension, metric, n, CASE WHEN n >= 3 AND vx * vy > 0 THEN c / sqrt(vx * vy) END AS rho FROM (
  SELECT dimension, metric, count(*) AS n, covar_pop(rx, ry) AS c, var_pop(rx) AS vx, var_pop(ry) AS vy FROM (
    SELECT *, rank() OVER (PARTITION BY dimension, metric ORDER BY score) + (count(*) OVER (PARTITION BY dimension, metric, score) - 1) / 2.0e0 AS rx,
      rank() OVER (PARTITION BY dimension, metric ORDER BY target) + (count(*) OVER (PARTITION BY dimension, metric, target) - 1) / 2.0e0 AS ry FROM (
      SELECT dimension, m.metric, CASE m.metric WHEN 'faithfulness' THEN faithfulness WHEN 'answer_relevance' THEN answer_relevance ELSE context_relevance END AS score, CASE WHEN dimension = 'conflict' THEN crs_score::double ELSE (NOT failed)::int::double END AS target
      FROM ratios JOIN base USING (key), (VALUES ('faithfulness'), ('answer_relevance'), ('context_relevance')) m(metric)) WHERE score IS NOT NULL AND target IS NOT NULL) GROUP BY 1, 2)"""))(
    lambda s, d: judging.correlations(judging.judge_rows_joined(ratios(s, d), judged(s, d))))
register("faithfulness_comparator", J("SELECT pipeline_class, avg(faithfulness) AS faithfulness FROM ratios WHERE dimension = 'conflict' AND faithfulness IS NOT NULL GROUP BY 1"))(lambda s, d: judging.faithfulness_by_class(ratios(s, d)))
register("instance_contexts", flow(_NEWEST, _QA, then="SELECT key, coalesce(query, '') AS query, CASE WHEN line_no % 2 = 0 THEN ['p' || line_no::varchar, 'q'] ELSE [] END AS passage_ids FROM newest LEFT JOIN qa USING (case_id) WHERE line_no % 3 = 0"))(
    lambda s, d: judging.instance_contexts(scoring.newest_results(results(s, d)).filter("line_no % 3 = 0").select("key"), results(s, d).withColumn("retrieved_passage_ids", F.when(F.col("line_no") % 2 == 0, F.array(F.concat(F.lit("p"), F.col("line_no").cast("string")), F.lit("q")))), cases(s, d)))
_ITEMS = "rated AS (SELECT row_number() OVER (ORDER BY event_id) AS item, config_id, case_id, crs_score, event_id FROM scored WHERE dimension = 'conflict' AND crs_score IS NOT NULL)"


def _items(s, d):
    return judging.numbered(fixture(s, d, "scored").filter("dimension = 'conflict' AND crs_score IS NOT NULL").select("config_id", "case_id", "crs_score", "event_id"), "event_id")


def _pairs(s, d):
    sample = _items(s, d)
    filled = judging.rating_sheet(sample).withColumn("your_score_0_to_4", F.when(F.col("item") % 3 == 0, " ").otherwise((F.col("item") % 5).cast("string")))
    old = judging.judge_sheet(sample).withColumn("judge_score", F.when(F.col("item") % 7 == 0, 4 - F.col("judge_score")).otherwise(F.col("judge_score")))
    return judging.live_judge_pairs(filled, old, fixture(s, d, "scored").filter("event_id % 10 <> 3"))


_LIVE = _ITEMS + ", live AS (SELECT item, CASE WHEN item % 3 <> 0 THEN item % 5 END AS human, crs_score AS judge, item % 7 = 0 AND 4 - crs_score <> crs_score AS stale FROM rated WHERE event_id % 10 <> 3)"
register("rating_sheet", having("scored", then="").rstrip() + ", " + _ITEMS + " SELECT item, case_id, config_id, '' AS your_score_0_to_4, '' AS notes FROM rated")(lambda s, d: judging.rating_sheet(_items(s, d)))
register("live_judge_pairs", having("scored", then="").rstrip() + ", " + _LIVE + " SELECT item, human, judge, stale FROM live")(lambda s, d: _pairs(s, d).withColumn("human", F.col("human").cast("long")))
register("judge_staleness", having("scored", then="").rstrip() + ", " + _LIVE + " SELECT count(*) AS n_judged, count(human) AS n_rated, count(*) - count(human) AS n_unrated, count(*) FILTER (stale) AS n_stale FROM live")(lambda s, d: judging.judge_counts(_pairs(s, d)))
register("rank_within_metric", having("scored", then="SELECT metric, config_id, row_number() OVER (PARTITION BY metric ORDER BY value DESC, config_id) AS rank FROM (SELECT config_id, 'refusals' AS metric, count(*) FILTER (category = 'refusal') AS value FROM scored GROUP BY 1 UNION ALL SELECT config_id, 'mean crs', avg(crs_score) FROM scored GROUP BY 1)"))(
    lambda s, d: judging.rank_within_metric(fixture(s, d, "scored").groupBy("config_id").agg(F.count_if(F.col("category") == "refusal").cast("double").alias("refusals"), F.avg("crs_score").alias("mean crs")).unpivot("config_id", ["refusals", "mean crs"], "metric", "value"), order="config_id").select("metric", "config_id", "rank"))


def _judge_replies(s, d):
    """Replies of a judge of every kind: whole, incomplete, empty and failed."""
    k = F.col("event_id")
    of = lambda m, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % m + 1).cast("int"))
    vector = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    return s.read.parquet(f"{d}/events.parquet").select(
        k.alias("key"), of(5, " ", "Paris", "Paris", "Paris", "Paris").alias("answer"), of(2, "A b. C d. E f.", "").alias("context"), of(4, "1. a b\n2. c d", "none", "", "- x").alias("statements_reply"), of(3, "1: 1\n2: 0", "1: 1", None).alias("verdict_reply"),
        of(7, "q one?\n2) q two?", "", None, "q?", "q?", "q?", "q?").alias("questions_reply"), of(3, "1, 3 and 9", "none", None).alias("selection_reply"), vector(1, 0).alias("query_vector"), F.array(vector(2, 0), vector(0, 1)).alias("question_vectors"),
    )


register("proxy_scores", """WITH r AS (SELECT event_id AS key, [2, 0, 0, 1][event_id % 4 + 1] AS n_statements, event_id % 3 AS v, CASE WHEN event_id % 5 = 0 THEN 0 ELSE [2, 0, 0, 1, 1, 1, 1][event_id % 7 + 1] END AS n_questions, [3, 0][event_id % 2 + 1] AS n_sentences FROM events),
s AS (SELECT *, CASE WHEN n_statements = 2 AND v = 0 THEN 1 WHEN n_statements = 1 AND v = 1 THEN 1 END AS n_supported, CASE WHEN n_sentences > 0 AND v < 2 THEN 2 - 2 * v END AS n_relevant FROM r)
SELECT key, n_statements, n_supported, n_supported / n_statements AS faithfulness, n_questions, CASE n_questions WHEN 2 THEN 0.5e0 WHEN 1 THEN 1e0 END AS answer_relevance, n_sentences, n_relevant, n_relevant / n_sentences AS context_relevance FROM s""")(
    lambda s, d: judging.proxy_scores(_judge_replies(s, d)))


# --- the agentic loop, and the ledger

_TEMPLATES = {"decompose": "D {question} {most}", "step": "S {question} left {remaining}\n{evidence}", "synthesise": "Y {question}\n{evidence}"}


def _agent(requests):
    """A generator by rules: what it says follows from the case's number and the turn."""
    k, p = F.split("key", "-")[1].cast("int") % 5, F.col("prompt")
    first = F.when(k == 3, " ").otherwise("1. alpha\n2. beta")
    step = F.when(k == 0, "<final_answer>A</final_answer>").when((k == 1) & p.contains("left 2"), "NEXT_QUERY: gamma").when(k == 1, F.concat(F.lit("<final_answer>"), F.regexp_count(p, F.lit(r"Query: ")).cast("string"), F.lit("</final_answer>"))).otherwise("hm")
    text = F.when(p.startswith("D"), first).when(p.startswith("S"), step).otherwise("<final_answer>Y</final_answer>")
    return requests.select("key", text.alias("text"), F.when(k == 4, "HTTP 500").alias("error"), F.lit(False).alias("truncated"))


@register("agentic_runs", """WITH c AS (SELECT floor(doc_id / 10)::int AS n, count(*) AS docs FROM documents GROUP BY 1), k AS (SELECT *, n % 5 AS k FROM c)
SELECT 'c-' || n::varchar AS case_id, ['A', '2', 'Y', 'Y', NULL][k + 1] AS final_answer, [2, 3, 4, 3, 1][k + 1]::int AS generator_calls,
  ['decompose,retrieve,react', 'decompose,retrieve,react,retrieve,react', 'decompose,retrieve,react,retrieve,react,synthesise', 'decompose,retrieve,react,synthesise', ''][k + 1] AS nodes,
  ['alpha', 'alpha,gamma', 'alpha,beta', 'what is c-' || n::varchar, ''][k + 1] AS queries, CASE WHEN k = 4 THEN 0 ELSE docs END::int AS n_passages, [0, 0, 1, 2, 0][k + 1]::int AS n_warnings, CASE WHEN k = 4 THEN 'decompose: HTTP 500' END AS error FROM k""")
def agentic_runs(s, d):
    """A case for every ten documents, which are its sandbox, through each way of the loop."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("c-"), F.floor(F.col("doc_id") / 10).cast("string")).alias("case_id"), (F.col("doc_id") % 10).alias("idx"), F.col("doc_id").cast("string").alias("passage_id"), "text")
    box = docs.select("case_id", "idx", F.lit(True).alias("is_case"), "passage_id", "text", F.lit(False).alias("is_answer_bearing"), F.lit(False).alias("is_injected"))
    cases = docs.select("case_id").distinct().withColumn("query", F.concat(F.lit("what is "), "case_id"))
    runs = agents.agentic(cases, box, _agent, _TEMPLATES, max_steps=3, k=10)
    nodes, queries = F.transform("steps", lambda x: x["node"]), F.transform(F.filter("steps", lambda x: x["node"] == "retrieve"), lambda x: x["query"])
    return runs.select("case_id", "final_answer", "generator_calls", F.array_join(nodes, ",").alias("nodes"), F.array_join(queries, ",").alias("queries"), F.size("retrieved_passage_ids").alias("n_passages"), F.size("warnings").alias("n_warnings"), "error")


@register("ledger_verdicts", """WITH g AS (SELECT lang, source, count(*) AS n, avg(n_chars) AS chars FROM documents GROUP BY ALL), x AS (SELECT *, (ascii(substr(source, 4, 1)) + length(source)) % 5 AS k FROM g)
SELECT lang || '/' || source AS id, ['holds', 'differs', 'no value', 'no artefact', 'holds'][k + 1] AS verdict, CASE WHEN k IN (2, 3) THEN NULL ELSE n::varchar END AS actual FROM x""")
def ledger_verdicts(s, d):
    """Counts that a text states, held against one artefact for each language; some are wrong, or name what isn't there."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    counts = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    artefacts = counts.groupBy("lang").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("source", F.array("n")))).alias("by"))).alias("document")).withColumnRenamed("lang", "artefact")
    k = (F.ascii(F.substring("source", 4, 1)) + F.length("source")) % 5
    rows = counts.select(
        F.concat("lang", F.lit("/"), "source").alias("id"), (F.col("n") + F.when(k == 1, 1).otherwise(0)).cast("string").alias("stated"), F.when(k == 3, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")).alias("artefact"),
        F.concat(F.lit("by."), "source", F.when(k == 2, ".7").otherwise(".0")).alias("path"),
    )
    return validity.ledger(rows, artefacts)
