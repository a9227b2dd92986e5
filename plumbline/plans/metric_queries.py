"""Queries over scored responses, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import agreement, inference, metrics
from plumbline.plans.fixtures import fixture, having

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def scored(spark, d):
    return fixture(spark, d, "scored")


def _refusal_sql(by: str, src: str = "scored") -> str:
    k, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {k} tp, fp, fn, tn, tp + fp + fn + tn AS n, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
  plain_correct / (tp + fp + fn + tn) AS plain_accuracy, recall AS negative_rejection_rate,
  CASE WHEN tp + fn = 0 THEN 'no unanswerable cases' WHEN fp + tn = 0 THEN 'no answerable cases' END AS degenerate
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM (
  SELECT {k} count(*) FILTER (NOT is_answerable AND category = 'refusal') AS tp, count(*) FILTER (is_answerable AND category = 'refusal') AS fp,
    count(*) FILTER (NOT is_answerable AND category <> 'refusal') AS fn, count(*) FILTER (is_answerable AND category <> 'refusal') AS tn,
    count(*) FILTER (is_answerable AND category = 'answer' AND answer_correct) AS plain_correct
  FROM {src} WHERE dimension = 'refusal' {g}))"""


def _crs_sql(by: str, where: str = "") -> str:
    return f"""SELECT {by}, avg(crs_score) AS mean, count(*) AS n, count(*) FILTER (crs_score = 0) AS n0, count(*) FILTER (crs_score = 1) AS n1, count(*) FILTER (crs_score = 2) AS n2,
  count(*) FILTER (crs_score = 3) AS n3, count(*) FILTER (crs_score = 4) AS n4, avg(crs_score) / 4 AS normalised
FROM scored WHERE dimension = 'conflict' AND crs_score IS NOT NULL {where} GROUP BY {by}"""


def _curve_sql(by: str) -> str:
    return f"SELECT {by}, noise_ratio, avg(CASE WHEN answer_correct THEN 1.0e0 ELSE 0e0 END) AS accuracy, count(*) AS n FROM scored WHERE dimension = 'noise' GROUP BY {by}, noise_ratio"


def _ndc_sql(by: str) -> str:
    return f"""SELECT {by}, auc, slope, cliff, fixed_point, CASE WHEN censored = 'none' THEN crossing END AS ndc50, censored,
  CASE censored WHEN 'left' THEN '< 0.00' WHEN 'right' THEN '> 0.90' ELSE printf('%.3f', crossing) END AS ndc50_text
FROM (SELECT *, CASE WHEN a0 < 0.5 THEN 'left' WHEN crossing IS NULL THEN 'right' ELSE 'none' END AS censored FROM (
  SELECT {by}, (0.25e0 * (a0 + a1) / 2 + 0.25e0 * (a1 + a2) / 2 + 0.25e0 * (a2 + a3) / 2 + (0.9e0 - 0.75e0) * (a3 + a4) / 2) / 0.9e0 AS auc,
    coalesce((greatest(a0 - a1, 0) + greatest(a1 - a2, 0) + greatest(a2 - a3, 0) + greatest(a3 - a4, 0)) / nullif((a0 > a1)::int + (a1 > a2)::int + (a2 > a3)::int + (a3 > a4)::int, 0), 0) AS slope,
    greatest(a0 - a1, a1 - a2, a2 - a3, a3 - a4, 0) AS cliff, a3 AS fixed_point, a0,
    CASE WHEN a0 >= 0.5 AND a1 < 0.5 THEN (a0 - 0.5) / (a0 - a1) * 0.25 WHEN a1 >= 0.5 AND a2 < 0.5 THEN 0.25 + (a1 - 0.5) / (a1 - a2) * 0.25
      WHEN a2 >= 0.5 AND a3 < 0.5 THEN 0.5 + (a2 - 0.5) / (a2 - a3) * 0.25 WHEN a3 >= 0.5 AND a4 < 0.5 THEN 0.75 + (a3 - 0.5) / (a3 - a4) * (0.9 - 0.75) END AS crossing
  FROM (SELECT {by}, max(accuracy) FILTER (noise_ratio = 0) AS a0, max(accuracy) FILTER (noise_ratio = 0.25) AS a1, max(accuracy) FILTER (noise_ratio = 0.5) AS a2,
      max(accuracy) FILTER (noise_ratio = 0.75) AS a3, max(accuracy) FILTER (noise_ratio = 0.9) AS a4 FROM ({_curve_sql(by)}) GROUP BY {by})))"""


S = lambda then: having("scored", then=then)

for _by in ("pipeline_class", "config_id"):
    _n = "class" if _by == "pipeline_class" else "config"
    register(f"refusal_f1_by_{_n}", S(_refusal_sql(_by)))(lambda s, d, by=_by: metrics.refusal_f1(scored(s, d), [by]))
    register(f"crs_by_{_n}", S(_crs_sql(_by)))(lambda s, d, by=_by: metrics.conflict_resolution(scored(s, d), [by]))
    register(f"noise_accuracy_by_{_n}", S(_curve_sql(_by)))(lambda s, d, by=_by: metrics.noise_accuracy(scored(s, d), [by]))
    register(f"ndc_by_{_n}", S(_ndc_sql(_by)))(lambda s, d, by=_by: metrics.degradation_curve(metrics.noise_accuracy(scored(s, d), [by]), [by]))

register("crs_excluding_non_terminating", S(_crs_sql("pipeline_class", "AND NOT (truncated AND final_answer IS NULL)")))(lambda s, d: metrics.conflict_resolution(scored(s, d), ["pipeline_class"], exclude_non_terminating=True))
register("correct_side_by_class", S("""SELECT pipeline_class, count(*) AS n, count(*) FILTER (answer_correct IS NULL) AS n_no_commitment, count(*) FILTER (answer_correct) / count(*) AS over_all, count(*) FILTER (answer_correct) / count(answer_correct) AS over_committed
    FROM scored
    WHERE dimension = 'conflict'
    GROUP BY 1"""))(
    lambda s, d: metrics.correct_side(scored(s, d).filter("dimension = 'conflict'"), ["pipeline_class"], "answer_correct"))
register("crs_distribution_map", S("""SELECT c.pipeline_class, level, count(s.crs_score) AS n FROM (SELECT DISTINCT pipeline_class FROM scored) c CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS level) l
  LEFT JOIN (SELECT pipeline_class, crs_score FROM scored WHERE dimension = 'conflict') s ON s.pipeline_class = c.pipeline_class AND s.crs_score = level GROUP BY ALL"""))(
    lambda s, d: metrics.conflict_resolution(scored(s, d), ["pipeline_class"]).select("pipeline_class", F.explode(F.create_map(*[x for k in range(5) for x in (F.lit(k), F.col(f"n{k}"))])).alias("level", "n")))
register("ndc50_mean_uncensored", S(f"SELECT avg(ndc50) AS mean_ndc50, count(ndc50) AS n_uncensored, count(*) AS n FROM ({_ndc_sql('config_id')})"))(
    lambda s, d: metrics.mean_ndc50(metrics.degradation_curve(metrics.noise_accuracy(scored(s, d), ["config_id"]), ["config_id"])))
register("non_termination_by_dimension", S("""SELECT dimension, count(*) AS n, count(*) FILTER (truncated AND final_answer IS NULL) AS non_terminating, count(*) FILTER (truncated AND final_answer IS NULL) / count(*) AS rate
    FROM scored
    GROUP BY 1"""))(
    lambda s, d: metrics.non_termination(scored(s, d)))
register("count_by_dimension", S("""SELECT dimension, count(*) AS n, count(DISTINCT case_id) AS n_cases
    FROM scored
    GROUP BY 1"""))(lambda s, d: scored(s, d).groupBy("dimension").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("n_cases")))

_METRICS = lambda by: f"""SELECT {by}, 'refusal_f1' AS metric, f1 AS value FROM ({_refusal_sql(by)}) WHERE degenerate IS NULL UNION ALL SELECT {by}, 'crs', mean FROM ({_crs_sql(by)}) UNION ALL SELECT {by}, 'ndc_auc', auc FROM ({_ndc_sql(by)}) WHERE auc IS NOT NULL"""
register("metric_table_by_class", S(_METRICS("pipeline_class")))(lambda s, d: metrics.metric_table(scored(s, d), ["pipeline_class"]))
register("metric_by_seed_source", having("scored", then="""SELECT *
    FROM (""" + _METRICS("pipeline_class, source").replace("FROM scored", """FROM (SELECT *, CASE WHEN starts_with(seed_id, 'nq-') THEN 'nq' WHEN starts_with(seed_id, 'tqa-') THEN 'tqa' ELSE 'unknown' END AS source
    FROM scored)""") + ")"))(
    lambda s, d: metrics.metric_table(scored(s, d).withColumn("source", metrics.seed_source()), ["pipeline_class", "source"]))
_VARIATION = f"""m AS (SELECT split_part(config_id, '|', 1) AS pipeline_class, split_part(config_id, '|', 2) AS retriever, split_part(config_id, '|', 3) AS generator_key, metric, value FROM ({_METRICS('config_id')})),
v AS (SELECT pipeline_class, metric, max(value) - min(value) AS spread, count(*) AS n_configs FROM m GROUP BY ALL),
r AS (SELECT pipeline_class, metric, CASE WHEN count(*) > 1 THEN max(a) - min(a) END AS retriever_effect FROM (SELECT pipeline_class, metric, avg(value) AS a FROM m GROUP BY pipeline_class, metric, retriever) GROUP BY ALL),
ge AS (SELECT pipeline_class, metric, CASE WHEN count(*) > 1 THEN max(a) - min(a) END AS generator_effect FROM (SELECT pipeline_class, metric, avg(value) AS a FROM m GROUP BY pipeline_class, metric, generator_key) GROUP BY ALL)"""
register("within_class_variation", S(f""", {_VARIATION} SELECT *
    FROM v
    JOIN r USING (pipeline_class, metric)
    JOIN ge USING (pipeline_class, metric)""").replace("\n,", ",\n"))(lambda s, d: metrics.class_variation(scored(s, d)))
register("between_versus_within", S(f""", {_VARIATION} SELECT metric, max_within, worst_class, max_between, max_between > max_within AS between_exceeds_within
    FROM (SELECT metric, max(spread) AS max_within, arg_max(pipeline_class, spread) AS worst_class
    FROM v
    GROUP BY 1)
    JOIN (SELECT metric, max(value) - min(value) AS max_between
    FROM ({_METRICS('pipeline_class')})
    GROUP BY 1) USING (metric)""").replace("\n,", ",\n"))(
    lambda s, d: metrics.between_within(scored(s, d)))
register("divergent_cases", S("""SELECT dimension, case_id, rank FROM (SELECT dimension, case_id, row_number() OVER (PARTITION BY dimension ORDER BY case_id) AS rank FROM (
  SELECT dimension, case_id, max(crs_score) - min(crs_score) AS gap, count(DISTINCT CASE WHEN dimension = 'refusal' THEN category ELSE coalesce(answer_correct::varchar, 'None') END) AS kinds
  FROM (SELECT *, row_number() OVER (PARTITION BY dimension, case_id, pipeline_class ORDER BY config_id DESC) AS rn FROM scored) WHERE rn = 1 GROUP BY 1, 2)
  WHERE CASE WHEN dimension = 'conflict' THEN coalesce(gap >= 2, false) ELSE kinds >= 2 END) WHERE rank <= 20"""))(lambda s, d: metrics.divergent_cases(scored(s, d)))
register("metric_bundle_by_config", S(f"""SELECT config_id, r.f1 AS refusal_f1, c.mean AS crs, k.auc AS ndc_auc, k.ndc50_text, (SELECT count(*)
    FROM scored s
    WHERE s.config_id = r.config_id) AS n
    FROM ({_refusal_sql('config_id')}) r
    JOIN ({_crs_sql('config_id')}) c USING (config_id)
    JOIN ({_ndc_sql('config_id')}) k USING (config_id)"""))(
    lambda s, d: metrics.refusal_f1(scored(s, d), ["config_id"]).select("config_id", F.col("f1").alias("refusal_f1"))
    .join(metrics.conflict_resolution(scored(s, d), ["config_id"]).select("config_id", F.col("mean").alias("crs")), "config_id")
    .join(metrics.degradation_curve(metrics.noise_accuracy(scored(s, d), ["config_id"]), ["config_id"]).select("config_id", F.col("auc").alias("ndc_auc"), "ndc50_text"), "config_id")
    .join(scored(s, d).groupBy("config_id").agg(F.count("*").alias("n")), "config_id"))

# --- agreement

_DIAG = """SELECT {k} n, po AS observed, pe AS expected, CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa, CASE WHEN q < 2 THEN 1 ELSE (po - ch) / (1 - ch) END AS ac1,
  CASE WHEN q = 2 THEN 2 * po - 1 END AS pabak, CASE WHEN q = 2 THEN abs(n - la - lb) / n END AS prevalence_index, CASE WHEN q = 2 THEN abs(la - lb) / n END AS bias_index,
  po >= 0.8 AND (CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END) <= 0.4 AS paradox
FROM (SELECT {k} max(n) AS n, max(same / n) AS po, sum((ca / n) * (cb / n)) AS pe, count(*) AS q, sum((ca / n + cb / n) / 2 * (1 - (ca / n + cb / n) / 2)) / nullif(count(*) - 1, 0) AS ch, arg_min(ca, label) AS la, arg_min(cb, label) AS lb
FROM (SELECT {k} label, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT {k} {a} AS label, 1 AS ca, 0 AS cb FROM {t} UNION ALL SELECT {k} {b}, 0, 1 FROM {t}) GROUP BY {k} label)
JOIN (SELECT {k} count(*) AS n, count(*) FILTER ({a} = {b}) AS same FROM {t} {g}) {j} GROUP BY {kk})"""


def _diag(a: str, b: str, t: str, by: str = "") -> str:
    return _DIAG.format(k=f"{by}, " if by else "", a=a, b=b, t=t, g=f"GROUP BY {by}" if by else "", j=f"USING ({by})" if by else "ON true", kk=by or "()").replace("GROUP BY ())", ")")


raters = lambda s, d: fixture(s, d, "raters")
R = lambda then: having("raters", then=then)
register("agreement_skewed", R(_diag("rater_a", "rater_b", "raters")))(lambda s, d: agreement.diagnostics(raters(s, d), "rater_a", "rater_b"))
register("agreement_balanced", R(_diag("rater_a", "rater_c", "raters")))(lambda s, d: agreement.diagnostics(raters(s, d), "rater_a", "rater_c"))
register("agreement_by_group", R(_diag("rater_a", "rater_b", "raters", "grp")))(lambda s, d: agreement.diagnostics(raters(s, d), "rater_a", "rater_b", ["grp"]))
_PAIR = """pair AS (SELECT a.case_id, a.crs_score AS human, b.crs_score AS judge
    FROM scored a
    JOIN scored b USING (case_id)
    WHERE a.config_id = 'naive|bm25|standard_1' AND b.config_id = 'agentic|dpr|reasoning_2' AND a.crs_score IS NOT NULL AND b.crs_score IS NOT NULL)"""


def pair(s, d):
    rows = scored(s, d).filter("crs_score IS NOT NULL").select("case_id", "config_id", "crs_score")
    a, b = rows.filter("config_id = 'naive|bm25|standard_1'"), rows.filter("config_id = 'agentic|dpr|reasoning_2'")
    return a.select("case_id", F.col("crs_score").alias("human")).join(b.select("case_id", F.col("crs_score").alias("judge")), "case_id")


_WK = "SELECT count(*) AS n, 1 - avg((human - judge) * (human - judge)) / (avg(human * human) + avg(judge * judge) - 2 * avg(human) * avg(judge)) AS weighted_kappa FROM pair"
register("weighted_kappa", S(f", {_PAIR} {_WK}").replace("\n,", ",\n"))(lambda s, d: agreement.weighted_kappa(pair(s, d), "human", "judge"))
register("judge_agreement", S(f""", {_PAIR} SELECT d.n, kappa, weighted_kappa, exact, within_one, {', '.join(f'{w}_{k}' for w in ('human', 'judge') for k in range(5))}, kappa >= 0.6 AS usable
    FROM ({_diag('human', 'judge', 'pair')}) d, ({_WK}) w, (SELECT avg((human = judge)::int) AS exact, avg((abs(human - judge) <= 1)::int) AS within_one, {', '.join(f'count(*) FILTER ({w} = {k}) AS {w}_{k}' for w in ('human', 'judge') for k in range(5))}
    FROM pair)""").replace("\n,", ",\n"))(
    lambda s, d: agreement.judge_agreement(pair(s, d), "human", "judge"))
_SHEET = lambda c, m: f"""SELECT 'case-' || doc_id::varchar AS case_id, q AS question_no, lang AS dimension, CASE WHEN doc_id % {m} = 0 THEN '' WHEN (CASE WHEN q = 1 THEN {c} ELSE toxic END) = 1 THEN ' Yes' ELSE 'no' END AS answer
    FROM labels
    JOIN documents USING (doc_id), (SELECT unnest([1, 2]) AS q)"""  # noqa: E731
_LABELS = f"""WITH f AS ({_SHEET('quality', 10)}),
    s AS ({_SHEET('(n_chars >= 300)::int', 7)}),
    a AS (SELECT * REPLACE (lower(trim(answer)) AS answer)
    FROM f
    WHERE trim(answer) <> ''),
    b AS (SELECT * REPLACE (lower(trim(answer)) AS answer)
    FROM s
    WHERE trim(answer) <> ''),
    j AS (SELECT a.case_id, a.dimension, a.answer AS x, b.answer AS y
    FROM a
    JOIN b USING (case_id, question_no)),
    blank AS (SELECT count(*) AS skipped_blank
    FROM a
    FULL
    JOIN b USING (case_id, question_no)
    WHERE a.answer IS NULL OR b.answer IS NULL)"""


def _sheets(s, d):
    rows = s.read.parquet(f"{d}/labels.parquet").join(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("question_no", F.explode(F.array(F.lit(1), F.lit(2))))

    def sheet(mark, blank):
        yes = F.when(F.col("question_no") == 1, mark).otherwise(F.col("toxic")) == 1
        answer = F.when(F.col("doc_id") % blank == 0, "").when(yes, " Yes").otherwise("no")
        return rows.select(F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("case_id"), "question_no", F.col("lang").alias("dimension"), answer.alias("answer"))

    return sheet(F.col("quality"), 10), sheet((F.col("n_chars") >= 300).cast("int"), 7)


register("label_agreement", _LABELS + f""" SELECT *
    FROM (SELECT '(all)' AS dimension, *
    FROM ({_diag('x', 'y', 'j')})
    UNION ALL SELECT *
    FROM ({_diag('x', 'y', 'j', 'dimension')})
    WHERE n >= 2), blank""")(lambda s, d: agreement.label_agreement(*_sheets(s, d)))

# --- bootstrap

_SUMS = {
    "refusal_f1": ("count(*) FILTER (NOT is_answerable AND category = 'refusal') AS s0, count(*) FILTER (is_answerable AND category = 'refusal') AS s1, count(*) FILTER (NOT is_answerable AND category <> 'refusal') AS s2, count(*) FILTER (is_answerable AND category <> 'refusal') AS s3", "dimension = 'refusal'", "case_id", 4,
                   "CASE WHEN s0 + s2 > 0 AND s1 + s3 > 0 THEN CASE WHEN s0 > 0 THEN 2 * (s0 / (s0 + s1)) * (s0 / (s0 + s2)) / (s0 / (s0 + s1) + s0 / (s0 + s2)) ELSE 0 END END"),
    "crs": ("sum(crs_score) AS s0, count(*) AS s1", "dimension = 'conflict' AND crs_score IS NOT NULL", "case_id", 2, "s0 / nullif(s1, 0)"),
    "ndc_auc": (", ".join([f"count(*) FILTER (noise_ratio = {r} AND answer_correct) AS s{i}" for i, r in enumerate(metrics.NOISE_GRID)] + [f"count(*) FILTER (noise_ratio = {r}) AS s{i + 5}" for i, r in enumerate(metrics.NOISE_GRID)]), "dimension = 'noise'", "seed_id", 10,
                "(0.25e0 * (s0 / nullif(s5, 0) + s1 / nullif(s6, 0)) / 2 + 0.25e0 * (s1 / nullif(s6, 0) + s2 / nullif(s7, 0)) / 2 + 0.25e0 * (s2 / nullif(s7, 0) + s3 / nullif(s8, 0)) / 2 + (0.9e0 - 0.75e0) * (s3 / nullif(s8, 0) + s4 / nullif(s9, 0)) / 2) / 0.9e0"),
}
_B = inference.RESAMPLES


def _boot(metric: str, group: str, stats: str, arms: str = "") -> str:
    """CTEs u (units), w (weights), o (observed) and v (resampled values) of a stats query."""
    _, _, _, k, value = _SUMS[metric]
    arm = f", {arms}" if arms else ""
    order = ", ".join(f"max(s{i}) FILTER ({arms} = {side})" if arms else f"max(s{i})" for side in (1, 2)[: 1 + bool(arms)] for i in range(k))
    return f"""st AS ({stats}), u AS (SELECT {group}, unit, row_number() OVER (PARTITION BY {group} ORDER BY {order}, unit) - 1 AS idx FROM st GROUP BY {group}, unit),
sz AS (SELECT {group}, count(*) AS size FROM u GROUP BY {group}),
w AS (SELECT {group}, b, ('0x' || substr(md5(concat_ws('|', '20260721', {group}, b, j // 4)), 1 + 8 * (j % 4)::int, 8))::ubigint % size AS idx, count(*) AS weight FROM sz, range({_B}) t(b), LATERAL (SELECT unnest(range(size)) AS j) GROUP BY ALL),
o AS (SELECT {group}{arm}, {value} AS observed FROM (SELECT {group}{arm}, {', '.join(f'sum(s{i}) AS s{i}' for i in range(k))} FROM st GROUP BY ALL)),
v AS (SELECT {group}{arm}, b, {value} AS value FROM (SELECT {group}{arm}, b, {', '.join(f'sum(s{i} * weight) AS s{i}' for i in range(k))} FROM w JOIN u USING ({group}, idx) JOIN st USING ({group}, unit) GROUP BY ALL))"""


_CI = "quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper, count(*) FILTER (value IS NULL) AS n_failed"
for _m, (_sums, _where, _unit, _k, _value) in _SUMS.items():
    _stats = f"SELECT pipeline_class, {_unit} AS unit, {_sums} FROM scored WHERE {_where} GROUP BY ALL"
    register(f"bootstrap_{_m}", S(f""", {_boot(_m, 'pipeline_class', _stats)} SELECT *, lower > 0 OR upper < 0 AS excludes_zero
    FROM o
    JOIN (SELECT pipeline_class, {_CI}
    FROM v
    GROUP BY 1) USING (pipeline_class)""").replace("\n,", ",\n"))(
        lambda s, d, m=_m: inference.intervals(scored(s, d), m, ["pipeline_class"]))
    _pairs = f"""SELECT a.pipeline_class AS arm_a, b.pipeline_class AS arm_b, a.unit, side, {', '.join(f'CASE WHEN side = 1 THEN a.s{i} ELSE b.s{i} END AS s{i}' for i in range(_k))}
    FROM st0 a
    JOIN st0 b ON a.unit = b.unit AND a.pipeline_class < b.pipeline_class, (SELECT unnest([1, 2]) AS side)"""
    _verdict = f"significant AND abs(observed) >= {inference.PRACTICAL[_m]} AS practical"
    register(f"paired_{_m}", S(f""", st0 AS ({_stats}), {_boot(_m, 'arm_a, arm_b', _pairs, 'side')} SELECT *, {_verdict} FROM (SELECT arm_a, arm_b, observed, lower, upper, n_failed, n_units, '{_m}' AS metric, coalesce(lower > 0 OR upper < 0, false) AS significant
FROM (SELECT arm_a, arm_b, max(observed) FILTER (side = 1) - max(observed) FILTER (side = 2) AS observed FROM o GROUP BY 1, 2)
JOIN (SELECT arm_a, arm_b, {_CI} FROM (SELECT arm_a, arm_b, b, max(value) FILTER (side = 1) - max(value) FILTER (side = 2) AS value FROM v GROUP BY ALL) GROUP BY 1, 2) USING (arm_a, arm_b) JOIN (SELECT arm_a, arm_b, count(DISTINCT unit) AS n_units FROM st GROUP BY 1, 2) USING (arm_a, arm_b))""").replace("\n,", ",\n"))(
        lambda s, d, m=_m: inference.paired_differences(scored(s, d), m))
    _by_source = f"SELECT pipeline_class, split_part(seed_id, '-', 1) AS source, {_unit} AS unit, {_sums} FROM scored WHERE {_where} GROUP BY ALL"
    register(f"unpaired_source_{_m}", S(f""", {_boot(_m, 'pipeline_class, source', _by_source)} SELECT *, {_verdict} FROM (SELECT pipeline_class, observed, lower, upper, n_failed, '{_m}' AS metric, coalesce(lower > 0 OR upper < 0, false) AS significant
FROM (SELECT pipeline_class, max(observed) FILTER (source = 'nq') - max(observed) FILTER (source = 'tqa') AS observed FROM o GROUP BY 1)
JOIN (SELECT pipeline_class, {_CI} FROM (SELECT pipeline_class, b, max(value) FILTER (source = 'nq') - max(value) FILTER (source = 'tqa') AS value FROM v GROUP BY ALL) GROUP BY 1) USING (pipeline_class))""").replace("\n,", ",\n"))(
        lambda s, d, m=_m: inference.unpaired_differences(scored(s, d).withColumn("source", metrics.seed_source()), m, group="pipeline_class", side="source", sides=("nq", "tqa")))

_PART = "metric, {a} AS arm_a, {b} AS arm_b, {sign}observed AS observed, {sign}{low} AS lower, {sign}{high} AS upper, significant, practical, n_units, n_failed, NULL::varchar AS error"
_TURNS = [("agentic", "naive", ""), ("agentic", "reasoning", ""), ("naive", "reasoning", "-")]
register("paired_comparisons", "\nUNION ALL\n".join(
    "SELECT " + _PART.format(a="arm_b" if sign else "arm_a", b="arm_a" if sign else "arm_b", sign=sign, low="upper" if sign else "lower", high="lower" if sign else "upper") + f" FROM ({SQL[f'paired_{m}']}) WHERE arm_a = '{a}' AND arm_b = '{b}'"
    for m in _SUMS for a, b, sign in _TURNS))(lambda s, d: inference.comparisons(scored(s, d)))
_ENDED = f"SELECT pipeline_class, case_id AS unit, {_SUMS['crs'][0]} FROM scored WHERE {_SUMS['crs'][1]} AND NOT (truncated AND final_answer IS NULL) GROUP BY ALL"
SQL_ENDED = S(f""", {_boot('crs', 'pipeline_class', _ENDED)} SELECT pipeline_class, observed, lower, upper, n_failed
    FROM o
    JOIN (SELECT pipeline_class, {_CI}
    FROM v
    GROUP BY 1) USING (pipeline_class)""").replace("\n,", ",\n")
register("described_classes", "\nUNION ALL\n".join(
    f"""SELECT pipeline_class, '{m}' AS metric, '{v}' AS variant, observed AS value, lower, upper, n_failed, NULL::varchar AS error
    FROM ({sql})""" for m, v, sql in [*((m, "all", SQL[f"bootstrap_{m}"]) for m in _SUMS), ("crs", "terminating", SQL_ENDED)]))(
    lambda s, d: inference.described(scored(s, d)))
register("published_record", S("SELECT config_id, round_even(avg(value), 4) AS mean_value, round_even(avg(crs_score), 4) AS crs, count(*) AS n FROM scored GROUP BY 1"))(
    lambda s, d: inference.rounded(scored(s, d).groupBy("config_id").agg(F.avg("value").alias("mean_value"), F.avg("crs_score").alias("crs"), F.count("*").alias("n"))))
