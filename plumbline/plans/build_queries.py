"""Smaller steps of building and reviewing a benchmark, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import metrics, ranking, testbeds, validity
from plumbline.plans.fixtures import fixture, having
from plumbline.plans.relation_queries import _SEEDS, seeds
from plumbline.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def scored(s, d):
    return fixture(s, d, "scored")


S = lambda then: having("scored", then=then)

#: What a reviewer is asked about a case of each kind.
CHECKLIST = [
    ("refusal", False, 1, "Is the answer absent from every passage?"), ("refusal", False, 2, "Are the passages on the topic of the question?"), ("refusal", True, 1, "Do the passages support the answer?"),
    ("conflict", True, 1, "Do the two passages contradict each other on the answer?"), ("conflict", True, 2, "Is the rest of the passage unchanged?"), ("noise", True, 1, "Are the distractors on the topic of the question?"), ("noise", True, 2, "Are the distractors free of the answer?"),
]


@register("review_checklist", S("""SELECT case_id, question_no, question
    FROM (SELECT DISTINCT case_id, dimension, is_answerable
    FROM scored)
    JOIN (VALUES """ + ", ".join(f"('{a}', {str(b).lower()}, {n}, '{q}')" for a, b, n, q in CHECKLIST) + ") c(dimension, is_answerable, question_no, question) USING (dimension, is_answerable)"))
def review_checklist(s, d):
    questions = s.createDataFrame(CHECKLIST, "dimension string, is_answerable boolean, question_no int, question string")
    return scored(s, d).select("case_id", "dimension", "is_answerable").distinct().join(F.broadcast(questions), ["dimension", "is_answerable"]).select("case_id", "question_no", "question")


FORBIDDEN = [("view", "error"), ("click", "purchase"), ("signup", "view")]
_FAMILY = "(user_id * 7 + event_id) % 499"
register("shared_families", f"""WITH r AS (SELECT DISTINCT event_type AS role, 'f' || ({_FAMILY})::varchar AS family FROM events)
SELECT p.role_a, p.role_b, a.family FROM (VALUES {", ".join(str(x) for x in FORBIDDEN)}) p(role_a, role_b) JOIN r a ON a.role = p.role_a JOIN r b ON b.role = p.role_b AND b.family = a.family""")(
    lambda s, d: readers.forbidden_families(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("role"), F.concat(F.lit("f"), F.expr(_FAMILY).cast("string")).alias("family")), s.createDataFrame(FORBIDDEN, "role_a string, role_b string")))

register("answer_split", f"""WITH {_SEEDS} SELECT seed_id, coalesce(list(passage_id
    ORDER BY doc_id) FILTER (bearing), []) AS bearing, coalesce(list(passage_id
    ORDER BY doc_id) FILTER (NOT bearing), []) AS other
    FROM ps
    GROUP BY 1""")(
    lambda s, d: seeds(s, d).select("seed_id", F.transform(testbeds.answer_bearing(), lambda p: p["passage_id"]).alias("bearing"), F.transform(testbeds.answer_bearing(yes=False), lambda p: p["passage_id"]).alias("other")))
register("served_passages", f"WITH {_SEEDS} SELECT seed_id, md5(string_agg(passage_id || text, '|' ORDER BY doc_id)) AS served, count(*) AS n FROM ps GROUP BY 1")(
    lambda s, d: seeds(s, d).withColumn("v", testbeds.served()).select("seed_id", F.md5(F.array_join(F.transform("v", lambda p: F.concat(p["passage_id"], p["text"])), "|").cast("binary")).alias("served"), F.size("v").alias("n")))
register("distractor_flags", f"WITH {_SEEDS} SELECT 'dist-' || passage_id AS passage_id, false AS is_answer_bearing, true AS is_injected FROM ps WHERE NOT bearing")(
    lambda s, d: seeds(s, d).select(F.explode(F.transform(testbeds.answer_bearing(yes=False), testbeds.distractor)).alias("p")).select("p.passage_id", "p.is_answer_bearing", "p.is_injected"))
register("passage_texts", f"""WITH {_SEEDS}, x AS (SELECT seed_id AS case_id, doc_id, 'p' || (doc_id % 400)::varchar AS passage_id, text
    FROM ps)
    SELECT passage_id, md5(arg_min(text, case_id || lpad(doc_id::varchar, 9, '0'))) AS text
    FROM x
    GROUP BY 1""")(
    lambda s, d: readers.passage_texts(s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("nq-"), F.floor(F.col("doc_id") / 5).cast("string")).alias("case_id"), "doc_id", F.struct(F.concat(F.lit("p"), (F.col("doc_id") % 400).cast("string")).alias("passage_id"), "text").alias("p")).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "p"))), lambda x: x["p"]).alias("passages"))).select("passage_id", F.md5(F.col("text").cast("binary")).alias("text")))
_GEN = r"""gen AS (SELECT doc_id, text AS original, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Other. ' || text ELSE 'Nothing of it.' END AS generated, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[2] AS answer, (doc_id % 10) / 10.0e0 AS score
    FROM documents)"""
register("contradiction_verdicts", f"""WITH {_GEN} SELECT reason, count(*) AS n
    FROM (SELECT CASE WHEN trim(generated) = trim(original) THEN 'unchanged' WHEN contains(lower(generated), lower(trim(answer))) THEN 'true answer still present' WHEN answer IS NULL OR trim(answer) = '' THEN 'answer sentence not found' WHEN score < 0.7 THEN 'below threshold' END AS reason
    FROM gen)
    GROUP BY 1""")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(F.col("text").alias("original"), F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Other. "), "text")).otherwise("Nothing of it.").alias("generated"), F.get(T.words(F.col("text")), F.lit(1)).alias("answer"), ((F.col("doc_id") % 10) / 10.0).alias("score")).select(testbeds.contradiction_verdict(F.col("original"), F.col("generated"), F.col("answer"), F.col("score")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")))
register("accuracy_drops", S("""SELECT pipeline_class, noise_ratio, accuracy - lead(accuracy) OVER (PARTITION BY pipeline_class
    ORDER BY noise_ratio) AS fall
    FROM (SELECT pipeline_class, noise_ratio, avg(CASE WHEN answer_correct THEN 1.0e0 ELSE 0 END) AS accuracy
    FROM scored
    WHERE dimension = 'noise'
    GROUP BY 1, 2)"""))(
    lambda s, d: metrics.noise_accuracy(scored(s, d), ["pipeline_class"]).select("pipeline_class", "noise_ratio", (F.col("accuracy") - F.lead("accuracy").over(Window.partitionBy("pipeline_class").orderBy("noise_ratio"))).alias("fall")))
register("evidence_first_wins", "SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations) WHERE rn = 1")(
    lambda s, d: ranking.first_wins(s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], "turn"))
register("number_words", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 3 THEN 0 END AS n FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", T.number_word(F.element_at(F.array(F.lit("six"), F.lit("6"), F.lit("sixty"), F.lit("Zero")), (F.col("event_id") % 4 + 1).cast("int"))).alias("n")))
register("faithfulness_ratios", S("SELECT pipeline_class, noise_ratio, count(*) FILTER (answer_correct) / nullif(count(answer_correct), 0) AS ratio FROM scored GROUP BY 1, 2"))(
    lambda s, d: scored(s, d).groupBy("pipeline_class", "noise_ratio").agg(F.count_if("answer_correct").alias("hits"), F.count("answer_correct").alias("n")).select("pipeline_class", "noise_ratio", validity.ratio_of(F.col("hits"), F.col("n")).alias("ratio")))
register("template_flag", r"""WITH t AS (SELECT doc_id, lang, unnest(list_distinct(list_transform(regexp_extract_all(text, '([A-Za-z0-9'']+)', 1), lambda x: lower(x)))) AS token FROM documents), g AS (SELECT token, count(*) AS documents FROM t WHERE lang = 'fr' GROUP BY 1 HAVING count(*) >= 2)
SELECT max(documents / (SELECT count(*) FROM documents WHERE lang = 'fr')) AS max_share, max(documents / (SELECT count(*) FROM documents WHERE lang = 'fr')) > 0.25 AS flagged FROM g WHERE token NOT IN (SELECT token FROM t WHERE lang <> 'fr')""")(
    lambda s, d: validity.generated_only_share(s.read.parquet(f"{d}/documents.parquet").filter("lang = 'fr'"), s.read.parquet(f"{d}/documents.parquet").filter("lang <> 'fr'")).agg(F.max("share").alias("max_share")).withColumn("flagged", F.col("max_share") > 0.25))
