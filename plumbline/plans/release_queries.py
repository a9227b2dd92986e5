"""Building, verifying and replaying a benchmark, each step with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import building, calls, replay, runs, sandbox, scoring, testbeds, validity
from plumbline.plans import flow_queries as flows
from plumbline.plans.fixtures import fixture, having
from plumbline.plans.text_queries import _WORDS, q
from plumbline.sources.cache import Cache
from plumbline.sources.scratch import folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(s, d, t):
    return s.read.parquet(f"{d}/{t}.parquet")


def _choice(u: str) -> str:
    total, at, out = sum(w for _, w in building.CASE_MIX), 0, "CASE"
    for name, w in building.CASE_MIX:
        at += w
        out += f" WHEN {u} * {total!r}e0 < {at!r}e0 THEN '{name}'" if name != building.CASE_MIX[-1][0] else f" ELSE '{name}'"
    return out + " END"


_U = lambda key: f"(('0x' || substr(md5({key}), 1, 8))::bigint / 4294967296.0e0)"

# --- building

register("weighted_kinds", f"SELECT event_id AS i, {_choice(_U(q('11|') + ' || event_id::varchar'))} AS kind FROM events")(
    lambda s, d: table(s, d, "events").select(F.col("event_id").alias("i")).select("i", building.weighted_choice(building.uniform(11, "i"), building.CASE_MIX).alias("kind")))
register("synthetic_cases", f"""WITH k AS (SELECT i, {_choice(_U(q('11|') + ' || i::varchar'))} AS kind FROM (SELECT unnest(range(count(*))) AS i FROM documents)), r AS (SELECT *, CASE WHEN kind LIKE 'noise%' THEN split_part(kind, '-', 2)::double END AS noise_ratio FROM k),
n AS (SELECT *, greatest(1, floor(floor(700 * noise_ratio / (1 - noise_ratio)) / 200)) AS extra FROM r)
SELECT 'spike-' || CASE WHEN noise_ratio IS NULL THEN kind ELSE 'noise' || floor(noise_ratio * 100)::int::varchar END || '-' || i::varchar AS case_id, noise_ratio, CASE kind WHEN 'refusal' THEN 1 WHEN 'conflict' THEN 2 ELSE 1 + extra END AS n_passages,
  CASE kind WHEN 'refusal' THEN 706 WHEN 'conflict' THEN 1406 ELSE 706 + 200 * extra END AS n_words FROM n""")(
    lambda s, d: building.synthetic_cases(s, table(s, d, "documents").count()).select("case_id", "noise_ratio", F.size("passages").cast("double").alias("n_passages"), testbeds.tokens_of().cast("double").alias("n_words")))

#: Cases by hand, and what is wrong with each: (dimension, answer, ratio, passages, generation parameters, problems).
_P = lambda i, text, bearing=False, injected=False: (f"p{i}", text, bearing, injected)
_GOOD = {"contradiction_score": "0.9", "true_passage_position": "0"}
CASES = [
    ("refusal", T.NO_ANSWER, None, [_P(0, "x y")], {}, []), ("refusal", "1889", None, [_P(0, "in 1889", True)], {}, []), ("refusal", T.NO_ANSWER, None, [_P(0, "in 1889", True)], {}, ["unanswerable with an answer passage"]),
    ("refusal", "1889", None, [_P(0, "x")], {}, ["no answer passage"]), ("refusal", "King George I", None, [_P(0, "King George III", True)], {}, ["answer not in the text of p0"]), ("noise", T.NO_ANSWER, 0.0, [_P(0, "x")], {}, ["unanswerable outside refusal"]),
    ("conflict", "1889", None, [_P(0, "in 1889", True), _P(1, "in 1934", False, True)], _GOOD, []), ("conflict", "1889", None, [_P(0, "in 1889", True)], _GOOD, ["not two opposed passages"]),
    ("conflict", "1889", None, [_P(0, "in 1889", True), _P(1, "not in 1889", False, True)], _GOOD, ["answer in the contradiction"]), ("conflict", "1889", None, [_P(0, "x", True), _P(1, "y", False, True)], _GOOD, ["answer not in the original", "answer not in the text of p0"]),
    ("conflict", "1889", None, [_P(0, "in 1889", True), _P(1, "in 1934", False, True)], {"true_passage_position": "1", "contradiction_score": "0.6"}, ["contradiction score below the threshold", "recorded position is wrong"]),
    ("conflict", "1889", None, [_P(1, "in 1934", False, True), _P(0, "in 1889", True)], {"true_passage_position": "1", "contradiction_score": "1"}, []),
    ("noise", "Bogotá", 0.5, [_P(0, "to Bogota then", True), _P(1, "a b c", False, True)], {}, []), ("noise", "1889", 0.75, [_P(0, "in 1889", True), _P(1, "a b", False, True)], {}, ["ratio off target"]),
]


def hand_cases(s, d):
    made = s.createDataFrame([(i, *c[:5]) for i, c in enumerate(CASES)], f"v int, dimension string, answer string, noise_ratio double, passages array<{testbeds.PASSAGE}>, gen_params map<string,string>")
    return table(s, d, "events").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("case_id"), (F.col("event_id") % len(CASES)).cast("int").alias("v")).join(F.broadcast(made), "v").drop("v")  # a handful


_BAD = ", ".join(f"({i}, {q(x)})" for i, c in enumerate(CASES) for x in c[5])
_IS = lambda test: f"count(*) FILTER (event_id % {len(CASES)} IN ({', '.join(str(i) for i, c in enumerate(CASES) if test(c))}))"
register("built_violations", f"""SELECT 'c' || event_id::varchar AS case_id, problem FROM events JOIN (VALUES {_BAD}) b(v, problem) ON b.v = event_id % {len(CASES)}
UNION ALL SELECT NULL, 'refusal is unbalanced' FROM events HAVING {_IS(lambda c: c[0] == 'refusal' and c[1] == T.NO_ANSWER)} <> {_IS(lambda c: c[0] == 'refusal' and c[1] != T.NO_ANSWER)}
UNION ALL SELECT NULL, 'order of conflict is not random' FROM events HAVING NOT ({_IS(lambda c: c[0] == 'conflict' and c[3][0][2])} / {_IS(lambda c: c[0] == 'conflict')} > 0.25 AND {_IS(lambda c: c[0] == 'conflict' and c[3][0][2])} / {_IS(lambda c: c[0] == 'conflict')} < 0.75)""")(
    lambda s, d: building.violations(hand_cases(s, d)))
register("smoke_slice", having("case_rows", then=f"""SELECT case_id FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension, answer = '{T.NO_ANSWER}' ORDER BY case_id) AS place, count(*) FILTER (dimension = 'refusal' AND answer = '{T.NO_ANSWER}') OVER () AS shut, dense_rank() OVER (PARTITION BY dimension ORDER BY first) AS seed_place
  FROM (SELECT *, min(case_id) OVER (PARTITION BY dimension, seed_id) AS first FROM (SELECT DISTINCT case_id, answer, dimension, seed_id FROM case_rows)))
WHERE CASE WHEN dimension = 'refusal' AND answer = '{T.NO_ANSWER}' THEN place <= 5 WHEN dimension = 'refusal' THEN place <= 11 - least(5, shut) WHEN dimension = 'conflict' THEN place <= 11 ELSE seed_place <= 11 END"""))(
    lambda s, d: building.smoke_slice(flows.cases(s, d), 11).select("case_id"))
_NOISE = f"""pas AS (SELECT floor(doc_id / 5)::bigint AS sd, 's' || floor(doc_id / 5)::bigint::varchar AS seed_id, doc_id, 'd' || doc_id::varchar AS passage_id, len({_WORDS('text')}) AS tokens, doc_id % 5 = 0 AS own FROM documents), stocked AS (SELECT * FROM pas WHERE sd % 3 <> 0)"""


def _noise(s, d, n=10_000_000):
    p = table(s, d, "documents").select(F.floor(F.col("doc_id") / 5).alias("sd"), F.col("doc_id").alias("place"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("passage_id"), T.word_count(F.col("text")).alias("tokens"), (F.col("doc_id") % 5 == 0).alias("own")).withColumn("seed_id", F.concat(F.lit("s"), F.col("sd").cast("string")))
    return building.noise_testbed(p.filter("own").drop("own", "sd"), p.filter("NOT own AND sd % 3 <> 0").drop("own", "sd"), n)


register("noise_warnings", f"WITH {_NOISE} SELECT seed_id, 'empty distractor pool, skipped' AS warning FROM pas WHERE own AND sd % 3 = 0 UNION ALL SELECT NULL, 'SHORTFALL: requested 10000000 seeds, only ' || count(*)::varchar || ' available' FROM pas WHERE own")(lambda s, d: _noise(s, d)[1])
register("noise_stats", f"""WITH {_NOISE}, w AS (SELECT seed_id FROM pas WHERE own AND sd % 3 = 0), x AS (SELECT '' AS k, 'SHORTFALL: requested 10000000 seeds, only ' || (SELECT count(*) FROM pas WHERE own)::varchar || ' available' AS t UNION ALL SELECT seed_id, seed_id || ': empty distractor pool, skipped' FROM w)
SELECT count(DISTINCT seed_id) AS n_seeds, 5 * count(DISTINCT seed_id) AS n_instances, (SELECT count(*) + 1 FROM w) AS n_warnings, (SELECT list(t ORDER BY k) FROM (SELECT * FROM x ORDER BY k LIMIT 20)) AS warnings FROM stocked WHERE own""")(lambda s, d: building.noise_stats(*_noise(s, d)))
register("seed_stage", f"""WITH sx AS (SELECT 's' || doc_id::varchar AS seed_id, lang, md5(concat_ws('|', CASE lang WHEN 'en' THEN '5' ELSE '6' END, 's' || doc_id::varchar)) AS h, len({_WORDS('text')}) AS n FROM documents WHERE lang IN ('en', 'fr')),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, seed_id) AS rn FROM sx) WHERE rn <= CASE lang WHEN 'en' THEN 60 ELSE 40 END) SELECT CASE WHEN n < 50 THEN 'evidence_too_short' WHEN n > 400 THEN 'evidence_too_long' ELSE 'kept' END AS reason, count(*) AS n FROM dr GROUP BY 1""")(
    lambda s, d: (lambda made: made[1].unionByName(made[0].agg(F.count("*").alias("n")).select(F.lit("kept").alias("reason"), "n").filter("n > 0")))(
        building.seed_stage(table(s, d, "documents").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("seed_id"), F.col("lang").alias("source"), F.lit("answer").alias("answer"), F.array(testbeds.passage(F.lit("p"), F.col("text"), True, False)).alias("passages")), {"en": 60, "fr": 40}, 5, 50, 400)))
register("seen_passages", "SELECT user_id, list(doc_id ORDER BY place) AS seen FROM (SELECT user_id, 'p' || (event_id % 40)::varchar AS doc_id, min(event_id) AS place FROM events GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("part")).agg(F.struct(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: F.concat(F.lit("p"), (x % 40).cast("string"))).alias("passage_ids")).alias("step"))
    .groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "step"))), lambda x: x["step"]).alias("steps")).select("user_id", building.seen_in_order().alias("seen")))
register("sample_shortfall", having("scored", then="SELECT dimension, pipeline_class, greatest(0, 150 - count(*) FILTER (category = 'refusal')) AS missing FROM scored GROUP BY 1, 2"))(
    lambda s, d: building.shortfall(fixture(s, d, "scored"), ["dimension", "pipeline_class"], 150, F.col("category") == "refusal"))
register("rotated_members", having("scored", then="SELECT seed_id, case_id FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY case_id) - 1 AS nth, count(*) OVER (PARTITION BY seed_id) AS n FROM (SELECT DISTINCT seed_id, case_id FROM scored WHERE dimension = 'noise')) WHERE nth = length(seed_id) % n"))(
    lambda s, d: building.rotated(fixture(s, d, "scored").filter("dimension = 'noise'"), "seed_id", "case_id", F.length("seed_id")))


def _conflicts(s, d):
    t = table(s, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("case_id"), "doc_id", "text")
    p = lambda name, text: testbeds.passage(name, text, False, False)
    other = F.when(F.col("doc_id") % 7 > 0, F.concat("case_id", F.lit("-contra"))).otherwise("x")
    return t.select("case_id", F.array(p(F.col("case_id"), F.col("text")), p(other, F.concat(F.lit("Said "), F.substring("text", 1, 60)))).alias("passages"), F.when(F.col("doc_id") % 5 > 0, F.create_map(F.lit("contradicted_passage_id"), F.col("case_id"))).alias("gen_params"))


_PAIR = "pairs AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 AND doc_id % 5 > 0 THEN text END AS original, CASE WHEN doc_id % 7 > 0 AND doc_id % 5 > 0 THEN 'Said ' || substr(text, 1, 60) END AS generated FROM documents)"
register("conflict_pairs", f"WITH {_PAIR} SELECT 'c' || doc_id::varchar AS case_id, md5(original) AS original, md5(generated) AS generated FROM pairs")(
    lambda s, d: validity.conflict_pairs(_conflicts(s, d)).select("case_id", F.md5(F.col("original").cast("binary")).alias("original"), F.md5(F.col("generated").cast("binary")).alias("generated")))
register("artefact_report")(lambda s, d: validity.artefact_report(validity.conflict_pairs(_conflicts(s, d)).filter("original IS NOT NULL"), (4, 5)))

# --- replay

_REQ = "'{\"family\": \"f' || (event_id % 3)::varchar || '\", \"max_tokens\": 1024, \"model\": \"m\", \"prompt\": \"say ' || event_id::varchar || '\", \"seed\": 7, \"stop\": [\"#\"], \"system\": null, \"temperature\": 0.0, \"thinking\": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}'"
register("request_keys", f"SELECT event_id, sha256({_REQ}) AS key FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", replay.request_key(F.lit("m"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")), replay.request(F.concat(F.lit("say "), F.col("event_id").cast("string")), seed=7, thinking=F.col("event_id") % 2 == 0, stop=["#"])).alias("key")))


def _put(s, d):
    e = table(s, d, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 300).cast("string")).alias("key"), F.col("event_id").alias("created_at"), F.col("event_type").alias("text"))
    return replay.put(e.filter("created_at < 500").groupBy("key").agg(F.max("created_at").alias("created_at"), F.max_by("text", "created_at").alias("text")), e.filter("created_at >= 500").withColumn("error", F.when(F.col("text") == "error", "timeout").when(F.col("text") == "view", "")))


register("cache_put", "SELECT key, created_at, text FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC) AS rn FROM (SELECT 'k' || (event_id % 300)::varchar AS key, event_id AS created_at, event_type AS text FROM events WHERE event_id < 500 OR event_type <> 'error')) WHERE rn = 1")(_put)


def _put_in_turns(s, d):
    """The same rows put into a store in three turns, of which the last touches few buckets."""
    e = table(s, d, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 300).cast("string")).alias("key"), F.col("event_id").alias("created_at"), F.col("event_type").alias("text"))
    store = Cache(s, folder(s, "cache"), e.schema, buckets=8)
    store.put(e.filter("created_at < 500"))
    later = e.filter("created_at >= 500").withColumn("error", F.when(F.col("text") == "error", "timeout").when(F.col("text") == "view", ""))
    store.put(later.filter("key <> 'k7'"))
    store.put(later.filter("key = 'k7'"))
    return store.read()


register("cache_store", SQL["cache_put"])(_put_in_turns)


async def _shouts(row):
    """A model that fails for one request in seven."""
    if row["n"] % 7 == 3:
        raise calls.CallFailed(400, "no")
    return {"text": row["prompt"].upper()}


@register("read_through", """WITH r AS (SELECT event_id AS n, 'k' || event_id::varchar AS key, event_type AS prompt FROM events WHERE event_id % 5 = 0)
SELECT key, CASE WHEN n % 2 = 0 THEN 'kept' WHEN n % 7 <> 3 THEN upper(prompt) END AS text, n % 2 = 1 AND n % 7 = 3 AS failed, n % 2 = 0 OR n % 7 <> 3 AS cached FROM r""")
def read_through(s, d):
    """Requests of which every second one is in the cache; the others' answers are there afterwards, the failed ones aren't."""
    requests = table(s, d, "events").filter("event_id % 5 = 0").select(F.col("event_id").alias("n"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("event_type").alias("prompt"))
    store = Cache(s, folder(s, "cache"), buckets=8)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in store.fields if f.name != "key"}
    store.put(requests.filter("n % 2 = 0").select("key").withColumns({**blank, "text": F.lit("kept"), "created_at": F.timestamp_seconds(F.lit(0))}))
    answers, _ = calls.read_through(requests, store, _shouts, "key string, text string, error string", width=4)
    return answers.select("key", "text", F.col("error").isNotNull().alias("failed")).join(store.lookup(answers.select("key")).select("key", F.col("hit").alias("cached")), "key")


def _stored(s, d):
    """The newest results with two passages each, which the arms of every third case share, and a step whose output is recorded."""
    rows = scoring.newest_results(flows.results(s, d)).filter("case_id <> 'gone'")
    ids = F.when(F.length("case_id") % 3 == 0, F.array("case_id")).otherwise(F.array("case_id", "retriever"))
    step = F.struct(F.when(F.col("line_no") % 4 > 0, "decompose").otherwise("other").alias("node"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("array<string>").alias("subqueries"), F.lit(None).cast("array<string>").alias("passage_ids"), F.concat(F.lit("d"), (F.col("line_no") % 50).cast("string")).alias("output"))
    return rows.withColumns({"raw_text": F.concat(F.lit("t"), (F.col("line_no") % 60).cast("string")), "retrieved_passage_ids": ids, "steps": F.when(F.col("line_no") % 5 > 0, F.array(step).cast(f"array<{replay.STEP}>"))})


def _replies(s, d):
    said = F.when(F.col("line_no") % 7 == 1, F.concat(F.lit("t"), ((F.col("line_no") + 12) % 60).cast("string"))).when(F.col("line_no") % 7 == 2, F.concat(F.lit("d"), (F.col("line_no") % 50).cast("string"))).when(F.col("line_no") % 7 == 3, "never").when(F.col("line_no") % 7 != 4, F.col("raw_text"))
    return _stored(s, d).filter("line_no % 2 = 0").select("key", said.alias("text"), F.when(F.col("line_no") % 7 == 5, "no entry").alias("error"))


_STORED = """stored AS (
  SELECT *, 't' || (line_no % 60)::varchar AS said, length(case_id) % 3 = 0 AS alike, CASE WHEN line_no % 5 > 0 THEN 'd' || (line_no % 50)::varchar END AS step FROM newest WHERE case_id <> 'gone'
), known AS (SELECT DISTINCT generator_key, said AS text FROM stored UNION SELECT DISTINCT generator_key, step FROM stored WHERE step IS NOT NULL)"""
_BACK = """back AS (SELECT *, CASE line_no % 7 WHEN 1 THEN 't' || ((line_no + 12) % 60)::varchar WHEN 2 THEN 'd' || (line_no % 50)::varchar WHEN 3 THEN 'never' WHEN 4 THEN NULL ELSE said END AS got FROM stored WHERE line_no % 2 = 0),
outcomes AS (SELECT b.key, CASE WHEN line_no % 7 = 5 OR got IS NULL THEN 'miss' WHEN got = said THEN 'reproduced' WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.generator_key = b.generator_key AND k.text = got) THEN 'violation: provenance'
  WHEN NOT alike AND EXISTS (SELECT 1 FROM stored o WHERE o.case_id = b.case_id AND o.pipeline_class = b.pipeline_class AND o.generator_key = b.generator_key AND o.retriever <> b.retriever) THEN 'violation: reproduction' ELSE 'provenance' END AS outcome FROM back b)"""
register("replay_outcomes", flows.flow(flows._NEWEST, _STORED, _BACK, then="SELECT key, outcome FROM outcomes"))(lambda s, d: replay.verified(_stored(s, d), _replies(s, d)))
register("provenance_index", flows.flow(flows._NEWEST, _STORED, then="SELECT generator_key, count(*) AS n FROM known GROUP BY 1"))(lambda s, d: replay.provenance_index(_stored(s, d)).groupBy("generator_key").agg(F.count("*").alias("n")))
register("replay_corpus", flows.flow(flows._NEWEST, "sc AS (SELECT config_id || '::' || case_id AS key, any_value(category) AS category FROM scored WHERE event_id % 3 > 0 GROUP BY 1)", then="SELECT key, case_id, final_answer, category FROM newest LEFT JOIN sc USING (key)").replace("WITH ", having("scored", then="").rstrip() + ",\n", 1))(
    lambda s, d: replay.corpus(flows.results(s, d), fixture(s, d, "scored").filter("event_id % 3 > 0").dropDuplicates(["config_id", "case_id"])).select("key", "case_id", "final_answer", "scored.category"))


def _forks(s, d):
    rows = _stored(s, d).withColumn("request_key", F.concat(F.lit("r"), (F.col("line_no") % 90).cast("string")))
    cache = s.range(80).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("d"), (F.col("id") % 50).cast("string")).alias("text"))
    return replay.decompose_forks(rows, cache)


register("decompose_forks", flows.flow(flows._NEWEST, _STORED, then="SELECT key, CASE WHEN line_no % 90 >= 80 THEN 'not in the cache' WHEN step IS NULL OR line_no % 4 = 0 THEN 'no decomposition recorded' WHEN step = 'd' || ((line_no % 90) % 50)::varchar THEN 'same' ELSE 'fork' END AS cause FROM stored WHERE pipeline_class = 'agentic'"))(_forks)
def _parameters(s, d):
    """Of the configurations and generators that the scored rows name."""
    rows = fixture(s, d, "scored")
    generators = rows.select("generator_key").distinct().select("generator_key", (F.col("generator_key") == "reasoning_1").alias("thinking"), (F.col("generator_key") == "reasoning_2").alias("cot_prompt"))
    return replay.pipeline_parameters(rows.select("config_id", "pipeline_class", "generator_key").distinct(), generators, {"max_output_tokens": 2048, "seed": 5})


register("pipeline_parameters", having("scored", then="""SELECT DISTINCT config_id, CASE WHEN pipeline_class <> 'naive' THEN generator_key = 'reasoning_1' END AS thinking, CASE WHEN pipeline_class <> 'naive' THEN generator_key = 'reasoning_2' END AS cot_prompt, 2048 AS max_tokens, 0.0e0 AS temperature, 5::bigint AS seed,
    CASE WHEN pipeline_class = 'agentic' THEN 5 END AS max_steps FROM scored"""))(_parameters)



def _curated(s, d):
    c = flows.fixture(s, d, "case_rows").select("g", "seed_id").distinct().filter("g % 5 = 0")
    shown = c.select(F.col("g").alias("place"), F.when(F.col("g") % 10 == 0, "case").otherwise("seed").alias("kind"), F.when(F.col("g") % 10 == 0, F.concat(F.lit("conflict-"), F.col("seed_id"), F.lit("-1"))).otherwise(F.col("seed_id")).alias("target"), F.lit("shown").alias("why"))
    extra = flows.fixture(s, d, "case_rows").filter("slot = 1 AND g % 4 = 0").select(F.col("g").alias("place"), "case_id", F.lit("more").alias("why")).distinct()
    return replay.curated(shown, extra)


_CURATED = """shown AS (SELECT DISTINCT g, seed_id FROM case_rows WHERE g % 5 = 0), listed AS (
  SELECT CASE WHEN g % 10 = 0 THEN 'conflict-' || seed_id || '-1' ELSE 'noise-' || seed_id || '-r' || r END AS case_id, 'shown' AS why, 0 AS part, g FROM shown, (VALUES ('00'), ('25'), ('50'), ('75'), ('90')) v(r) WHERE g % 10 <> 0 OR r = '00'
  UNION ALL SELECT DISTINCT case_id, 'more', 1, g FROM case_rows WHERE slot = 1 AND g % 4 = 0
), chosen AS (SELECT case_id, arg_min(why, part) AS why FROM listed GROUP BY 1)"""
register("curated_ids", having("case_rows", then="").rstrip() + ",\n" + _CURATED + " SELECT case_id, why FROM chosen")(lambda s, d: _curated(s, d).select("case_id", "why"))


def _casebook(s, d):
    chosen = _curated(s, d).filter("startswith(case_id, 'conflict')")
    return replay.casebook(flows.cases(s, d), chosen, scoring.newest_results(flows.results(s, d)), flows.scored(s, d).withColumn("crs_score", F.lit(None).cast("int")), ["agentic|bm25|reasoning_1", "naive|bm25|standard_1", "reasoning|bm25|reasoning_1"])


register("casebook_arms", flows.flow(*flows._ALL, _CURATED, then="""SELECT c.case_id, why, coalesce(list(g.config_id || ':' || g.category ORDER BY g.config_id) FILTER (g.config_id IS NOT NULL), []) AS arms FROM chosen c LEFT JOIN graded g ON g.case_id = c.case_id AND g.config_id IN ('agentic|bm25|reasoning_1', 'naive|bm25|standard_1', 'reasoning|bm25|reasoning_1')
WHERE c.case_id LIKE 'conflict%' GROUP BY 1, 2"""))(lambda s, d: _casebook(s, d).select("case_id", "why", F.transform("arms", lambda a: F.concat(a["config_id"], F.lit(":"), a["category"])).alias("arms")))
register("snippets", r"SELECT doc_id, CASE WHEN length(b) <= 240 THEN b ELSE substr(b, 1, 239) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS b FROM documents)")(lambda s, d: table(s, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet")))


def _calls(s, d):
    """The calls of two configurations for every sandbox, and a cache that lacks those of every third case."""
    cases, box = flows.boxed(s, d)
    ranked = sandbox.ranked_case_passages(sandbox.scores(box, cases, sandbox.indexed(box, there=True)).withColumn("score", F.round("score", 9)))
    generators = s.createDataFrame([("standard_1", False, False), ("reasoning_2", False, True)], "generator_key string, thinking boolean, cot_prompt boolean")
    configs = s.createDataFrame([("naive|bm25|standard_1", "naive", "standard_1"), ("reasoning|bm25|reasoning_2", "reasoning", "reasoning_2")], "config_id string, pipeline_class string, generator_key string")
    asked = replay.single_call_requests(cases, replay.contexts(ranked, box), replay.pipeline_parameters(configs, generators, {"seed": 1}), "Q: {question}\n{passages}", "Think. {question}\n{passages}")
    models = configs.select("config_id", F.lit("m").alias("model"), F.lit("f").alias("family"))
    known = asked.filter(F.pmod(F.substring("case_id", 2, 9).cast("long"), F.lit(3)) > 0).join(models, "config_id")
    cache = known.select(replay.request_key(F.col("model"), F.col("family"), F.col("request")).alias("key"), F.concat(F.lit("<final_answer>"), "case_id", F.lit("</final_answer>")).alias("text")).distinct()
    return asked, replay.replayed(asked, models, cache)


_SHOWN = f"""{flows._BOX}, {flows._TERMS}, ranks AS (SELECT case_id, idx, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, idx) AS rank FROM scores WHERE is_case),
shown AS (SELECT case_id, any_value(query) AS query, string_agg('[' || rank::varchar || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS passages FROM ranks JOIN box USING (case_id, idx) JOIN asked USING (case_id) GROUP BY 1),
calls AS (SELECT 'naive|bm25|standard_1::' || case_id AS key, case_id, 'Q: ' || query || chr(10) || passages AS prompt FROM shown UNION ALL SELECT 'reasoning|bm25|reasoning_2::' || case_id, case_id, 'Think. ' || query || chr(10) || passages FROM shown)"""
register("single_call_prompts", f"WITH {_SHOWN} SELECT key, md5(prompt) AS prompt FROM calls")(lambda s, d: _calls(s, d)[0].select("key", F.md5(F.col("prompt").cast("binary")).alias("prompt")))
register("replayed_calls", f"WITH {_SHOWN} SELECT key, substr(case_id, 2)::bigint % 3 = 0 AS missed, CASE WHEN substr(case_id, 2)::bigint % 3 > 0 THEN case_id END AS final_answer FROM calls")(lambda s, d: _calls(s, d)[1].select("key", "missed", "final_answer"))


def _walked(s, d):
    """Documents as a pool of contradictions: every kind of failure, and texts that are accepted."""
    t = table(s, d, "documents").withColumn("answer", F.get(T.words(F.col("text")), F.lit(1))).filter("answer IS NOT NULL AND length(answer) > 1")
    made = F.when(F.col("doc_id") % 6 == 0, " ").when(F.col("doc_id") % 6 == 1, F.col("text")).when(F.col("doc_id") % 6 == 2, F.concat(F.lit("So. "), "text")).otherwise("0 0.")
    return building.conflict_stage(t.select("doc_id", F.col("text").alias("original"), "answer", made.alias("generated"), ((F.col("doc_id") % 10) / 10).alias("score"), F.when(F.col("doc_id") % 11 == 0, "HTTP 500").alias("error"), (F.col("doc_id") % 13 == 0).alias("truncated")), 40, "doc_id")


_WALK = f"""t AS (SELECT *, {_WORDS('text')}[2] AS answer FROM documents WHERE len({_WORDS('text')}) > 1 AND length({_WORDS('text')}[2]) > 1), g AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN text WHEN 2 THEN 'So. ' || text ELSE '0 0.' END AS generated FROM t),
r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'generation_failed' WHEN trim(generated) = '' THEN 'empty_response' WHEN doc_id % 13 = 0 THEN 'truncated' WHEN trim(generated) = trim(text) THEN 'unchanged' WHEN contains(lower(generated), lower(answer)) THEN 'true answer still present' WHEN (doc_id % 10) / 10 < 0.7 THEN 'below threshold' END AS reason FROM g),
a AS (SELECT doc_id FROM r WHERE reason IS NULL ORDER BY doc_id LIMIT 40), e AS (SELECT CASE WHEN count(*) = 40 THEN max(doc_id) END AS stop FROM a)"""
register("conflict_stage", f"WITH {_WALK} SELECT 'accepted' AS reason, count(*) AS n FROM a UNION ALL SELECT reason, count(*) FROM r, e WHERE reason IS NOT NULL AND (stop IS NULL OR doc_id < stop) GROUP BY 1")(
    lambda s, d: (lambda made: made[0].agg(F.count("*").alias("n")).select(F.lit("accepted").alias("reason"), "n").unionByName(made[1]))(_walked(s, d)))
