"""Readers, writers and streams as round trips through files, each with the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import judging
from plumbline.plans import flow_queries as flows
from plumbline.plans import release_queries as release
from plumbline.plans.fixtures import fixture, having
from plumbline.plans.text_queries import _MATCH, _WORDS, q
from plumbline.sources import artefacts, corpora, readers, streams
from plumbline.sources.schemas import schema
from plumbline.sources.scratch import folder
from plumbline.streaming import logs

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


_V = f"(VALUES {', '.join(f'({i}, {q(c[0])}, {q(c[1])}, {len(c[3])})' for i, c in enumerate(release.CASES))}) v(v, dimension, answer, n)"


def _as_cases(s, d):
    rows = release.hand_cases(s, d)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema("case").fields if f.name not in rows.columns}
    return rows.withColumns(missing).select(*[f.name for f in schema("case").fields])


@register("cases_from_files", f"SELECT 'c' || event_id::varchar AS case_id, dimension, answer, n FROM events JOIN {_V} ON v = event_id % {len(release.CASES)}")
def cases_from_files(s, d):
    at = folder(s, "cases")
    readers.write_cases(_as_cases(s, d), at)
    back = readers.read_cases(s, at, validate=False).unionByName(readers.read_cases(s, f"{at}-missing", missing_ok=True))
    return back.select("case_id", "dimension", "answer", F.size("passages").alias("n"))


@register("cases_by_id", "SELECT 'c' || (event_id % 100)::varchar AS case_id, max(event_id)::varchar AS query FROM events GROUP BY 1")
def cases_by_id(s, d):
    """Files in which ids are repeated: the last line of each counts. Files are ranges of lines, named in their order, so no task writes them all."""
    at = folder(s, "cases")
    rows = table(s, d, "events").select(F.concat(F.lit("c"), (F.col("event_id") % 100).cast("string")).alias("case_id"), F.col("event_id").cast("string").alias("query"), "event_id")
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").drop("event_id").write.json(at)
    return readers.read_cases_by_id(s, at).select("case_id", "query")


_SEEDS = "s AS (SELECT 'nq-' || doc_id::varchar AS seed_id, lang AS source, text, doc_id % 3 = 0 AS old FROM documents)"


@register("seeds_from_files", f"WITH {_SEEDS} SELECT seed_id, source, md5(text) AS text, CASE WHEN old THEN 0 ELSE 1 END AS extras FROM s")
def seeds_from_files(s, d):
    at = folder(s, "seeds")
    kind = schema("seed")["passages"].dataType
    own = F.array(F.struct(F.lit("p").alias("passage_id"), F.col("text").alias("text"), F.lit(True).alias("is_answer_bearing"), F.lit(False).alias("is_injected"))).cast(kind)
    rows = table(s, d, "documents").select(F.concat(F.lit("nq-"), F.col("doc_id").cast("string")).alias("seed_id"), F.col("lang").alias("source"), F.lit("q").alias("query"), F.lit("a").alias("answer"), own.alias("passages"), F.when(F.col("doc_id") % 3 > 0, own).alias("extra_passages"))
    artefacts.write_seeds(rows, at)
    return artefacts.read_seed_lines(s, at).select("seed_id", "source", F.md5(F.get("passages", F.lit(0))["text"].cast("binary")).alias("text"), F.size("extra_passages").alias("extras"))


@register("log_from_files", "SELECT 'good' AS kind, count(*) FILTER (event_id % 10 NOT IN (3, 7)) AS n FROM events UNION ALL SELECT 'malformed', count(*) FILTER (event_id % 10 IN (3, 7)) FROM events")
def log_from_files(s, d):
    """A log with cut lines, lines without key and blank ones."""
    at = folder(s, "log")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("key"), F.col("value").alias("latency_s")))
    odd = F.when(F.col("event_id") % 10 == 3, F.expr("substring(line, 1, 9)")).when(F.col("event_id") % 10 == 7, '{"case_id": "c"}').otherwise(F.col("line"))
    table(s, d, "events").withColumn("line", line).select(F.explode(F.array(odd, F.lit(" "))).alias("value")).write.text(at)
    good, malformed = readers.read_log(s, at)
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), "n").unionByName(malformed.agg(F.count("*").alias("n")).select(F.lit("malformed").alias("kind"), "n"))


@register("scored_from_files", having("scored", then="SELECT pipeline_class, count(*) AS n, count(answer_correct) AS graded, count(crs_score) AS judged, count(final_answer) AS answered FROM scored GROUP BY 1"))
def scored_from_files(s, d):
    at = folder(s, "scored")
    artefacts.write_scored(fixture(s, d, "scored").drop("pipeline_class"), at)
    return readers.read_scored(s, at).groupBy("pipeline_class").agg(F.count("*").alias("n"), F.count("answer_correct").alias("graded"), F.count("crs_score").alias("judged"), F.count("final_answer").alias("answered"))


@register("labels_from_files", "SELECT doc_id::varchar AS case_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer_yes_no, 'a, \"b\"' AS notes FROM labels WHERE doc_id % 10 <> 0")
def labels_from_files(s, d):
    """Sheets that were filled in by hand: blanks, capitals, quotes; a missing file is skipped."""
    at = folder(s, "labels")
    answer = F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.when(F.col("quality") == 1, " Yes").otherwise("NO "))
    rows = table(s, d, "labels").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("refusal").alias("dimension"), F.lit(1).alias("question_no"), F.lit("Is it?").alias("question"), answer.alias("answer_yes_no"), F.lit('a, "b"').alias("notes"))
    rows.write.csv(at, header=True, escape='"', quote='"')
    return readers.read_labels(s, [at, f"{at}-missing"]).select("case_id", "answer_yes_no", "notes")


_RATED = having("scored", then="").rstrip() + ", " + flows._ITEMS


@register("rating_sheets_from_files", _RATED + " SELECT item, case_id, config_id, crs_score AS judge_score, NULL::varchar AS rating FROM rated")
def rating_sheets_from_files(s, d):
    at = folder(s, "ratings")
    artefacts.write_rating_sheets(flows._items(s, d), at)
    blind = artefacts.read_sheet(s, f"{at}/ratings", "item int, case_id string, config_id string, your_score_0_to_4 string, notes string").withColumnRenamed("your_score_0_to_4", "rating")
    return artefacts.read_sheet(s, f"{at}/judge_scores", "item int, case_id string, config_id string, judge_score int").join(blind.select("item", "rating"), "item")


@register("vectors_from_files", "SELECT vec_id::varchar AS passage_id, round(list_sum(embedding::double[]), 5) AS total FROM embeddings")
def vectors_from_files(s, d):
    """A store of two files, ids and vectors line by line."""
    at = folder(s, "vectors")
    rows = table(s, d, "embeddings").select("vec_id", F.to_json(F.struct("embedding")).alias("v")).repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").cache()
    rows.select(F.col("vec_id").cast("string")).write.text(f"{at}/ids")
    rows.select(F.regexp_extract("v", r"(\[.*\])", 1)).write.text(f"{at}/vectors")
    rows.unpersist()
    back = artefacts.read_vectors(s, f"{at}/ids", f"{at}/vectors")
    artefacts.write_vectors(back, f"{at}/store")
    return s.read.parquet(f"{at}/store").select("passage_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


_LOG = "l AS (SELECT 'k' || (event_id % 500)::varchar AS key, event_id AS line_no, CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'view' THEN '' END AS error FROM events)"


def _log(s, d):
    error = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "view", "")
    return table(s, d, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 500).cast("string")).alias("key"), F.col("event_id").alias("line_no"), error.alias("error"))


@register("result_index", f"WITH {_LOG} SELECT key, coalesce(arg_max(coalesce(error, ''), line_no), '') = '' AS done FROM l GROUP BY 1")
def result_index(s, d):
    """A log that is appended to in three runs."""
    at = folder(s, "log")
    found = artefacts.result_index(s, at)
    for k in range(3):
        artefacts.record_results(_log(s, d).filter(F.col("line_no") % 3 == k), at)
    return found.unionByName(artefacts.result_index(s, at))


def _log_folder(s, d, files: int = 3) -> str:
    at = folder(s, "log")
    rows = _log(s, d).withColumnRenamed("line_no", "completion_tokens")
    for k in range(files):
        artefacts.record_results(rows.filter(F.col("completion_tokens") % files == k).coalesce(1), at)
    return at


@register("log_stream_state", f"WITH {_LOG} SELECT key, max(line_no) AS line_no FROM l GROUP BY 1")
def log_stream_state(s, d):
    """The growing log as a stream, a file a micro-batch: the last row of each key, in the end."""
    at = folder(s, "state")
    stream = logs.read_log_stream(s, _log_folder(s, d), files_per_trigger=1).select("key", "error", F.col("completion_tokens").alias("line_no"))
    logs.last_state(stream, at).awaitTermination()
    return logs.newest_state(s, at).select("key", "line_no")


_READY = "WITH " + _LOG + """, r AS (SELECT *, min(line_no % 3) OVER (PARTITION BY key) AS file FROM l WHERE coalesce(error, '') = '')
SELECT key, max(line_no) AS scored_line FROM r WHERE line_no % 3 = file AND key <> 'k7' GROUP BY key"""


@register("stream_scored_once", _READY)
def stream_scored_once(s, d):
    """Scoring of a growing log, a file a micro-batch: each key once, by its last good row of the batch in which it first has one, though it comes again and the query is started again. One key has a score already."""
    at = folder(s, "scores")
    source = _log_folder(s, d)
    for _ in range(2):
        stream = logs.read_log_stream(s, source, files_per_trigger=1).select("key", "error", F.col("completion_tokens").alias("line_no"))
        known = s.range(1).select(F.lit("k7").alias("key"))
        good = F.coalesce("error", F.lit("")) == ""
        logs.score_new(stream, lambda rows: rows.select("key", F.col("line_no").alias("scored_line")), f"{at}/table", f"{at}/checkpoint", ready=good, scored=known).awaitTermination()
    return s.read.parquet(f"{at}/table")


@register("corpus_prefix", f"SELECT doc_id, {_WORDS('text')}[1] AS first FROM documents ORDER BY doc_id LIMIT 100")
def corpus_prefix(s, d):
    return logs.corpus_prefix(table(s, d, "documents"), 100, "doc_id").select("doc_id", F.get(T.words(F.col("text")), F.lit(0)).alias("first"))


@register("faithfulness_reader", flows.J("SELECT pipeline_class, avg(faithfulness) AS faithfulness FROM ratios WHERE dimension = 'conflict' AND faithfulness IS NOT NULL GROUP BY 1"))
def faithfulness_reader(s, d):
    at = folder(s, "ratios")
    flows.ratios(s, d).write.json(at)
    return judging.faithfulness_by_class(readers.read_ratios(s, at).unionByName(readers.read_ratios(s, f"{at}-missing")))


# --- corpora


def _streamed(s, d, limits, apply, what):
    """A corpus through the streaming source into a folder of files, started again for each limit; a row that came twice would be there twice."""
    at, corpus = folder(s, what), streams.reachable(s, f"{d}/documents.parquet")
    streams.CorpusSource.register(s)
    for limit in limits:
        rows = s.readStream.format("corpus").schema("i long, doc_id long, text string").option("path", corpus).option("limit", limit).load()
        apply(rows).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return s.read.parquet(f"{at}/rows")


@register("corpus_stream", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id, md5(text) AS text FROM documents WHERE doc_id < (SELECT count(*) // 2 FROM documents)")
def corpus_stream(s, d):
    """The first half of the documents as a stream that ends after a fifth of them, goes on to the half, and then has nothing more."""
    n = table(s, d, "documents").count()
    return _streamed(s, d, [n // 5, n // 2, n // 2], lambda rows: rows.select("i", "doc_id", F.md5(F.col("text").cast("binary")).alias("text")), "corpus")


_CONTEXTS = f"""c AS (SELECT doc_id AS i, {_WORDS('text')} AS w FROM documents WHERE doc_id < (SELECT count(*) * 9 // 10 FROM documents)),
k AS (SELECT i, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 7 = 0 THEN 'zzqqzz' ELSE lower(w[50]) END AS answer, [array_to_string(w[1:40], ' '), array_to_string(w[41:80], ' '), array_to_string(w[81:], ' ')] AS contexts, w FROM c),
h AS (SELECT *, list_filter([1, 2], lambda j: contains(lower(contexts[j]), answer))[1] AS hit FROM k WHERE answer IS NOT NULL),
f AS (SELECT *, list_filter(range(0, greatest(len(w) - 80, 0), 120), lambda s: len(w[81 + s : 200 + s]) >= 50 AND NOT contains(lower(array_to_string(w[81 + s : 200 + s], ' ')), answer)) AS starts,
    list_filter([1, 2, 3], lambda j: j <> hit AND array_to_string(w[40 * j - 39 : 40 * j - 4], ' ') <> '' AND NOT ({_MATCH('answer')} <> '' AND contains(' ' || {_MATCH("array_to_string(w[40 * j - 39 : 40 * j - 4], ' ')")} || ' ', ' ' || {_MATCH('answer')} || ' ')))[1] AS other
    FROM h WHERE hit IS NOT NULL)
SELECT 'tqa-' || i::varchar AS seed_id, answer, md5(contexts[hit]) AS passage, md5(array_to_string(w[40 * other - 39 : 40 * other - 4], ' ')) AS companion,
    md5(array_to_string(list_transform(starts[1:8], lambda s: array_to_string(w[81 + s : 200 + s], ' ')), '|')) AS extras FROM f"""


@register("context_corpus_seeds", f"WITH {_CONTEXTS}")
def context_corpus_seeds(s, d):
    """Seeds of a corpus of questions with contexts, streamed: two of forty words, and all that follows."""

    def seeds(rows):
        w = F.col("w")
        cut = [F.array_join(x, " ") for x in (F.slice(w, 1, 40), F.slice(w, 41, 40), F.slice(w, F.lit(81), F.greatest(F.size(w), F.lit(1))))]
        answer = F.when(F.col("i") % 5 == 0, F.lit(None)).when(F.col("i") % 7 == 0, "zzqqzz").otherwise(F.lower(F.get(w, F.lit(49))))
        return corpora.context_seeds(rows.select("i", T.words(F.col("text")).alias("w")).select("i", F.lit("q").alias("question"), answer.alias("answer"), F.array(*cut).alias("contexts")), limit, 120)[0]

    limit = _nine_tenths(s, d)
    made = _streamed(s, d, [limit], seeds, "contexts")
    text = lambda k: F.md5(F.get("passages", F.lit(k))["text"].cast("binary"))
    return made.select("seed_id", "answer", text(0).alias("passage"), text(1).alias("companion"), F.md5(F.array_join(F.transform("extra_passages", lambda p: p["text"]), "|").cast("binary")).alias("extras"))


_DOC = f"""c AS (SELECT doc_id AS i, {_WORDS('text')} AS w, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'zzqqzz' ELSE {_WORDS('text')}[10] END AS answer FROM documents WHERE doc_id < (SELECT count(*) * 9 // 10 FROM documents)),
r AS (SELECT *, CASE WHEN answer IS NULL THEN 'none' WHEN NOT contains(lower(array_to_string(w, ' ')), lower(answer)) THEN 'missing' END AS reason FROM c)"""


def _nine_tenths(s, d) -> int:
    return table(s, d, "documents").count() * 9 // 10


def _documents(s, d):
    w = F.col("w")
    answer = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, "zzqqzz").otherwise(F.get(w, F.lit(9)))
    rows = table(s, d, "documents").select("doc_id", T.words(F.col("text")).alias("w")).select(F.col("doc_id").alias("i"), F.lit("q").alias("question"), F.array(answer).alias("short_answers"), w.alias("tokens"))
    return corpora.document_seeds(rows, _nine_tenths(s, d), 60)


register("corpus_counts", f"WITH {_DOC} SELECT count(*) AS seen, count(*) FILTER (reason = 'none') AS no_short_answer, count(*) FILTER (reason = 'missing') AS answer_not_in_document, count(*) FILTER (reason IS NULL) AS kept FROM r")(lambda s, d: _documents(s, d)[1])
register("corpus_seeds", f"""WITH {_DOC}, x AS (SELECT *, list_filter(list_transform(range(0, len(w), 60), lambda k: array_to_string(w[k + 1 : k + 60], ' ')), lambda t: len({_WORDS('t')}) >= 50 AND NOT contains(lower(t), lower(answer)))[1:16] AS extras FROM r WHERE reason IS NULL)
SELECT 'nq-' || i::varchar AS seed_id, answer, len(extras) AS n_extras, md5(array_to_string(extras, '|')) AS extras FROM x""")(
    lambda s, d: _documents(s, d)[0].select("seed_id", "answer", F.size("extra_passages").alias("n_extras"), F.md5(F.array_join(F.transform("extra_passages", lambda p: p["text"]), "|").cast("binary")).alias("extras")))
