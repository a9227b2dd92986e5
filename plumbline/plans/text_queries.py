"""Text functions over literal fields dealt to the events, and over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T

QUERIES: dict = {}
SQL: dict[str, str] = {}

FIELDS = [
    ("The Eiffel Tower, 1889.", "1889"), ("It was completed in 1889", "in 1889"), ("King George III", "King George I"), ("", "x"), ("the", "a"), ("INSUFFICIENT EVIDENCE", "Paris"),
    ("  ", "Paris"), ("Not enough information to say.", "Paris"), ("I don't know", "42"), ("unknown", "42"), ("N/A", "42"), ("Paris", "paris"), ("The answer is paris, France", "Paris"),
    ("It cannot be determined from the passages", "Lyon"), ("no mention of it anywhere in these passages, but I would guess that the year was eighteen eighty nine or so", "1889"),
    ("The documents do not contain that and so the context is insufficient to say which of the two men it was", "Ann"), ("A man, a plan, a canal", "a man a plan canal"), ("well-known fact", "wellknown"),
    ("one two two three", "two two four"), ("unknown soldier", "unknown"),
]
RESPONSES = [
    "<final_answer>Paris</final_answer>", "x <final_answer> a </final_answer> then <FINAL_ANSWER>\nb\n</Final_Answer>", "INSUFFICIENT EVIDENCE", " <Insufficient Evidence>. ", "Therefore, the answer is:\n\n<INSUFFICIENT EVIDENCE>",
    "<Tina Turner></final_answer>", "<final_answer></final_answer>", "<score>3</score>", "text <SCORE> 4 </SCORE> <score>1</score>", "<score>7</score>", "NEXT_QUERY: \"who built it?\"\nmore", "NEXT_QUERY:   \nfoo", "plain prose with no mark",
    "<think>hm</think> Paris", "trace only</think>Lyon", "<think></think>x", "1. first\n2) second\n\n- third\n* \"fourth\"", "none", "1: 1\n2: 0\n3: 1", "1: 1\n1: 0\n2) 1", "2, 4 and 9, 2", "Label: REFUSAL", "this is an answer", "",
]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _pick(values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))


def fields(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", _pick([f for f, _ in FIELDS]).alias("field"), _pick([g for _, g in FIELDS]).alias("gold"))


def responses(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", _pick(RESPONSES).alias("raw"), (F.col("event_id") % 4).cast("int").alias("n"))


_F = f"""fields AS (SELECT event_id, [{', '.join(q(f) for f, _ in FIELDS)}][event_id % {len(FIELDS)} + 1] AS field, [{', '.join(q(g) for _, g in FIELDS)}][event_id % {len(FIELDS)} + 1] AS gold
    FROM events)"""
_R = f"responses AS (SELECT event_id, [{', '.join(q(r) for r in RESPONSES)}][event_id % {len(RESPONSES)} + 1] AS raw, (event_id % 4)::int AS n FROM events)"
WS = r"'\s+'"
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(?:a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"

register("answer_scores", f"""WITH {_F}, m AS (SELECT event_id, {_NORM('field')} AS p, {_NORM('gold')} AS g FROM fields), t AS (SELECT *, {_WORDS('p')} AS pw, {_WORDS('g')} AS gw FROM m)
SELECT event_id, p AS normalised, p = g AS exact, g <> '' AND regexp_matches(p, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(g) || '($|[^\\p{{L}}\\p{{N}}_])') AS contains, (p = g OR (g <> '' AND regexp_matches(p, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(g) || '($|[^\\p{{L}}\\p{{N}}_])'))) AS correct,
  CASE WHEN len(pw) = 0 OR len(gw) = 0 THEN (len(pw) = 0 AND len(gw) = 0)::int::double
    ELSE 2.0e0 * list_sum(list_transform(list_distinct(pw), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(gw, lambda y: y = x))))) / (len(pw) + len(gw)) END AS token_f1 FROM t""")(
    lambda s, d: fields(s, d).select("event_id", T.normalise_answer(F.col("field")).alias("normalised"), T.exact_match(F.col("field"), F.col("gold")).alias("exact"), T.contains_answer(F.col("field"), F.col("gold")).alias("contains"), T.token_f1(F.col("field"), F.col("gold")).alias("token_f1")).withColumn("correct", F.col("exact") | F.col("contains")))

_ABSTAIN = "regexp_matches(field, " + q("(?i)" + "|".join(f"(?:{p})" for p in T.ABSTENTIONS)) + ")"
register("refusal_rules", f"""WITH {_F}, f AS (SELECT event_id, trim(field) AS field
    FROM fields)
    SELECT event_id, CASE WHEN field = '' THEN 'unparseable' WHEN {_ABSTAIN} THEN 'refusal' ELSE 'answer' END AS category, field = '' OR NOT {_ABSTAIN} OR len({_WORDS('field')}) <= 15 AS confident
    FROM f""")(
    lambda s, d: fields(s, d).select("event_id", T.classify_field(F.col("field")).alias("v")).select("event_id", "v.category", "v.confident"))
register("unclassified_fields", f"WITH {_F}, f AS (SELECT event_id, trim(field) AS field FROM fields) SELECT event_id, field FROM f WHERE field <> '' AND {_ABSTAIN} AND len({_WORDS('field')}) > 15")(
    lambda s, d: fields(s, d).withColumn("field", F.trim("field")).filter(~T.classify_field(F.col("field")).getField("confident")).select("event_id", "field"))
_MARK = "CASE WHEN regexp_matches(t, '(?is)^[ .<>]*INSUFFICIENT EVIDENCE[ .<>]*$') THEN 'bare_sentinel' WHEN regexp_matches(t, '(?i)(?:^|\\n|:)\\s*<?\\s*INSUFFICIENT EVIDENCE\\s*>?\\s*[.]?\\s*$') THEN 'trailing_sentinel' WHEN i <> '' AND lower(i) <> 'final_answer' THEN 'malformed_open_tag' END"
_REC = f"r AS (SELECT event_id, trim(raw) AS t, trim(regexp_extract(trim(raw), '(?i)^<([^<>]{{1,120}})></final_answer>\\s*$', 1)) AS i FROM responses)"
register("recover_answers", f"""WITH {_R}, {_REC} SELECT event_id, CASE {_MARK} WHEN 'malformed_open_tag' THEN i WHEN 'bare_sentinel' THEN 'INSUFFICIENT EVIDENCE' WHEN 'trailing_sentinel' THEN 'INSUFFICIENT EVIDENCE' END AS answer, {_MARK} AS method
    FROM r""")(
    lambda s, d: responses(s, d).select("event_id", T.recover(F.col("raw")).alias("v")).select("event_id", "v.answer", "v.method"))
register("recovery_tallies", f"""WITH {_R}, {_REC} SELECT method, generator, count(*) AS n
    FROM (SELECT event_id % 2 AS generator, {_MARK} AS method
    FROM r)
    WHERE method IS NOT NULL
    GROUP BY GROUPING SETS ((method, generator), (method), ())""")(
    lambda s, d: responses(s, d).select((F.col("event_id") % 2).alias("generator"), T.recover(F.col("raw")).getField("method").alias("method")).filter("method IS NOT NULL").groupingSets([["method", "generator"], ["method"], []], "method", "generator").agg(F.count("*").alias("n")))
register("final_answers", f"WITH {_R} SELECT event_id, trim(regexp_extract_all(raw, '(?is)<final_answer>(.*?)</final_answer>', 1)[-1], ' ') AS answer FROM responses".replace(", ' ') AS", ") AS"))(
    lambda s, d: responses(s, d).select("event_id", T.final_answer(F.regexp_replace("raw", "\n", "")).alias("answer")))
SQL["final_answers"] = f"WITH {_R} SELECT event_id, trim(regexp_extract_all(replace(raw, chr(10), ''), '(?is)<final_answer>(.*?)</final_answer>', 1)[-1]) AS answer FROM responses"
register("rubric_scores", f"""WITH {_R} SELECT event_id, nullif(regexp_extract(raw, '(?i)<score>\\s*([0-4])\\s*</score>', 1), '')::int AS score
    FROM responses""")(lambda s, d: responses(s, d).select("event_id", T.rubric_score(F.col("raw")).alias("score")))
register("reply_labels", f"""WITH {_R} SELECT event_id, CASE WHEN contains(upper(raw), 'ANSWER') THEN 'answer' WHEN contains(upper(raw), 'REFUSAL') THEN 'refusal' WHEN contains(upper(raw), 'UNPARSEABLE') THEN 'unparseable' END AS label
    FROM responses""")(lambda s, d: responses(s, d).select("event_id", T.reply_label(F.col("raw")).alias("label")))
register("next_queries", f"""WITH {_R} SELECT event_id, nullif(trim(trim(regexp_extract(raw, 'NEXT_QUERY:[^\\S\\n]*([^\\n]*)', 1)), '\"'), '') AS query
    FROM responses""")(lambda s, d: responses(s, d).select("event_id", T.next_query(F.col("raw")).alias("query")))
register("sub_queries", f"""WITH {_R} SELECT event_id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(trim(trim(regexp_replace(trim(x), '^(?:\\d+\\s*[.)]|[-*•])\\s*', '')), '\"'))), lambda x: x <> '')[1:3] AS queries
    FROM responses""")(lambda s, d: responses(s, d).select("event_id", T.sub_queries(F.col("raw")).alias("queries")))
register("generated_questions", f"""WITH {_R} SELECT event_id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(trim(trim(regexp_replace(trim(x), '^(?:\\d+\\s*[.)]|[-*•])\\s*', '')), '\"'))), lambda x: x <> '') AS questions
    FROM responses""")(lambda s, d: responses(s, d).select("event_id", T.generated_questions(F.col("raw")).alias("questions")))
register("statements", f"""WITH {_R} SELECT event_id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(regexp_replace(trim(x), '^(?:\\d+\\s*[.)]|[-*•])\\s*', ''))), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^\\s*none\\s*\\.?\\s*$')) AS statements
    FROM responses""")(lambda s, d: responses(s, d).select("event_id", T.statements(F.col("raw")).alias("statements")))
_PAIRS = "list_transform(list_filter(regexp_split_to_array(raw, '\\r\\n|\\n|\\r'), lambda x: regexp_matches(x, '^\\s*\\d+\\s*[:.)-]\\s*[01]\\b')), lambda x: {'k': regexp_extract(x, '^\\s*(\\d+)', 1)::bigint, 'v': regexp_extract(x, '^\\s*\\d+\\s*[:.)-]\\s*([01])\\b', 1) = '1'})"
register("verdict_lists", f"""WITH {_R}, p AS (SELECT event_id, n, {_PAIRS} AS pairs FROM responses)
SELECT event_id, CASE WHEN list_sort(list_distinct(list_transform(pairs, lambda p: p.k))) = range(1, n + 1) THEN list_transform(range(1, n + 1), lambda i: list_filter(pairs, lambda p: p.k = i)[-1].v) END AS verdicts FROM p""")(lambda s, d: responses(s, d).select("event_id", T.verdicts(F.col("raw"), F.col("n")).alias("verdicts")))
register("selected_sentences", f"""WITH {_R} SELECT event_id, CASE WHEN regexp_matches(trim(raw), '(?i)^\\s*none\\s*\\.?\\s*$') THEN [] ELSE list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(raw, '(\\d+)', 1), lambda x: x::int), lambda i: i BETWEEN 1 AND n))) END AS selected
    FROM responses""")(lambda s, d: responses(s, d).select("event_id", T.selected_sentences(F.col("raw"), F.col("n")).alias("selected")))
register("reasoning_split", f"""WITH {_R} SELECT event_id, CASE WHEN regexp_matches(raw, '(?is)<think>.*?</think>') THEN trim(regexp_extract(raw, '(?is)^(.*?)<think>', 1) || regexp_extract(raw, '(?is)<think>.*?</think>(.*)$', 1)) WHEN regexp_matches(raw, '(?i)</think>') THEN trim(regexp_extract(raw, '(?is)^.*?</think>(.*)$', 1)) ELSE trim(raw) END AS answer,
  CASE WHEN regexp_matches(raw, '(?is)<think>.*?</think>') THEN nullif(trim(regexp_extract(raw, '(?is)<think>(.*?)</think>', 1)), '') WHEN regexp_matches(raw, '(?i)</think>') THEN nullif(trim(regexp_extract(raw, '(?is)^(.*?)</think>', 1)), '') END AS trace FROM responses""")(
    lambda s, d: responses(s, d).select("event_id", T.split_reasoning(F.col("raw"), F.lit(None).cast("string")).alias("v")).select("event_id", "v.answer", "v.trace"))


def docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


register("token_counts", f"""SELECT doc_id, len({_WORDS('text')}) AS n_tokens, CASE WHEN len({_WORDS('text')}) > 1000 THEN 'context budget exceeded: ' || len({_WORDS('text')})::varchar || ' tokens > 1000' END AS warning
    FROM documents""")(
    lambda s, d: docs(s, d).withColumn("n_tokens", T.word_count(F.col("text"))).select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 1000, F.concat(F.lit("context budget exceeded: "), F.col("n_tokens").cast("string"), F.lit(" tokens > 1000"))).alias("warning")))
_STRIP = lambda c: f"trim(regexp_replace(regexp_replace({c}, '</?[A-Za-z][^<>]{{0,80}}>', ' ', 'g'), '\\s+', ' ', 'g'))"
_MATCH = lambda c: f"trim(regexp_replace(regexp_replace(lower({_STRIP(c)}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
register("markup_stripped", f"SELECT page_id, md5({_STRIP('html')}) AS plain, md5({_MATCH('html')}) AS match_form FROM pages")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(T.strip_markup(F.col("html")).cast("binary")).alias("plain"), F.md5(T.match_form(F.col("html")).cast("binary")).alias("match_form")))
# the answer of a document is its tenth to twelfth word
_ANS = f"a AS (SELECT doc_id, text, {_WORDS('text')} AS w, array_to_string({_WORDS('text')}[10:12], ' ') AS answer FROM documents)"


def with_answer(s, d):
    return docs(s, d).select("doc_id", "text", F.array_join(F.slice(T.words(F.col("text")), 10, 3), " ").alias("answer"))


register("answer_windows", f"""WITH {_ANS}, p AS (SELECT *, lower(trim(answer)) AS needle, strpos(lower(text), lower(trim(answer))) AS place FROM a), b AS (SELECT *, CASE WHEN place > 0 THEN len({_WORDS('substr(text, 1, place - 1)')}) END AS pre FROM p),
c AS (SELECT *, array_to_string(w[greatest(0, pre - floor((40 - len({_WORDS('needle')})) / 2)::int) + 1 : greatest(0, pre - floor((40 - len({_WORDS('needle')})) / 2)::int) + 40], ' ') AS centred, array_to_string(w[pre + 1 : pre + 40], ' ') AS anchored FROM b)
SELECT doc_id, CASE WHEN needle <> '' AND place > 0 THEN CASE WHEN len(w) <= 40 THEN array_to_string(w, ' ') WHEN contains(lower(centred), needle) THEN centred WHEN contains(lower(anchored), needle) THEN anchored END END AS "window" FROM c""")(
    lambda s, d: with_answer(s, d).select("doc_id", T.answer_window(F.col("text"), F.col("answer"), 40).alias("window")))
register("context_windows", f"""WITH {_ANS} SELECT doc_id, unnest(list_filter(list_transform(range(0, len(w), 60), lambda s: CASE WHEN len(w[s + 1 : s + 60]) >= 50 THEN array_to_string(w[s + 1 : s + 60], ' ') END), lambda x: x IS NOT NULL AND (answer = '' OR NOT contains(lower(x), lower(trim(answer)))))[1:6]) AS "window" FROM a WHERE len(w) >= 50""")(
    lambda s, d: with_answer(s, d).select("doc_id", F.explode(T.context_windows(F.col("text"), F.col("answer"), 60)).alias("window")))
#: Sentences in DuckDB, which has no look-around: a mark is put where a text is cut.
_CUT = lambda t: f"string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_SENTENCES = lambda t: f"list_filter(list_transform(string_split(regexp_replace(trim({t}), '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
register("sentence_counts", f"""WITH x AS (SELECT doc_id, text, lower(trim(array_to_string({_WORDS('text')}[10:11], ' '))) AS needle FROM documents)
SELECT doc_id, len({_SENTENCES('text')}) AS n_sentences, trim(list_filter({_CUT('text')}, lambda s: needle <> '' AND contains(lower(s), needle))[1]) AS claim FROM x""")(lambda s, d: docs(s, d).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"), T.claim_sentence(F.col("text"), F.array_join(F.slice(T.words(F.col("text")), 10, 2), " ")).alias("claim")))
_TOK = "list_transform(regexp_extract_all(text, '([A-Za-z0-9'']+)', 1), lambda x: lower(x))"
register("ngram_counts", f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3]))) AS n_4grams
    FROM (SELECT doc_id, {_TOK} AS t
    FROM documents)""")(
    lambda s, d: docs(s, d).withColumn("t", T.alnum_tokens(F.col("text"))).select("doc_id", F.size("t").alias("n_tokens"), F.size(T.ngrams(F.col("t"), 4)).alias("n_4grams")))
register("boundary_matches", r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[5] AS needle FROM documents)
SELECT doc_id, coalesce(trim(needle) <> '' AND regexp_matches(strip_accents(lower(text)), '(^|[^\p{L}\p{N}_])' || regexp_escape(strip_accents(lower(trim(needle)))) || '($|[^\p{L}\p{N}_])'), false) AS on_boundary FROM w""")(
    lambda s, d: docs(s, d).select("doc_id", T.on_word_boundary(F.get(T.words(F.col("text")), F.lit(4)), F.col("text")).alias("on_boundary")))
_PARTS = f"CASE WHEN len(raw) >= 2 THEN list_transform(list_filter(raw, lambda r: length(regexp_replace(r, '[^A-Za-z'']', '', 'g')) >= 5 AND NOT contains(regexp_replace(r, '[^A-Za-z'']', '', 'g'), '''') AND (regexp_matches(r, '^\\p{{Lu}}') OR (upper(answer) = answer AND lower(answer) <> answer)) AND lower(regexp_replace(r, '[^A-Za-z'']', '', 'g')) NOT IN ({', '.join(q(w) for w in T.COMMON_ANSWER_WORDS)})), lambda r: lower(regexp_replace(r, '[^A-Za-z'']', '', 'g'))) ELSE [] END"
register("states_answer", f"""WITH x AS (SELECT doc_id, text, array_to_string({_WORDS('text')}[20:21], ' ') AS answer FROM documents), y AS (SELECT *, ' ' || {_MATCH('text')} || ' ' AS hay, {_MATCH('answer')} AS needle, {_WORDS('answer')} AS raw FROM x), z AS (SELECT *, {_MATCH("array_to_string(list_reverse(raw), ' ')")} AS inverted, {_PARTS} AS parts FROM y)
SELECT doc_id, needle <> '' AND (contains(hay, ' ' || needle || ' ') OR (len(raw) = 2 AND len(list_filter(raw, lambda t: NOT regexp_matches(t, '^\\p{{L}}+$'))) = 0 AND inverted <> needle AND contains(hay, ' ' || inverted || ' ')) OR len(list_filter(parts, lambda p: contains(hay, ' ' || p || ' '))) > 0) AS states, parts FROM z""")(
    lambda s, d: docs(s, d).withColumn("answer", F.array_join(F.slice(T.words(F.col("text")), 20, 2), " ")).select("doc_id", T.states_answer(F.col("text"), F.col("answer")).alias("states"), T.distinctive_parts(F.col("answer")).alias("parts")))
register("evidence_blocks", """SELECT conv_id, md5(string_agg('[' || rn::varchar || '] ' || text, chr(10) || chr(10)
    ORDER BY rn)) AS block, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn) AS rn
    FROM conversations
    WHERE text IS NOT NULL)
    GROUP BY 1""")(
    lambda s, d: s.read.parquet(f"{d}/conversations.parquet").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.md5(T.numbered(F.transform("t", lambda x: x["text"])).cast("binary")).alias("block"), F.size("t").alias("n")))
register("json_paths", """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS varchar) AS k
    FROM events""")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k")))
