"""The boundary to models, with clients that answer by rules: what is asked, tried again, allowed and refused."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import python_udfs as P
from plumbline.operators import calls
from plumbline.sources.scratch import folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, sql):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


register("retryable_statuses", """WITH s AS (SELECT event_id, 200 + (event_id * 7) % 310 AS status FROM events)
SELECT event_id, status, CASE WHEN status > 299 THEN status IN (408, 409, 429, 500, 502, 503, 504) END AS again FROM s""")(
    lambda s, d: _events(s, d).select("event_id", (200 + F.col("event_id") * 7 % 310).alias("status")).withColumn("again", calls.retryable(F.col("status"))))


async def _client(row):
    """Fails for some requests: for good, in the first round, or in each."""
    if row["n"] == 4:
        raise calls.CallFailed(400, "no such model")
    if row["n"] == 7 or (row["n"] == 6 and row["round"] == 1):
        raise calls.CallFailed(503)
    return {"text": f"{row['key']} answered"}


def _requests(s, d):
    return _events(s, d).filter("event_id % 25 < 10").select((F.col("event_id") % 25).alias("n"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"))


_ASKED = "r AS (SELECT event_id % 25 AS n, 'k' || event_id::varchar AS key FROM events WHERE event_id % 25 < 10)"


@register("model_calls", f"WITH {_ASKED} SELECT key, CASE WHEN n IN (4, 7) THEN NULL ELSE key || ' answered' END AS text, CASE n WHEN 4 THEN 'CallFailed: status 400, no such model' WHEN 7 THEN 'CallFailed: status 503' END AS error FROM r")
def model_calls(s, d):
    """Calls of which some fail for good, some pass in the second round and some in none."""
    return calls.with_model(_requests(s, d), _client, "key string, text string, error string", width=8, rounds=2, base=0.0)


@register("calls_of_a_day", f"WITH {_ASKED}, m AS (SELECT count(*) AS n FROM r) SELECT n AS n_requests, n // 3 AS n_answered, n - n // 3 AS n_refused, n // 3 AS n_used FROM m")
def calls_of_a_day(s, d):
    """A day's cap of a third of the requests, over two jobs that share the ledger: together they never get more."""
    requests = _requests(s, d)
    n = requests.count()

    async def client(row):
        return {"text": "x"}

    ledger = calls.Ledger(s, folder(s, "ledger"), n // 3)
    half = requests.filter(F.xxhash64("key") % 2 == 0), requests.filter(F.xxhash64("key") % 2 != 0)
    out = [calls.with_model(part, client, "key string, text string, error string", width=4, ledger=ledger) for part in half]
    rows = out[0].unionByName(out[1])
    return rows.agg(F.count("*").alias("n_requests"), F.count("text").alias("n_answered"), F.count("error").alias("n_refused"), F.lit(ledger.used()).alias("n_used"))


@register("clients_of_roles", """WITH r AS (SELECT DISTINCT event_type AS role, ['own', 'paid', 'keyless', 'odd', 'none'][1 + length(event_type) % 5] AS service FROM events)
SELECT role, service, CASE service WHEN 'own' THEN 'https://h.example/v1' WHEN 'paid' THEN 'https://paid' WHEN 'keyless' THEN 'https://x' ELSE '' END AS base_url,
  CASE service WHEN 'keyless' THEN 'no key in NOT_SET' WHEN 'odd' THEN 'unknown kind strange' WHEN 'none' THEN 'unknown service none' END AS error FROM r""")
def clients_of_roles(s, d):
    """Roles by the kinds of events, each with a service: one whose URL is filled in, one with a key, and three that can't be used."""
    roles = [r["event_type"] for r in _events(s, d).select("event_type").distinct().collect()]  # a handful
    services = {"own": {"kind": "openai_compat", "base_url": "https://${HOST}/v1"}, "paid": {"kind": "google", "base_url": "https://paid", "api_key_env": "KEY"}, "keyless": {"kind": "anthropic", "base_url": "https://x", "api_key_env": "NOT_SET"}, "odd": {"kind": "strange"}}
    names = ["own", "paid", "keyless", "odd", "none"]
    config = {"providers": services, "generators": {r: {"provider": names[len(r) % 5], "model": "m", "family": "f"} for r in roles}}
    return calls.clients(s, config, {"HOST": "h.example", "KEY": "k"}).select("role", "service", "base_url", "error")


def _load_encoder():
    return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]


register("encoded_documents", "SELECT doc_id, [length(text)::float, (length(text) - length(replace(text, 'e', '')))::float] AS vector FROM documents")(
    lambda s, d: P.encoded(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), _load_encoder).select("doc_id", "vector"))


def _load_judge():
    def judge(premises, hypotheses):
        return [{"contradiction": 0.7, "entailment": 0.2, "neutral": 0.1} if len(a) < len(b) else {"entailment": 0.9, "contradiction": 0.1} for a, b in zip(premises, hypotheses)]

    return judge


@register("inferred_contradictions", """WITH t AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN b IS NULL THEN NULL WHEN length(a) < length(b) THEN 0.2::double ELSE 0.9::double END AS entailment, length(a) < length(b) AS contradicts FROM t""")
def inferred_contradictions(s, d):
    """Each turn as a premise, the next as the hypothesis; the last of a conversation has none."""
    rows = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    pairs = rows.withColumnRenamed("text", "premise").join(nxt, ["conv_id", "turn"], "left")
    made = P.predicted(pairs, _load_judge, ("entailment", "neutral", "contradiction"))
    return made.select("conv_id", "turn", F.col("nli.entailment").alias("entailment"), P.contradicts(F.col("nli")).alias("contradicts"))
