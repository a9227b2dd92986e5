"""What meets the outside: providers, configuration, ledgers, sinks and streams; and operators that were planned for large groups."""

import asyncio
import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.operators import building, calls, ranking, replay, runs, validity
from plumbline.sources import artefacts
from plumbline.sources.cache import Cache
from plumbline.streaming import logs


def test_statuses_and_delays(spark):
    df = spark.createDataFrame([(1, 503), (2, 204), (3, 200), (9, 400), (20, 429)], "k int, status int")
    assert [tuple(r) for r in df.select(calls.backoff(F.col("k"), jitter=F.lit(0.5)), calls.retryable(F.col("status"))).collect()] == [(0.25, True), (0.5, None), (1.0, None), (15.0, False), (15.0, True)]
    with pytest.raises(Exception, match="numbered from 1"):
        df.select(calls.backoff(F.col("k") - 1)).collect()
    failures = [calls.CallFailed(429, "slow"), TimeoutError(), ConnectionResetError(), calls.CallFailed(404, "no model"), ValueError("v")]
    assert [calls.may_pass(e) for e in failures] == [True, True, True, False, False] and str(failures[3]) == "status 404, no model"


class Service:
    """Counts calls and how many run at a time, over all tasks, by files of a folder; key i fails as often as `fails` says."""

    def __init__(self, at, fails=None, error=None):
        self.at, self.fails, self.error = str(at), fails or {}, error

    async def __call__(self, row):
        with open(f"{self.at}/{row['key']}-{uuid.uuid4().hex}.open", "w"):
            pass
        running = len([x for x in os.listdir(self.at) if x.endswith(".open")])
        with open(f"{self.at}/{uuid.uuid4().hex}.{running}.seen", "w"):
            pass
        await asyncio.sleep(0.03)
        mine = [x for x in os.listdir(self.at) if x.startswith(f"{row['key']}-")]
        tries = len(mine)
        for x in mine:
            if x.endswith(".open"):
                os.rename(f"{self.at}/{x}", f"{self.at}/{x}.done")
        if tries <= self.fails.get(row["key"], 0):
            raise self.error
        return {"text": f"{row['key']}!"}

    def calls(self):
        return len([x for x in os.listdir(self.at) if x.endswith(".done")])

    def most(self):
        return max(int(x.split(".")[1]) for x in os.listdir(self.at) if x.endswith(".seen"))


REPLY = "key string, text string, error string"


def test_only_what_may_pass_is_asked_again(spark, tmp_path):
    requests = spark.range(12).select(F.col("id").cast("string").alias("key"))
    told, waits = [], []
    for name, error, tries in (("passes", calls.CallFailed(503), {"3": 2, "5": 9}), ("stays", calls.CallFailed(400, "bad"), {"3": 2, "5": 9})):
        (tmp_path / name).mkdir()
        service = Service(tmp_path / name, tries, error)
        out = {r.key: (r.text, r.error) for r in calls.with_model(requests, service, REPLY, width=3, progress=told.append, sleep=waits.append).collect()}
        good = "3" if name == "passes" else None
        assert len(out) == 12 and all(out[str(i)] == (f"{i}!", None) for i in range(12) if i not in (3, 5) or str(i) == good) and "status" in out["5"][1]
        assert service.calls() == (12 + 2 + 3 if good else 12) and service.most() <= 3
    assert [t["open"] for t in told] == [2, 2, 1, 0, 0] and told[-1]["failed"] == 2 and told[3] == {"round": 4, "answered": 11, "failed": 1, "refused": 0, "open": 0}
    assert len(waits) == 3 and all(0 <= w <= calls.BASE_S * 2**i for i, w in enumerate(waits))
    assert calls.with_model(requests.limit(0), Service(tmp_path), REPLY).count() == 0


def test_a_day_of_calls_is_shared_by_rounds_tasks_and_jobs(spark, tmp_path):
    """Never more calls than the day allows, whatever the number of tasks, retries and jobs; a day later there are as many again."""
    now = [1000.0]
    (tmp_path / "calls").mkdir()
    service = Service(tmp_path / "calls", {"0": 1, "1": 1}, TimeoutError("slow"))
    day = lambda: calls.Ledger(spark, f"file://{tmp_path}/ledger", 9, clock=lambda: now[0])
    requests = spark.range(6).select(F.col("id").cast("string").alias("key")).repartition(4)
    first = calls.with_model(requests, service, REPLY, width=4, ledger=day(), sleep=lambda s: None).collect()
    assert all(r.error is None for r in first) and service.calls() == 8
    told = []
    more = calls.with_model(requests.selectExpr("key || 'x' AS key"), service, REPLY, width=4, ledger=day(), progress=told.append).collect()
    assert len(more) == 6 and sum(r.error is None for r in more) == 1 and service.calls() == 9 and all("9 calls" in r.error for r in more if r.error) and told[0]["refused"] == 5
    assert all(r.error for r in calls.with_model(requests, service, REPLY, ledger=day()).collect()) and service.calls() == 9
    now[0] += calls.DAY_S
    assert day().used() == 0 and all(r.error is None for r in calls.with_model(requests, service, REPLY, ledger=day()).collect()) and service.most() <= 4


def test_clients_of_a_configuration(spark, tmp_path):
    config = {"providers": {"own": {"kind": "openai_compat", "base_url": "https://${HOST}/v1"}, "g": {"kind": "google", "api_key_env": "KEY", "requests_per_day": 10}, "odd": {"kind": "x"}}, "generators": {"standard_1": {"provider": "own", "model": "m", "family": "f", "base_url": "https://other/v1"}, "two": {"provider": "own", "model": "m", "family": "f"}}, "judge": {"provider": "g", "model": "j", "family": "h", "supports_thinking": True}, "bad": {"provider": "none"}, "worse": {"provider": "odd"}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    config = artefacts.read_config(spark, f"file://{tmp_path}/c.json")
    of = lambda env: {r.role: r for r in calls.clients(spark, config, env).collect()}
    bare, full = of({}), of({"HOST": "h", "KEY": "k"})
    assert set(bare) == {"standard_1", "two", "judge", "bad", "worse"}
    assert {r: x.error for r, x in bare.items()} == {"standard_1": None, "two": "HOST not set", "judge": "no key in KEY", "bad": "unknown service none", "worse": "unknown kind x"}
    assert full["standard_1"].base_url == "https://other/v1" and full["two"].base_url == "https://h/v1" and full["two"].error is None
    assert (full["judge"].per_day, full["judge"].width, full["judge"].thinks, full["judge"].cot_prompt, full["judge"].error, full["judge"].api_key_env) == (10, 4, True, False, None, "KEY")
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        artefacts.read_config(spark, f"file://{tmp_path}/l.json")
    (tmp_path / "broken.json").write_text("{")
    assert artefacts.read_optional(spark, f"file://{tmp_path}/broken.json") is None and artefacts.read_optional(spark, f"file://{tmp_path}/none.json") is None and artefacts.read_optional(spark, f"file://{tmp_path}/l.json") == [1]


def test_cache_store(spark, tmp_path):
    """A put writes the buckets of its keys alone; the newest row of a key stays, failures are refused, and answers read through it are there afterwards."""
    fields = "key string, created_at long, text string, error string"
    rows = [(f"k{i % 200}", i, f"t{i}", "late" if i % 11 == 0 else None) for i in range(500)] + [(None, 1, "x", None)]
    df = spark.createDataFrame(rows, fields)
    store = Cache(spark, f"file://{tmp_path}/cache", df.drop("error").schema, buckets=16)
    assert store.read().count() == 0 and store.put(df.limit(0)) == [] and store.lookup(df.select("key")).filter("hit").count() == 0
    assert store.put(df.filter("created_at < 400")) == list(range(16))
    before = {b: store.generations(b) for b in range(16)}
    touched = store.put(df.filter("created_at IN (400, 401, 407)"))
    assert 0 < len(touched) <= 3 and all(len(store.generations(b)) == 1 + (b in touched) and store.generations(b)[:1] == before[b] for b in range(16))
    store.put(df.filter("created_at > 401"))
    store.put(df.filter("created_at < 100"))  # older rows change nothing
    want = {}
    for k, at, text, error in rows:
        if k and not error:
            want[k] = text
    assert {r.key: r.text for r in store.read().collect()} == want and all(len(store.generations(b)) <= 2 for b in range(16))
    assert {r.key: r.text for r in store.get("k3", "none").collect()} == {"k3": want["k3"]} and store.get().count() == 0
    found = {r.key: (r.hit, r.text) for r in store.lookup(spark.createDataFrame([("k5",), ("new",)], "key string")).collect()}
    assert found == {"k5": (True, want["k5"]), "new": (False, None)}

    async def call(row):
        if row["key"] == "bad":
            raise calls.CallFailed(401)
        return {"text": "fresh"}

    for expected in ("fresh", "fresh"):
        answers, fresh = calls.read_through(spark.createDataFrame([("k5",), ("new",), ("bad",)], "key string"), store, call, REPLY)
        got = {r.key: r.text for r in answers.collect()}
        assert got == {"k5": want["k5"], "new": expected, "bad": None}
    assert fresh.count() == 0 and {r.key for r in store.get("new", "bad").collect()} == {"new"}


def test_preflight():
    async def good(row):
        return {"text": "OK"}

    async def failed(row):
        raise calls.CallFailed(503)

    assert calls.preflight(good) is None and "503" in calls.preflight(failed)


def test_ledger_and_claims():
    artefact = {"a": {"b": [0.12344, "x"]}}
    rows = [("1", "0.1234", "f", "a.b.0"), ("2", "0.1236", "f", "a.b.0"), ("3", "x", "f", "a.b.1"), ("4", "1", "f", "a.c"), ("5", "1", "g", "a")]
    assert [m.split(":")[0] for m in artefacts.ledger_mismatches(rows, {"f": artefact})] == ["2", "4", "5"]
    nine = [{"statistically_significant": i < 6, "practically_significant": False} for i in range(9)]
    good = "Six of nine are statistically\nsignificant; none of nine clears the practical threshold. 6 of nine exclude zero. Many of nine."
    assert artefacts.claim_mismatches(good, nine) == []
    assert len(artefacts.claim_mismatches("Five of nine exclude zero. Two of nine are practically significant.", nine)) == 2


def test_nearest_ranks_against_sorting(spark):
    r = random.Random(2)
    rows = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 999), ("d", 5000)) for v in [float(r.choice([1, 2, 3, 50, r.random() * 100])) for _ in range(n)]] + [("e", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for accuracy in (10_000, 20):
        got = {x.g: x for x in runs.nearest_rank(df, ["g"], "v", shares, accuracy).collect()}
        for g in "abcd":
            v = sorted(x for k, x in rows if k == g and x is not None)
            assert all(got[g][name] == v[max(1, -(-len(v) * round(p * 100) // 100)) - 1] for name, p in shares.items()), (g, accuracy)
        assert "e" not in got


def test_walks_against_plain_loops(spark):
    r = random.Random(4)
    rows = [(g, i, r.random() < 0.3) for g in range(3) for i in range(60)]
    for first, then, group in ((5, 4, ["g"]), (100, 4, ["g"]), (9, 2, [])):
        got = {(x.g, x.i, x.role) for x in ranking.consume_until(spark.createDataFrame(rows, "g int, i int, ok boolean"), ["i", "g"], "ok", first, then, group).collect()}
        want = set()
        for own in [[x for x in rows if x[0] == g] for g in range(3)] if group else [rows]:
            k, left = 0, None
            for g, i, ok in sorted(own, key=lambda x: (x[1], x[0])):
                if left is None and ok:
                    k += 1
                    want.add((g, i, "found"))
                    left = then if k == first else None
                elif left:
                    want.add((g, i, "control"))
                    left -= 1
        assert got == want


def test_state_over_many_batches(spark, tmp_path):
    """Files in any order of their lines, the query started again for each: the last line of a key stays, and a batch gives only what it changed."""
    src, cp = tmp_path / "src", f"{tmp_path}/cp"
    src.mkdir()
    changed = []
    lines = [3, 0, 5, 1, 4, 2]
    for k, line in enumerate(lines):
        (src / f"{k}.json").write_text("".join(json.dumps({"key": f"k{x}", "error": str(line), "latency_s": line}) + "\n" for x in range(20) if (x + line) % 3) + '{"key": "k0", "error": "none"}\n')
        logs.last_state(logs.read_log_stream(spark, str(src), files_per_trigger=1), cp, order="latency_s", changed=lambda rows, n: changed.append((n, rows.count()))).awaitTermination()
    got = {r.key: int(r.error) for r in logs.newest_state(spark, cp).collect()}
    assert got == {f"k{x}": max(k for k in range(6) if (x + k) % 3) for x in range(20)}
    best, want = {}, []
    for line in lines:
        new = {x for x in range(20) if (x + line) % 3 and best.get(x, -1) < line}
        best.update(dict.fromkeys(new, line))
        want.append(len(new) + (not want and 0 not in new))
    assert [c for _, c in sorted(changed)] == want


def test_scored_once_prefers_the_last_good_row(spark, tmp_path):
    src, out, cp = tmp_path / "src", f"{tmp_path}/out", f"{tmp_path}/cp"
    src.mkdir()
    batches = [[("a", "bad", 9), ("a", None, 2), ("a", None, 5), ("b", "bad", 1), ("d", None, 1)], [("a", None, 8), ("b", None, 2), ("c", None, None)], [("c", None, 1), ("b", None, 7)]]
    known = spark.createDataFrame([("d",), ("z",)], "key string")
    for k, rows in enumerate(batches):
        (src / f"{k}.json").write_text("".join(json.dumps({"key": x, "error": e, "latency_s": n}) + "\n" for x, e, n in rows))
        for _ in range(2):
            stream = logs.read_log_stream(spark, str(src), files_per_trigger=1)
            logs.score_new(stream, lambda x: x.select("key", "latency_s"), out, cp, order="latency_s", ready=F.col("error").isNull(), scored=known).awaitTermination()
    assert sorted((r.key, r.latency_s) for r in spark.read.parquet(out).collect()) == [("a", 5.0), ("b", 2.0), ("c", None)]
    assert all(spark.conf.get(k, None) != v for k, v in logs.STORE.items())


def test_corpus_source(spark, tmp_path):
    """Files of several row groups; a stream that is started again goes on where it ended, also when files are added; files put before are an error."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from plumbline.sources import streams

    streams.CorpusSource.register(spark)
    src, cp, out = tmp_path / "corpus", f"{tmp_path}/cp", f"{tmp_path}/out"
    (src / "part").mkdir(parents=True)
    put = lambda name, first, n: pq.write_table(pa.table({"text": [None if x % 9 == 0 else f"t{x}" for x in range(first, first + n)], "other": [1] * n}), src / name, row_group_size=4)
    put("a.parquet", 0, 10), put("b.parquet", 10, 0), put("part/c.parquet", 10, 7), put("_hidden.parquet", 99, 3)
    rows = lambda r, limit: r.format("corpus").option("path", f"file://{src}").option("limit", limit).load()
    assert rows(spark.read, 0).count() == 0 and rows(spark.read, 6).columns == ["i", "text", "other"]
    assert [tuple(r) for r in rows(spark.read, 99).select("i", "text").orderBy("i").collect()] == [(i, None if i % 9 == 0 else f"t{i}") for i in range(17)]

    def run(limit):
        rows(spark.readStream.schema("text string, i long"), limit).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.i for r in spark.read.parquet(out).collect())

    assert run(6) == list(range(6)) and run(6) == list(range(6)) and run(20) == list(range(17))
    put("part/d.parquet", 17, 9)
    assert run(20) == list(range(20)) and run(23) == list(range(23))
    assert spark.read.parquet(out).filter("i = 21").first().text == "t21"
    put("a0.parquet", 50, 2)
    with pytest.raises(Exception, match="no longer ends in"):
        run(25)


def test_smoke_slice_and_choice(spark):
    rows = [(f"refusal-{i:02d}", "<<NO_ANSWER_SUPPORTED>>" if i in (0, 1) else "x", "refusal", f"s{i}") for i in range(12)] + [(f"conflict-{i}", "x", "conflict", f"s{i}") for i in range(9)] + [(f"noise-s{i}-r{k}", "x", "noise", f"s{i}") for i in range(9) for k in range(5)]
    got = {r.case_id for r in building.smoke_slice(spark.createDataFrame(rows, "case_id string, answer string, dimension string, seed_id string"), 6).collect()}
    assert sum(x.startswith("refusal") for x in got) == 6 and {"refusal-00", "refusal-01"} <= got and sum(x.startswith("conflict") for x in got) == 6 and sum(x.startswith("noise") for x in got) == 30
    with pytest.raises(ValueError):
        building.weighted_choice(F.lit(0.5), [("a", 0.0)])
    shares = spark.range(4000).select(building.weighted_choice(building.uniform(1, "id"), [("a", 1), ("b", 3)]).alias("k")).groupBy("k").count().collect()
    assert abs({r.k: r["count"] for r in shares}["b"] / 4000 - 0.75) < 0.03


def test_keys_tell_requests_apart(spark):
    import hashlib

    df = spark.createDataFrame([("é \"x\"",)], "p string")
    key = df.select(replay.request_key(F.lit("m"), F.lit("f"), replay.request(F.col("p"), max_tokens=16, seed=3, stop=["a"]))).first()[0]
    body = {"model": "m", "family": "f", "prompt": "é \"x\"", "system": None, "max_tokens": 16, "temperature": 0.0, "seed": 3, "thinking": False, "stop": ["a"]}
    assert key == hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def test_artefacts_are_flagged(spark):
    same = [(f"c{i}", f"one two three four five {i} its own words here w{i}", f"one two three four five {i} its own words here v{i}") for i in range(8)]
    clean = validity.artefact_report(spark.createDataFrame(same, "case_id string, original string, generated string"), (4,)).first()
    assert clean.verdict.startswith("no artefact") and clean.n_pairs == 8 and 0 < clean.mean_edit < 0.2
    stock = [(i, o, "verily as it is known " + g.split()[-1]) for i, o, g in same]
    flagged = validity.artefact_report(spark.createDataFrame(stock, "case_id string, original string, generated string"), (4,)).first()
    assert len(flagged.flags) >= 2 and flagged.n_rewritten == 8
    assert validity.artefact_report(spark.createDataFrame([], "case_id string, original string, generated string"), (4,)).count() == 0


def test_resamples_against_plain_draws(spark):
    """Values of resamples, NULL groups included, against drawing unit by unit."""
    import hashlib

    from plumbline.operators import inference

    r = random.Random(9)
    rows = [(g, f"u{i}", r.randint(0, 4), 1) for g in ("a", "b", None) for i in range(r.randint(5, 12)) for _ in range(2)]
    df = spark.createDataFrame(rows, "pipeline_class string, case_id string, crs_score int, n int").withColumn("dimension", F.lit("conflict"))
    got = {x.pipeline_class: x for x in inference.intervals(df, "crs", ["pipeline_class"], resamples=50, seed=3).collect()}
    for g in ("a", "b"):
        units = {}
        for k, u, score, _ in rows:
            if k == g:
                s, n = units.get(u, (0, 0))
                units[u] = s + score, n + 1
        order, values = sorted(units.values()), []
        for b in range(50):
            own = [order[int(hashlib.md5(f"3|{g}|{b}|{j // 4}".encode()).hexdigest()[8 * (j % 4) : 8 * (j % 4) + 8], 16) % len(order)] for j in range(len(order))]
            values.append(sum(s for s, _ in own) / sum(n for _, n in own))
        values.sort()
        at = lambda q: values[int(q * 49)] + (q * 49 - int(q * 49)) * (values[min(49, int(q * 49) + 1)] - values[int(q * 49)])  # noqa: E731, B023
        assert got[g].lower == pytest.approx(at(0.025)) and got[g].upper == pytest.approx(at(0.975))


def test_corpora_by_hand(spark):
    from plumbline.sources import corpora

    long = " ".join(f"w{i}" for i in range(200))
    rows = [(0, "q0", ["Paris"], ("It is PARIS here . " + long).split()), (1, "q1", [], ["x"]), (2, "q2", None, ["x"]), (3, "q3", ["Rome"], ["no", "such"]), (4, "q4", ["Paris"], ["Parisian"]), (9, "q9", ["x"], ["x"])]
    seeds, counts = corpora.document_seeds(spark.createDataFrame(rows, "i long, question string, short_answers array<string>, tokens array<string>"), 5, 60)
    assert counts.first().asDict() == {"seen": 5, "no_short_answer": 2, "answer_not_in_document": 1, "kept": 2}
    got = {r.seed_id: r for r in seeds.collect()}
    assert set(got) == {"nq-0", "nq-4"} and got["nq-0"].passages[0].is_answer_bearing and not got["nq-4"].passages[0].is_answer_bearing
    assert [p.passage_id for p in got["nq-0"].extra_passages] == ["nq-0-x0", "nq-0-x1"] and all("paris" not in p.text.lower() for p in got["nq-0"].extra_passages)
    rows = [(0, "q0", "Anakin Skywalker", ["nothing here", "then Anakin Skywalker came " + long, "Anakin alone", "another " + long]), (1, "q1", "", ["x"]), (2, "q2", "a", []), (3, "q3", "b", None), (4, "q4", "Rome", ["no"]), (5, "q5", "one", ["just one"])]
    seeds, counts = corpora.context_seeds(spark.createDataFrame(rows, "i long, question string, answer string, contexts array<string>"), 6, 60)
    assert counts.first().asDict() == {"seen": 6, "no_answer_or_context": 3, "answer_not_in_context": 1, "kept": 2}
    got = {r.seed_id: r for r in seeds.collect()}
    assert [p.text for p in got["tqa-0"].passages][1] == "nothing here" and got["tqa-0"].passages[0].is_answer_bearing and len(got["tqa-0"].passages[0].text.split()) <= 42
    assert len(got["tqa-5"].passages) == 1 and got["tqa-5"].passages[0].text == "just one" and all(p.passage_id.startswith("tqa-0-x") for p in got["tqa-0"].extra_passages)


def test_context_seeds_compute_a_hit_once(spark):
    """A filter that was pushed below the hit cut every context again, at each place in which the hit stood."""
    from plumbline.functions import text as T
    from plumbline.sources import corpora

    long = " ".join(f"w{i}" for i in range(100))
    rows = [(0, "q", "Rome", ["no", f"{long} rome {long}", f"Rome {long}"]), (1, "q", "Rome", [" \n Romes ", "Rome in  Italy", "a b"]), (2, "q", "İ x", [f"İİİ {long} İ x {long}"]), (3, "q", "zz", ["a", "b"]), (4, "q", " ", ["a"])]
    seeds, counts = corpora.context_seeds(spark.createDataFrame(rows, "i long, question string, answer string, contexts array<string>"), 9, 20)
    filters = [x for x in seeds._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("split(" in x for x in filters)
    assert counts.first().asDict() == {"seen": 5, "no_answer_or_context": 0, "answer_not_in_context": 2, "kept": 3}
    got = {r.seed_id: [p.text for p in r.passages] for r in seeds.collect()}
    assert got["tqa-0"] == [" ".join([*(f"w{i}" for i in range(94, 100)), "rome", *(f"w{i}" for i in range(7))]), "no"]
    assert got["tqa-1"] == ["Romes", "a b"] and "İ x" in got["tqa-2"][0] and len(got["tqa-2"]) == 1
    texts = spark.createDataFrame([(t,) for t in ("", " ", "a", "  a b", "a b c d ", "a\n\nb\tc d e", None)], "t string")
    assert all(x.a == x.b for x in texts.select(T.first_words(F.col("t"), 3).alias("a"), F.slice(T.words(F.col("t")), 1, 3).alias("b")).collect())


def test_document_seeds_compute_a_window_once(spark):
    """A filter that was pushed below the window split every document again, at each place in which the window stood."""
    from plumbline.sources import corpora

    long = [f"w{i}" for i in range(200)]
    rows = [(0, "q", ["Rome"], [*long, "to", "ROME", *long]), (1, "q", ["x y"], ["x y", "", " z\n"]), (2, "q", ["İ a"], ["İİİ", *long, "İ", "a", *long]), (3, "q", ["zz"], long), (4, "q", [""], long), (5, "q", [None], None), (6, "q", ["a"], None)]
    seeds, counts = corpora.document_seeds(spark.createDataFrame(rows, "i long, question string, short_answers array<string>, tokens array<string>"), 9, 60)
    filters = [x for x in seeds._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("split(" in x for x in filters)
    assert counts.first().asDict() == {"seen": 7, "no_short_answer": 2, "answer_not_in_document": 2, "kept": 3}
    got = {r.seed_id: r for r in seeds.collect()}
    assert got["nq-0"].passages[0].text == " ".join([*long[172:], "to", "ROME", *long[:30]]) and got["nq-1"].passages[0].text == "x y z"
    assert "İ a" in got["nq-2"].passages[0].text and [p.text for p in got["nq-0"].extra_passages][:3] == [" ".join(long[k : k + 60]) for k in (0, 60, 120)] and len(got["nq-0"].extra_passages) == 5


def test_corpus_from_a_store_that_only_spark_opens(spark, tmp_path):
    from plumbline.sources import streams

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    for k in range(3):
        spark.range(9 - 3 * k).select((F.col("id") * 7 % 10 + 10 * k).alias("doc_id"), F.lit("x").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/made{k}")
        (part,) = (tmp_path / f"made{k}").glob("*.parquet")
        (tmp_path / "docs").mkdir(exist_ok=True)
        part.rename(tmp_path / "docs" / f"part-{k}.parquet")
    streams.CorpusSource.register(spark)
    read = lambda path: [tuple(r) for r in spark.read.format("corpus").schema("i long, doc_id long, text string").option("path", path).option("limit", 14).load().orderBy("i").collect()]
    assert streams.reachable(spark, f"{tmp_path}/docs") == f"{tmp_path}/docs"
    want = read(f"{tmp_path}/docs")
    assert len(want) == 14 and read(streams.reachable(spark, "viewfs://store/in/docs")) == want
