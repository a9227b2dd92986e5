import hashlib
import json
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import python_udfs as P
from plumbline.functions import text as T
from plumbline.operators import calls, ranking, retrieval, runs, testbeds, validity
from plumbline.sources import readers
from plumbline.streaming import logs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("v")).first().v


@pytest.mark.parametrize(("needle", "hay", "want"), [("King George I", "King George III", False), ("café", "the café.", True), ("caf", "the café", False), ("", "x", False), ("a.b", "x a.b y", True), (r"\E", r"x \E y", True), (None, "x", False)])
def test_word_boundary(spark, needle, hay, want):
    assert one(spark, T.on_word_boundary(F.col("n"), F.col("h")), n=needle or ("" if needle == "" else None), h=hay) is want


@pytest.mark.parametrize(("p", "g", "want"), [("", "", 1.0), ("the", "a", 1.0), ("", "x", 0.0), ("one two two three", "two two four", 4 / 7), ("x", "y", 0.0)])
def test_token_f1(spark, p, g, want):
    assert one(spark, T.token_f1(F.col("p"), F.col("g")), p=p, g=g) == pytest.approx(want)


@pytest.mark.parametrize(("field", "category", "confident"), [(None, "unparseable", True), (" ", "unparseable", True), ("I don't know", "refusal", True), ("It is unknown " + "x " * 20, "answer", True), ("not enough evidence " + "x " * 20, "refusal", False), ("Paris", "answer", True)])
def test_field_classes(spark, field, category, confident):
    v = one(spark, T.classify_field(F.col("f")), f=field)
    assert (v.category, v.confident) == (category, confident)


@pytest.mark.parametrize(("text", "n", "want"), [("1: 1\n2: 0\n3: 1", 3, [True, False, True]), ("1: 1\n3: 1", 2, None), ("1: 0\n1: 1", 1, [True]), ("", 0, []), ("1. 1 yes\n2) 0", 2, [True, False]), ("2: 1\n1: 0", 2, [False, True])])
def test_verdicts(spark, text, n, want):
    assert one(spark, T.verdicts(F.col("t"), F.col("n")), t=text, n=n) == want


def test_window_holds_the_answer(spark):
    text = "left " * 200 + "PARIS " + "right " * 200
    v = one(spark, T.answer_window(F.col("t"), F.col("a"), 50), t=text, a="paris").split()
    assert len(v) == 50 and "PARIS" in v and "left" in v and "right" in v
    assert one(spark, T.answer_window(F.col("t"), F.col("a"), 50), t=text, a="rome") is None


def test_sentences_and_alignment(spark):
    assert one(spark, T.sentences(F.col("t")), t='One. Two? "Three!" four. 5 six') == ["One.", "Two?", '"Three!" four.', "5 six"]
    assert one(spark, T.aligned_sentence(F.col("g"), F.col("p")), g="It was in 1771. It was in 1769. No.", p="It was in 1768.") == "It was in 1771."
    assert one(spark, T.claim_sentence(F.col("g"), F.col("p")), g="A b. C Paris d. Paris.", p=" paris ") == "C Paris d."


def test_sentences_keep_digits_at_their_ends(spark):
    assert one(spark, T.sentences(F.col("t")), t="007 came. 1 1 left. 2 a 2") == ["007 came.", "1 1 left.", "2 a 2"]
    assert one(spark, T.aligned_sentence(F.col("g"), F.col("p")), g="0997 b. 1 c 1! 2", p="c") == "1 c 1!"
    assert one(spark, T.aligned_sentence(F.col("g"), F.col("p")), g="  0997 b.  c!", p="x") == "0997 b."


def test_inverted_names_and_parts(spark):
    assert one(spark, T.states_answer(F.col("t"), F.col("a")), t="by Sparks , Nicholas (1999)", a="Nicholas Sparks")
    assert one(spark, T.states_answer(F.col("t"), F.col("a")), t="the <I>Double</I>", a="The Double")
    assert not one(spark, T.states_answer(F.col("t"), F.col("a")), t="1978 in music", a="in 1978")
    assert one(spark, T.states_answer(F.col("t"), F.col("a")), t="Anakin came", a="Anakin Skywalker")


def test_python_functions(spark):
    import unicodedata

    odd = "é ﬁ Å ½ 가 ạ̈"
    folded = "".join(c for c in unicodedata.normalize("NFKD", odd) if not unicodedata.combining(c))
    assert one(spark, T.fold_accents(F.col("t")), t=odd) == folded and one(spark, T.fold_accents(F.col("t")), t="plain") == "plain"
    assert one(spark, P.edit_fraction("a", "b"), a="a b c d", b="a x c d") == pytest.approx(0.25)
    assert one(spark, P.edit_fraction("a", "b"), a="", b="!") == 0 and one(spark, P.edit_fraction("a", "b"), a="x", b="") == 1
    assert one(spark, P.repair_markup("t"), t="5 < 6 <TD>a</TABLE>") == "5 &lt; 6 <table><tr><td>a</td></tr></table>"
    v = one(spark, P.sentence_diff("a", "b"), a="Same. It was 1889.", b="Same. It was 1934.")
    assert (v.removed, v.added) == ("It was 1889.", "It was 1934.")
    import hashlib

    want = hashlib.sha256(json.dumps({"answer": "é", "noise_ratio": None, "passages": [{"passage_id": "p", "text": "t"}], "query": "q"}, sort_keys=True).encode()).hexdigest()[:16]
    df = spark.createDataFrame([("q", [("p", "t", True, False)], "é", None)], f"query string, passages array<{testbeds.PASSAGE}>, answer string, noise_ratio double")
    assert df.select(P.content_hash("query", "passages", "answer", "noise_ratio")).first()[0] == want


def test_bm25_by_hand(spark):
    import math

    docs = [(0, "a", 0, "x y"), (0, "b", 1, "x x z w"), (0, "c", 2, "q")]
    df = spark.createDataFrame(docs, "case_no int, passage_id string, pos int, text string")
    got = {r.passage_id: r.score for r in retrieval.bm25(df, spark.createDataFrame([(0, "y x x")], "case_no int, query string")).collect()}
    n, lens = 3, {"a": 2, "b": 4, "c": 1}
    dfs = {"x": 2, "y": 1, "z": 1, "w": 1, "q": 1}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in dfs.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: (floor if v < 0 else v) for t, v in raw.items()}
    for pid, text in (("a", "x y"), ("b", "x x z w"), ("c", "q")):
        want = sum(idf[t] * text.split().count(t) * 2.5 / (text.split().count(t) + 1.5 * (0.25 + 0.75 * lens[pid] / (7 / 3))) for t in ("y", "x", "x") if t in text.split())
        assert got[pid] == pytest.approx(want)


def test_matching_blocks_are_difflibs(monkeypatch):
    import difflib

    rnd = random.Random(6)
    pairs = [([], []), ([1], []), ([1] * 50, [1] * 30), (list(range(40)), list(range(20, 60)))]
    for k in range(400):
        a = [rnd.randrange(2 + k % 30) for _ in range(rnd.randrange(60))]
        b = list(a) if k % 2 else [rnd.randrange(2 + k % 30) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(8)):
            if b:
                at = rnd.randrange(len(b))
                b[at : at + rnd.randrange(3)] = [rnd.randrange(40) for _ in range(rnd.randrange(3))]
        pairs.append((a, b))
    for most in (1 << 24, 40):
        monkeypatch.setattr(P, "RUN_PAIRS", most)
        for a, b in pairs:
            want = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            assert P.matched(np.array(a, int), np.array(b, int)) == want, (a, b)
    words = rnd.choices(range(5000), [1 / (k + 2.7) for k in range(5000)], k=20_000)  # as often as words are
    other = [w if rnd.random() < 0.9 else rnd.randrange(5000) for w in words]
    monkeypatch.setattr(P, "RUN_PAIRS", 1 << 24)
    began = time.time()
    assert P.matched(np.array(words), np.array(other)) > 17_000 and time.time() - began < 15


def test_places_and_ranks_in_ranges(spark):
    """Prefix sums over many ranges against sorting, with a group of most rows, a group of one, NULLs and ties."""
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 9 + ["b", None]), i, rnd.choice([None, 1.0, 2.0, rnd.random()]), rnd.randrange(4)) for i in range(3000)] + [("one", -1, 0.5, 3)]
    df = spark.createDataFrame(rows, "g string, i long, v double, n int").repartition(7)
    got = ranking.running(df, ["g"], ["v", "i"], F.col("n"), "before").collect()
    assert len(got) == len(rows)
    place = {(r.g, r.i): r.before for r in got}
    ranks = {(r.g, r.v): r["rank"] for r in ranking.average_ranks(df, "v", ["g"]).collect()}
    for g in ("hot", "b", None, "one"):
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[1])), 0
        for r in own:
            assert place[g, r[1]] == total
            total += r[3]
        values = [r[2] for r in own]
        assert all(ranks[g, v] == values.index(v) + (values.count(v) + 1) / 2 for v in set(values))
    assert ranking.running(df.limit(0), [], ["i"], F.lit(1), "x").count() == 0
    assert [r.x for r in ranking.running(df, [], ["i"], F.lit(1), "x").orderBy("i").limit(3).collect()] == [0, 1, 2]


def test_many_shared_ngrams_are_not_joined_as_text(spark, monkeypatch):
    """Whatever is spelt out is added up in its task before it is shuffled, and what the filter lets through by chance is left out by its count."""
    monkeypatch.setattr(validity, "SENT_HASHES", 0)
    df = spark.createDataFrame([("one two three", 1), ("One two four", 2), ("five two", 3)], "text string, i int")
    found = validity.document_ngrams(df, 2)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.collect()] == [("one two", 2)]


def test_shared_ngrams_against_plain_counts(spark, monkeypatch):
    """Both ways of finding the shared hashes, over several ranges and blocks; texts that end in a token, long ones, and letters beyond ASCII."""
    from collections import Counter

    from plumbline.functions import grams

    rnd = random.Random(8)
    words = ["the", "It's", "1889", "été", "a", "B2b", "x-y", "..", "café"]
    texts = [None, "", "one", "the the the the the", "it's 1889", "a" * 3000 + " b c"] + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, gram int").repartition(5)
    for n in (1, 2, 4):
        want = Counter()
        for t in texts:
            w = [x.lower() for x in re.findall(r"[A-Za-z0-9']+", t or "")]
            want.update({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)})
        want = {g: c for g, c in want.items() if c >= 2}
        for sent, chars in ((1 << 20, 1 << 20), (0, 500)):
            monkeypatch.setattr(validity, "SENT_HASHES", sent)
            monkeypatch.setattr(validity, "RANGE_CHARS", chars)
            monkeypatch.setattr(grams, "BLOCK", 100 if n == 2 else 1 << 20)
            assert {r.gram: r.documents for r in validity.document_ngrams(df, n).collect()} == want
    assert validity.document_ngrams(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        validity.document_ngrams(df, 0)


def test_spearman_with_ties(spark):
    df = spark.createDataFrame(list(zip([1, 2, 2, 3], [10, 20, 30, 40])), "x int, y int")
    assert ranking.spearman(df, "x", "y").first().rho == pytest.approx(0.9487, abs=1e-4)
    assert ranking.spearman(df.limit(2), "x", "y").first().rho is None
    assert ranking.spearman(df.withColumn("y", F.lit(1)), "x", "y").first().rho is None


def test_coverage_gap_values(spark):
    rows = list(zip([0.9, 0.8, 0.2, None, 0.95, 1.0], [True, True, True, True, False, False]))
    x = validity.coverage_gap(spark.createDataFrame(rows, "score double, failed boolean"), []).first()
    assert (x.n_missed, x.n_undefined, x.n_failures) == (2, 1, 4) and x.miss_rate == pytest.approx(2 / 3) and x.separation == pytest.approx(0.3417, abs=1e-4) and x.discriminative


def test_quotas(spark):
    sizes = spark.createDataFrame([("refusal", 35), ("conflict", 86), ("noise", 35)], "dimension string, n int")
    assert {r.dimension: r.quota for r in ranking.quotas(sizes, "dimension", "n", 50).collect()} == {"refusal": 11, "conflict": 28, "noise": 11}


def test_budget_fill_against_a_loop(spark):
    import random

    r = random.Random(4)
    pools = {g: [r.randint(1, 60) for _ in range(12)] for g in range(60)}
    budgets = {g: r.random() * 200 for g in pools}
    df = spark.createDataFrame([(g, i, t, budgets[g]) for g, ts in pools.items() for i, t in enumerate(ts)], "g int, place int, tokens int, budget double")
    got = {}
    for x in ranking.budget_fill(df, ["g"], ["place"], "tokens", "budget").orderBy("place").collect():
        got.setdefault(x.g, []).append((x.place, x.used))
    for g, ts in pools.items():
        left, want = budgets[g], []
        for i, t in enumerate(ts):
            if left < 15:
                break
            want.append((i, min(t, int(left))))
            left -= t
        assert got.get(g, []) == want


def test_consume_until_against_a_loop(spark):
    import random

    r = random.Random(6)
    flags = {g: [r.random() < 0.4 for _ in range(30)] for g in range(30)}
    df = spark.createDataFrame([(g, i, f) for g, fs in flags.items() for i, f in enumerate(fs)], "g int, place int, ok boolean")
    got = {}
    for x in ranking.consume_until(df, ["place"], "ok", 10, 5, ["g"]).collect():
        got.setdefault(x.g, {})[x.place] = x.role
    for g, fs in flags.items():
        want, k, stop = {}, 0, None
        for i, f in enumerate(fs):
            if stop is None and f:
                k += 1
                want[i] = "found"
                stop = i if k == 10 else None
            elif stop is not None and i <= stop + 5:
                want[i] = "control"
        assert got[g] == want


def test_similarity_joins_in_blocks(spark, monkeypatch):
    v = spark.range(40).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).alias("v"))
    a, c = v.filter("id % 4 = 0").toDF("anchor_id", "anchor"), v.toDF("candidate_id", "vector")
    whole = sorted(map(tuple, retrieval.band_join(a, c, 0.2, 0.9).collect()))
    monkeypatch.setattr(retrieval, "ANCHOR_BYTES", 100)
    assert sorted(map(tuple, retrieval.band_join(a, c, 0.2, 0.9).collect())) == whole and whole


def test_nearest_by_batches(spark):
    """The best of each batch are all that the best of all can be of: against plain Python, with ties, NULLs and short vectors."""
    import math
    import random

    r = random.Random(3)
    vs = [[r.choice((-1.0, 0.0, 1.0)) for _ in range(3)] for _ in range(60)] + [None, [1.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vs)), "id long, v array<float>").repartition(7)
    got = retrieval.nearest(retrieval.band_join(df.filter("id % 9 = 0").toDF("anchor_id", "anchor"), df.toDF("candidate_id", "vector"), 0.1, 1.5, k=4), 4).collect()
    full = [(v or []) + [0.0] * (3 - len(v or [])) for v in vs]
    norm = [math.sqrt(sum(x * x for x in v)) for v in full]
    want = []
    for a in range(0, len(vs), 9):
        sims = sorted((-round(sum(x * y for x, y in zip(full[a], full[c])) / max(norm[a] * norm[c], 1e-9), 9), c) for c in range(len(vs)) if c != a)
        want += [(a, c, k + 1) for k, (s, c) in enumerate([x for x in sims if 0.1 <= -x[0] <= 1.5][:4])]
    assert sorted((x.anchor_id, x.candidate_id, x.rank) for x in got) == sorted(want)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_safe_pool_against_plain_python(spark, monkeypatch, rounds):
    """Answers that most candidates contain get their pool, too, in every way of looking for it."""
    monkeypatch.setattr(retrieval, "POOL_ROUNDS", max(rounds, 1))
    texts = [("Common word" if i % 10 else "RARE thing") + f" {i}" for i in range(200)]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(texts)]
    answers = ["common", "rare", "word 1", "absent", " Thing ", "o"]
    cand = spark.createDataFrame(rows if rounds else [], "pos int, text string, is_answer_bearing boolean")
    got = {(x.answer, x.pos, x.rank) for x in retrieval.safe_pool(spark.createDataFrame([(a,) for a in answers * 2], "answer string"), cand, 3).collect()}
    want = set()
    for a in answers if rounds else []:
        own = [i for i, t, b in rows if not b and a.strip().lower() not in t.lower()]
        want |= {(a, i, k + 1) for k, i in enumerate(own[:3])}
    assert got == want


def test_log_supersedes(spark):
    log = spark.createDataFrame([("a", "e", 1), ("a", None, 2), ("b", None, 1), ("b", "e", 2), ("c", "", 1), (None, None, 3)], "key string, error string, line_no int")
    assert {r.key: r.done for r in runs.log_state(log).collect()} == {"a": True, "b": False, "c": True}


def test_replay_never_falls_through(spark):
    cache = spark.createDataFrame([("k1", "m")], "key string, model string")
    assert runs.replayed(spark.createDataFrame([("k1",)], "key string"), cache).first().model == "m"
    with pytest.raises(Exception, match="not in the cache"):
        runs.replayed(spark.createDataFrame([("k2",)], "key string"), cache).collect()


def test_invariants(spark):
    p = lambda bearing: [("p", "t", bearing, False)]
    rows = [
        ("ok", p(True), "x", "noise", "distractors_added", 0.5), ("grid", p(True), "x", "noise", "distractors_added", 0.3), ("ratio", p(True), "x", "conflict", "contradiction_injected", 0.5),
        ("kind", p(True), "x", "conflict", "distractors_added", None), ("leak", p(True), T.NO_ANSWER, "refusal", "answer_passage_removed", None), ("none", [], "x", "refusal", "answer_passage_retained", None),
    ]
    df = spark.createDataFrame(rows, f"case_id string, passages array<{testbeds.PASSAGE}>, answer string, dimension string, perturbation_type string, noise_ratio double")
    got = {r.case_id: r.v for r in df.select("case_id", testbeds.invariant_problem().alias("v")).collect()}
    assert got == {"ok": None, "grid": "ratio off the grid", "ratio": "ratio outside noise", "kind": "perturbation not allowed", "leak": "unanswerable with an answer passage", "none": "no passages"}
    with pytest.raises(Exception, match="leak"):
        testbeds.checked(df.filter("case_id = 'leak'")).collect()


def test_round_trip_of_cases_and_logs(spark, tmp_path):
    row = {"case_id": "c", "query": "q", "passages": [{"passage_id": "p", "text": "t", "is_answer_bearing": True, "is_injected": False}], "answer": "x", "dimension": "refusal", "perturbation_type": "answer_passage_retained"}
    (tmp_path / "cases.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"answer": "y"}) + "\n")
    path = f"file://{tmp_path}/cases.jsonl"
    assert readers.read_cases(spark, path).count() == 2 and readers.read_cases_by_id(spark, path).first().answer == "y"
    assert readers.read_cases(spark, f"file://{tmp_path}/no.jsonl", missing_ok=True).count() == 0
    readers.write_cases(readers.read_cases(spark, path), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").filter("dimension = 'refusal'").count() == 2
    (tmp_path / "log.jsonl").write_text('{"key": "a", "error": null}\n{"key": "b", "err\n{"error": "x"}\n')
    good, bad = readers.read_log(spark, f"file://{tmp_path}/log.jsonl")
    assert [r.key for r in good.collect()] == ["a"] and bad.count() == 2
    (tmp_path / "l.csv").write_text('case_id,dimension,question_no,question,answer_yes_no,notes\nc,noise,1,"a, ""b""", YES ,\nc,noise,2,q,,\n')
    assert [r.answer_yes_no for r in readers.read_labels(spark, [f"file://{tmp_path}/l.csv", f"file://{tmp_path}/none.csv"]).collect()] == ["yes"]


def test_reports(spark):
    doc = readers.report({"t": spark.range(2).coalesce(1)})
    assert readers.resolve(doc, "t.1.id") == 1 and readers.expand_env("a${X}", {"X": "1"}) == "a1"
    with pytest.raises(KeyError):
        readers.resolve(doc, "t.7.id")
    with pytest.raises(KeyError):
        readers.expand_env("${Y}", {})


def test_log_stream_keeps_last_rows(spark, tmp_path):
    src, cp = tmp_path / "src", f"{tmp_path}/cp"
    src.mkdir()
    for k, rows in enumerate([[("a", "e"), ("b", None)], [("a", None)], [("b", "late")]]):
        (src / f"{k}.json").write_text("".join(json.dumps({"key": x, "error": e, "latency_s": k}) + "\n" for x, e in rows) + "{broken\n")
        logs.last_state(logs.read_log_stream(spark, str(src), files_per_trigger=1), cp, order="latency_s").awaitTermination()
    assert {r.key: r.error for r in logs.newest_state(spark, cp).collect()} == {"a": None, "b": "late"}


def test_model_boundary_retries_and_reports(spark):
    requests = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")

    async def call(row):
        if row["key"] == "b":
            raise RuntimeError("no")
        return {"text": str(row["x"])}

    out = {r.key: (r.text, r.error) for r in calls.with_model(requests, call, "key string, text string, error string", rounds=2, base=0.01).collect()}
    assert out == {"a": ("1", None), "b": (None, "RuntimeError: no")}
    answers, fresh = calls.read_through(requests, spark.createDataFrame([("b", "kept")], "key string, text string"), call, "key string, text string, error string", rounds=1)
    assert {r.key: r.text for r in answers.collect()} == {"a": "1", "b": "kept"} and fresh.count() == 1


def test_repeated_roles_make_no_product(spark):
    from plumbline.sources import readers

    roles = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", "f"), ("b", "f"), ("b", "g")], "role string, family string")
    found = readers.forbidden_families(roles, spark.createDataFrame([("a", "b"), ("a", "b")], "role_a string, role_b string"))
    assert [tuple(r) for r in found.collect()] == [("a", "b", "f")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join", 1)[1].count("Aggregate") >= 2


def test_lines_of_cases_are_written_by_many_tasks(spark):
    from plumbline.plans import file_queries

    assert len(file_queries.QUERIES["cases_by_id"](spark, "/root/testdata/sf0.001").inputFiles()) > 1


def test_balanced_sample_limits_each_group_before_it_is_dealt(spark):
    """The same rows as by ranking whole groups, of which a task passes on no more than can be taken."""
    rows = spark.createDataFrame([(i, "a" if i % 50 else "b", f"k{i}") for i in range(3000)], "i long, g string, name string")
    found = ranking.balanced_sample(rows, "g", 100, 3, "name")
    ordered = sorted(((hashlib.md5(f"3|k{i}".encode()).hexdigest(), i) for i in range(3000)))
    own = {i for g in (0, 1) for _, i in [x for x in ordered if (x[1] % 50 == 0) == bool(g)][:50]}
    assert {x.i for x in found.collect()} == own | {i for _, i in [x for x in ordered if x[1] not in own][: 100 - len(own)]}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 3])
def test_number_of_shared_ngrams_without_their_text(spark, n, monkeypatch):
    """As many as are spelt out, whatever tasks and ranges they meet in; and equal hashes of different n-grams count apart."""
    from plumbline.functions import grams

    r = random.Random(4)
    docs = spark.createDataFrame([(" ".join(r.choice("a b c d e f g h").strip() * r.randint(1, 3) for _ in range(r.randint(0, 30))),) for _ in range(60)] + [(None,), ("",)], "text string").repartition(5)
    exact = validity.document_ngrams(docs, n).count()
    monkeypatch.setattr(validity, "RANGE_CHARS", 200)
    assert exact > 0 and validity.n_shared_ngrams(docs, n).collect() == [(exact,)]
    assert validity.n_shared_ngrams(docs.limit(0), n).collect() == [(0,)]
    one = lambda h, c: pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *[pa.array([grams.planes(np.array(x, k))], pa.binary()) for x, k in ((h, np.uint64), (c, np.uint32), ([1] * len(h), np.uint32))]], ["range", "hashes", "checks", "counts"])
    assert [b.to_pylist() for b in grams.shared(iter([one([5, 9], [1, 2]), one([5, 9], [3, 2])]), 2)] == [[{"n": 1}]]


#: The first and the fifth passage of a seed: the answer is the third and fourth word of the first that has a text, and the fifth is flagged.
SEED_TEXTS = [
    ("x y de è z", "a de é b"), ("x y de è z", "a DE È b"), ("x y le café z", "le cafe"), ("x y ΟΔΟΣ a", "the οδος a"), ("x y \u0130z a", "an iz a b"), ("x y o p", "\U0001d400o p"),
    ("x y o p", "o p\U0001d400"), ("x y o p", "o p\u0301 q"), ("x y o p", "\u00b2o p"), ("x y o p", "o p_"), (r"x y a\ \E z", r"has a\ \E here"), ("x y\x0bz q w v", "only q w"), (None, "b c m n o"), ("x y o p", None),
    ("x y \u00a0 \u2003", "o p"), ("x y \u00a0 o p", "\u00a0 o"), ("x y o\u2028 \u3000", "o\u2028"), ("x y", "o p"), ("", ""), (None, None), (" \n x\ty\r\no  p q", "an o p, q"),
]


def test_seed_integrity_tells_accents_apart_as_its_sql_does(spark, tmp_path):
    import duckdb

    from plumbline.plans import catalog

    own = [k for k in range(-70, 700, 7) if k % 11 and k % 13 and k % 17][: len(SEED_TEXTS)]
    rows = [(5 * k + i, t) for k, (first, fifth) in zip(own, SEED_TEXTS, strict=True) for i, t in ((0, first), (1, "g h i j"), (4, fifth))] + [(None, "x y o p")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.SQL["seed_integrity"])
    got = catalog.QUERIES["seed_integrity"](spark, str(tmp_path)).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    folded = testbeds.seed_problems(spark.createDataFrame([("s", "Bogota", [("p", "in Bogotá", True, False)])], f"seed_id string, answer string, passages array<{testbeds.PASSAGE}>"))
    assert folded.count() == 0
