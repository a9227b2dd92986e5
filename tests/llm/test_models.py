import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm import langid as L
from plumbline.llm import quality as Q
from plumbline.llm.shared import fold

DATA = "/root/testdata/sf0.01"


def test_fold(spark):
    rows = spark.range(200).select("id", fold("id").alias("f")).collect()
    assert all(x.f == zlib.crc32(str(x.id).encode()) % 5 for x in rows)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = L.query(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert out[0] > 0.97 and out[1] >= 0 and out[2] <= 1


EN, FR = "the cat that was on the mat with the other cats and then ", "le chat qui est sur la table avec les autres chats et puis "


def test_language_mixture_and_edges(spark):
    labelled = spark.createDataFrame([(i, (EN if i % 2 else FR) * 5, "en" if i % 2 else "fr") for i in range(20)] + [(98, None, "de"), (99, "x", None)], "doc_id long, text string, lang string")
    rows = [(1, None), (2, ""), (3, "123 !? ٣"), (4, EN), (5, FR * 3000), (6, EN * 8 + FR * 8), (7, "é"), (7, "é"), (None, EN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang", "1 AS score", "2 AS row")
    out = {(x.doc_id, x.lang_pred): x for x in L.identify(docs, labelled).collect()}
    assert {k[0] for k in out if k[1] == "und"} == {1, 2, 3} and (4, "en") in out and (5, "fr") in out and (None, "en") in out
    mixed = next(v for k, v in out.items() if k[0] == 6)
    assert mixed.languages == ["en", "fr"] and all(0.35 < p < 0.65 for p in mixed.proportions)
    kept = L.in_known_language(docs, labelled)
    assert kept.columns == docs.columns and kept.count() == 6
    none = L.identify(docs, labelled.limit(0)).collect()
    assert len(none) == 9 and all(x.lang_pred == "und" and x.score == 0 for x in none)
    assert L.identify(docs.limit(0), labelled).count() == 0


def test_every_labelled_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD_SHARES", 20_000)
    r = np.random.default_rng(5)
    text = {f"l{k:02}": " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(10 + k)) for k in range(70)}
    rows = [(i, t, x) for i, (x, t) in enumerate(text.items())]
    labelled = spark.createDataFrame(rows + [(1000 + i, EN, "l69") for i in range(3000)], "doc_id long, text string, lang string")
    for train_docs in (L.TRAIN_DOCS, 500):
        out = {x.doc_id: x.lang_pred for x in L.identify(spark.createDataFrame(rows, labelled.schema), labelled, train_docs=train_docs).collect()}
        assert out == {i: x for i, _, x in rows if x != "l69"} | {69: out[69]}
    assert L.learn(labelled, train_docs=500)[0] == sorted(text)


def test_all_labelled_documents_are_learnt(spark):
    """However many there are: the model is that of counts over all of them, and not of a sample beyond some size."""
    rows = [(i, f"{EN} {i % 7}" if i % 2 else f"{FR} {i % 5}", "en" if i % 2 else "fr") for i in range(24_000)]
    many = spark.createDataFrame(rows + [(-1, "zzz qqq zzz", "en")], "doc_id long, text string, lang string")
    names, model = L.learn(many)
    row, code, count = L.trigrams(pa.array([t for _, t, _ in rows] + ["zzz qqq zzz"]))
    lang = np.array([x for *_, x in rows] + ["en"])
    for k, name in enumerate(names):
        own = lang[row] == name
        exact = np.bincount(code[own], count[own], L.CODES) + 0.5
        assert np.array_equal(model[:, k], (exact / exact.sum()).astype(np.float32))
    assert names == ["en", "fr"]


def test_proportions_against_plain_em():
    """The batched fit equals expectation-maximisation of one document at a time."""
    r = np.random.default_rng(1)
    model = r.random((L.CODES, 3)).astype(np.float32)
    model /= model.sum(0)
    texts = ["the quick brown fox", "jumps over", "the lazy dog again and again"]
    row, code, count = L.trigrams(pa.array(texts))
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    total = np.add.reduceat(count.astype(float), starts)
    got, _ = L._fit(model[code], count.astype(np.float32), row, starts, total, np.full((3, 3), 1 / 3, np.float32), 8)
    for i in range(3):
        p, c, theta = model[code[row == i]].astype(float), count[row == i], np.full(3, 1 / 3)
        for _ in range(8):
            z = p * theta
            theta = (z / z.sum(1, keepdims=True) * c[:, None]).sum(0) / c.sum()
        assert np.allclose(got[i], theta, atol=1e-4)


def test_selection_against_plain_inference(monkeypatch):
    """The language sets of many documents at once, in runs of any length, equal those chosen one document at a time."""
    r = np.random.default_rng(2)
    letters = [list("abcdefgh"), list("efghijkl"), list("ijklmnop")]
    made = lambda k, n: " ".join("".join(r.choice(letters[k], 5)) for _ in range(n))
    counts = np.full((L.CODES, 3), 0.5)
    for k in range(3):
        _, code, count = L.trigrams(pa.array([made(k, 4000)]))
        counts[code, k] += count
    model = (counts / counts.sum(0)).astype(np.float32)
    texts = [made(k, n) for k in range(3) for n in (1, 5, 60)] + [made(0, n) + " " + made(2, m) for n, m in ((40, 40), (60, 6), (60, 1), (4, 4))] + [made(0, 30) + " " + made(1, 30) + " " + made(2, 30), "", "123"]
    row, code, count = L.trigrams(pa.array(texts))
    want = np.zeros((len(texts), 3))
    for i in range(len(texts)):
        p, c = model[code[row == i]].astype(float), count[row == i].astype(float)
        if not len(c):
            continue
        fitted = lambda theta: next(t for k, t in enumerate(iter_em(p, c, theta)) if k == L.ROUNDS)  # noqa: E731, B023
        theta = fitted(np.full(3, 1 / 3))
        alone = (np.log(p) * c[:, None]).sum(0)
        want[i, alone.argmax()] = 1
        chosen = theta >= L.FLOOR
        if chosen.sum() > 1:
            again = fitted(np.where(chosen, theta, 0) / theta[chosen].sum())
            gain = (np.log((p * again).sum(1)) * c).sum()
            if gain - alone.max() > L.PENALTY * (chosen.sum() - 1) * np.log(c.sum() + 1):
                want[i] = again
    assert (want > 0).sum(1).max() == 3 and ((want > 0).sum(1) == 2).sum() >= 2 and ((want > 0).sum(1) == 1).sum() >= 9
    for held in (L.HELD_SHARES, 300):
        monkeypatch.setattr(L, "HELD_SHARES", held)
        assert np.allclose(L.infer(pa.array(texts), model)[0], want, atol=2e-3)


def iter_em(p, c, theta):
    while True:
        yield theta
        z = p * theta
        theta = (z / z.sum(1, keepdims=True) * c[:, None]).sum(0) / c.sum()


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = Q.query(spark, DATA).join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([x.predicted == x.quality for x in out])
    ones, zeros = [x.score for x in out if x.quality == 1], [x.score for x in out if x.quality == 0]
    assert right > 0.9 and np.median(ones) > 0.8 and np.median(zeros) < 0.3 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, f"good words here number {i}. And more of them.") for i in range(30)] + [(50, None), (51, ""), (52, "!!! ### $$$ " * 20000), (53, "a"), (53, "a"), (None, "b")], "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS score")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    model = Q.learn(docs, labels)
    out = Q.classify(docs, model).collect()
    assert len(out) == 36 and all(0 <= x.score <= 1 for x in out)
    alone = Q.classify(docs, Q.learn(docs.limit(0), labels)).collect()
    assert len(alone) == 36 and len({x.score for x in alone}) == 1
    assert Q.classify(docs.limit(0), model).count() == 0


def test_risk_is_never_negative_and_prior_estimate():
    r = np.random.default_rng(2)
    p, n = r.normal(1.5, 1, (600, 2)), r.normal(-1.5, 1, (400, 2))
    u = np.vstack((r.normal(1.5, 1, (600, 2)), n))
    assert abs(Q.estimated_prior(p, u) - 0.6) < 0.12
    w = Q.fit(p, u, 0.6)
    z = lambda x: np.hstack((x, np.ones((len(x), 1)))) @ w
    assert (z(p) > 0).mean() > 0.95 and (z(n) < 0).mean() > 0.9
    assert np.logaddexp(0, z(u)).mean() - 0.6 * np.logaddexp(0, z(p)).mean() > -0.02


def test_risk_gradients_and_minimum():
    """Gradients against differences, and the fit against plain descent on the risk."""
    r = np.random.default_rng(5)
    made = r.normal(1, 1, (1000, 3)), np.vstack((r.normal(1, 1, (800, 3)), r.normal(-0.5, 1, (1200, 3))))
    p, u = (np.hstack((x, np.ones((len(x), 1)))) for x in made)
    w, e = r.normal(size=4), 1e-6
    for k in range(2):
        grad = Q.parts(w, p, u, 0.4)[2 + k]
        for i in range(4):
            d = np.eye(4)[i] * e
            assert abs((Q.parts(w + d, p, u, 0.4)[k] - Q.parts(w - d, p, u, 0.4)[k]) / (2 * e) - grad[i]) < 1e-6
    risk = lambda w: (lambda a: a[0] + max(a[1], 0))(Q.parts(w, p, u, 0.4)) + Q.DECAY * (w[:-1] ** 2).sum() / 2
    slow = np.zeros(4)
    for _ in range(4000):
        _, negative, gp, gn = Q.parts(slow, p, u, 0.4)
        slow -= 0.1 * (gp + (gn if negative >= 0 else 0) + Q.DECAY * np.append(slow[:-1], 0))
    assert risk(Q.fit(p[:, :3], u[:, :3], 0.4, 2000)) <= risk(slow) + 1e-3


def test_prior_of_a_known_mixture():
    r = np.random.default_rng(6)
    positive = r.normal(2, 1, (3000, 4))
    unlabelled = np.vstack((r.normal(2, 1, (1800, 4)), r.normal(-2, 1, (1200, 4))))
    assert abs(Q.estimated_prior(positive, unlabelled) - 0.6) < 0.08
