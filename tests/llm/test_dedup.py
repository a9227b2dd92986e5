import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup as E
from plumbline.llm import near_dedup as N

SCHEMA = "doc_id long, text string"
CLASH = "doc_id long, text string, kept string, place string, piece string, prefix string, rest string, gone_id string, n long, f1 long, rep long, key string, component long, text_sha256 string, hot_size long"


def clashing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for field in CLASH.split(", ")[2:]:
        name, kind = field.split()
        df = df.withColumn(name, F.lit(1).cast(kind))
    return df


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = lambda ids: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None)
    return sorted([(i, best(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows], key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("copies", [500, 5])
def test_exact_against_brute_force(spark, monkeypatch, keep, copies):
    monkeypatch.setattr(E, "HOT_COPIES", copies)  # 5: hot groups are dealt over pieces
    r = random.Random(1)
    texts = ["", None, "a", "A", "a ", "b" * 60 + "x", "b" * 60 + "y", "é", "long " * 5000]
    rows = [(i, texts[2] if i % 3 == 0 else r.choice(texts)) for i in range(200)] + [(None, "a"), (None, "z"), (None, "z"), (7, "q"), (7, "q")]
    out = E.exact_dedup(clashing(spark, rows), keep=keep).collect()
    assert sorted([(x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in out], key=str) == brute(rows, keep)
    kept = [x for x in out if x.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(x.doc_id == x.keep_id for x in kept)


def test_exact_normalises_and_keeps_columns(spark):
    docs = clashing(spark, [(1, "Ab  c"), (2, "ab c"), (3, None), (4, "")])
    out = E.without_copies(docs, normalise=("lower", "squeeze"))
    assert out.columns == docs.columns and sorted((x.doc_id, x.text) for x in out.collect()) == [(1, "Ab  c"), (3, None)]
    assert sorted((x.doc_id, x.text) for x in E.without_copies(docs).collect()) == [(1, "Ab  c"), (2, "ab c"), (3, None)]


def test_exact_of_nothing(spark):
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def sets(text, k):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_brute(rows, k, percent):
    s = [(i, sets(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(s):
        for j, b in s[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i, _ in s}


@pytest.mark.parametrize("k", [2, 5])
def test_near_against_brute_force(spark, k):
    r = random.Random(k)
    words = ["w%d" % i for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One\ttwo"), (7, "é ü"), (8, "É ü")]
    for f in range(14):  # families of edited copies around the threshold
        base = [r.choice(words) for _ in range(r.choice([6, 20, 60, 150]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 10))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), "x y z " * 20000), (len(rows) + 1, "x y z " * 20001)]
    out = N.near_dedup(clashing(spark, rows), shingle=k).collect()
    want = near_brute(rows, k, 80)
    assert {x.doc_id: x.component_id for x in out} == want
    assert all(x.n_shingles == len(sets(dict(rows)[x.doc_id], k)) and x.kept == (x.doc_id == x.component_id) for x in out)


def test_near_bridges_within_a_bucket(spark):
    """A chain in which the ends are no link: one component through the middle."""
    base = ["a%d" % i for i in range(60)]
    chain = [" ".join(["b%d_%d" % (j, i) if i < 3 * j else base[i] for i in range(60)]) for j in range(8)]
    chain = [" ".join(("c%d" % i if i < 3 * j else base[i]) for i in range(60)) for j in range(8)]
    out = {x.doc_id: x.component_id for x in N.near_dedup(spark.createDataFrame(list(enumerate(chain)), SCHEMA), shingle=2).collect()}
    assert out == near_brute(list(enumerate(chain)), 2, 80)


def test_near_large_family(spark):
    """One family of 300 edited copies, most of them no links of its centre, with copies of copies and repeated edits."""
    r = random.Random(11)
    base = ["w%d" % i for i in range(120)]
    made = [base]
    for _ in range(299):
        copy = list(base if r.random() < 0.7 else r.choice(made))
        for _ in range(r.choice([1, 3, 6, 8, 10])):
            copy[r.randrange(len(copy))] = "e%d" % r.randrange(6)
        made.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(made)]
    r.shuffle(rows)
    for k in (2, 5):
        want = near_brute(rows, k, 80)
        assert 2 < len(set(want.values())) < 290
        out = N.near_dedup(spark.createDataFrame(rows, SCHEMA), shingle=k).collect()
        assert {x.doc_id: x.component_id for x in out} == want


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_near_pairs_of_a_head(spark, percent):
    """What the edits leave to be compared holds all links across components, whatever the head is."""
    import pyarrow as pa

    r = random.Random(percent)
    words = ["w%d" % i for i in range(60)]
    rows = []
    for f in range(3):
        base = [r.choice(words) for _ in range(50)]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, 12)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, SCHEMA)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    reps = spark.createDataFrame([(x["doc_id"], x["f1"], x["f2"], x["n"]) for b in N.sketch([batch], 2) for x in b.to_pylist()], "rep long, f1 long, f2 long, n long")
    families = spark.createDataFrame([(h, i, i) for h in (0, 30) for i, _ in rows if i != h], "u long, v long, component long")
    head, pairs = N._rest(families, docs, reps, 2, percent, N.Scratch())
    s = {i: sets(t, 2) for i, t in rows}
    link = lambda a, b: 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])
    assert {(x.u, x.v) for x in head.collect()} >= {(h, i) for h in (0, 30) for i in s if i != h and link(h, i) and s[h] != s[i]}
    got = {(x.u, x.v) for x in pairs.collect()}
    # two links of one head are in one component in use, so they aren't looked for here
    want = {(a, b) for a in s for b in s if a < b and {a, b}.isdisjoint({0, 30}) and link(a, b) and s[a] != s[b] and not all(link(h, x) for h in (0, 30) for x in (a, b))}
    want = {(a, b) for a, b in want if any(not (link(h, a) and link(h, b)) for h in (0, 30))}
    assert want and got >= want


def test_near_odd_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (5, "d e f"), (9, "d e f")]
    out = N.near_dedup(spark.createDataFrame(rows, SCHEMA), shingle=2).collect()
    assert sorted((str(x.doc_id), str(x.component_id), x.kept) for x in out) == [("5", "5", True)] * 3 + [("9", "5", False)] + [("None", "None", True)] * 2


def test_near_of_nothing_and_columns(spark):
    assert N.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = clashing(spark, [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other text"), (None, None)])
    out = N.without_near_copies(docs)
    assert out.columns == docs.columns and sorted(str(x.doc_id) for x in out.collect()) == ["1", "3", "None"]


def test_estimate_is_corrected_for_collisions(spark):
    """Sets of a known similarity: the estimate's mean is that similarity."""
    import numpy as np
    import pyarrow as pa

    made = []
    for i in range(120):
        common = [f"c{i}_{j}" for j in range(80)]
        made += [(2 * i, " ".join(common + [f"l{i}_{j}" for j in range(10)])), (2 * i + 1, " ".join(common + [f"r{i}_{j}" for j in range(10)]))]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in made], "text": [t for _, t in made]})
    rows = [x for b in N.sketch([batch], 1) for x in b.to_pylist()]
    df = spark.createDataFrame([(a["doc_id"], *[a[s] for s in N.SIGNATURE], *[b[s] for s in N.SIGNATURE]) for a, b in zip(rows[::2], rows[1::2])], "id long, " + ", ".join(f"a{s} long" for s in N.SIGNATURE) + ", " + ", ".join(f"b{s} long" for s in N.SIGNATURE))
    a = df.select("id", *[F.col(f"a{s}").alias(s) for s in N.SIGNATURE]).alias("a")
    b = df.select("id", *[F.col(f"b{s}").alias(s) for s in N.SIGNATURE]).alias("b")
    got = [x[0] for x in a.join(b, "id").select(N.estimated("a", "b")).collect()]
    assert abs(np.mean(got) - 0.8) < 0.01 and np.std(got) < 0.03
