import hashlib
import math
import os
import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bitcodes, codebooks, divergence

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, code string, v int, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 8) for r in rows], VECTORS)


def coded(rows, parts, entries, rounds, scale=256):
    """Product codes by plain loops over exact fractions."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dims = max([1, *(-(-len(v) // parts) for _, v, _ in kept)])
    ints = [[math.floor(Fraction(x) * scale) for x in v] + [0] * (parts * dims - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    cut = [[v[p * dims : (p + 1) * dims] for p in range(parts)] for v in ints]
    book = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def nearest(x, entries):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(entries))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in cut:
                members[nearest(v[p], book[p])[1]].append(v[p])
            for e, xs in members.items():
                book[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(v[p], book[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (_, _, label), e in zip(kept, errors):
        total[label] += e
    digest = hashlib.sha256(",".join(str(c) for part in book for e in part for c in e).encode()).hexdigest()
    most = codebooks.MOST
    return sorted(((i, "".join(f"{c:02x}" for _, c in f), min(e, most), min(total[label], most), digest) for (i, _, label), f, e in zip(kept, found, errors)), key=repr)


def codes_of(df, **options):
    out = codebooks.product_codes(df, **options)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("size,parts,entries,rounds", [(150, 4, 6, 2), (40, 3, 64, 3), (5, 2, 8, 1), (30, 2, 5, 0)])
def test_codes_are_those_of_plain_loops(spark, size, parts, entries, rounds):
    rnd = random.Random(size)
    rows = [(rnd.randrange(100), [rnd.choice([0.0, -0.5, rnd.gauss(0, 1)]) for _ in range(12)], rnd.choice([1, 2, None])) for _ in range(size)]
    rows += [(1, None, 1), (2, [1.0, None] * 6, 1), (3, [NAN] * 12, 1), (4, [INF] + [0.0] * 11, None), (None, [0.25] * 12, 3), (-5, [], 1), (-6, [1.0] * 7, 1), rows[0], rows[0]]
    df = vectors(spark, rows).repartition(5)
    assert codes_of(df, parts=parts, entries=entries, rounds=rounds) == coded(rows, parts, entries, rounds)


def test_codes_of_components_of_any_size(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1, 1]) * 2.0 ** rnd.randrange(-60, 200) for _ in range(4)], i % 2) for i in range(30)] + [(90, [1e308, -1e308, 5e-324, 0.1], 1)]
    assert codes_of(vectors(spark, rows), parts=2, entries=4) == coded(rows, 2, 4, 2)


def test_codes_of_empty_tables(spark):
    assert codes_of(vectors(spark, [(1, None, 1)])) == [] and codes_of(vectors(spark, []), rounds=1) == []
    assert codes_of(vectors(spark, [(1, [], None)]), parts=2) == [(1, "0000", 0, 0, hashlib.sha256(b"0,0").hexdigest())]


def test_blocks_hold_parts_by_column():
    x = np.arange(24).reshape(2, 12)
    block = codebooks.columnar(x, 3)
    assert block.shape == (3, 4, 2) and block[1, 2].tolist() == [6, 18]


def nearest(rows, every, k):
    """Searches by plain loops; of ties the smaller id."""
    kept = [(i, v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in kept:
        if i % every == 0:
            scores = []
            for j, x in kept:
                if i != j:
                    dot, size = (sum(Fraction(a) * Fraction(b) for a, b in zip(u, v)) for u, v in ((q, x), (q, q)))
                    share = dot * abs(dot) / (size * sum(Fraction(b) ** 2 for b in x))  # the square, with its sign
                    scores.append((-share, j))
            out += [(i, rank, j, round(math.copysign(math.sqrt(abs(s)), -s), 9)) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(df, every=5, **options):
    out = bitcodes.nearest_vectors(df, F.col("vec_id") % every == 0, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((*r[:3], round(r[3], 9)) for r in out.collect())


@pytest.mark.parametrize("options", [{}, {"query_bytes": 20_000}, {"k": 2, "min_bits": 64}])
def test_nearest_are_those_of_plain_loops(spark, options):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0.5, 1) for _ in range(8)], 0) for i in range(300)]
    rows += [(300 + i, rows[i % 4][1], 0) for i in range(20)]  # equal vectors
    rows += [(400, None, 0), (405, [0.0] * 8, 0), (410, [NAN] * 8, 0), (415, [1.0, None], 0), (420, [1.0, 2.0], 0), (425, [], 0), (None, [1.0] * 8, 0), (430, [1e300, 1e-300] * 4, 0), (435, [5e-320] * 8, 0)]
    assert found(vectors(spark, rows).repartition(6), **options) == nearest(rows, 5, options.get("k", 5))


def test_nearest_of_few_and_of_repeated_rows(spark):
    few = [(0, [1.0, 0.0], 0), (5, [1.0, 1.0], 0), (7, [-1.0, 0.0], 0)]
    assert found(vectors(spark, few)) == nearest(few, 5, 5)
    assert found(vectors(spark, few[:1])) == [] and found(vectors(spark, [])) == [] and found(vectors(spark, few[2:])) == []
    twice = found(vectors(spark, few[:2] + few[:1]))
    assert [x[:3] for x in twice] == [(0, 1, 5), (0, 1, 5), (5, 1, 0), (5, 2, 0)]


def test_estimates_stay_within_their_spread():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 48)) + 0.4
    column = pa.array(x.tolist())
    y, length = bitcodes.scaled(column, 48)
    mean, turn = (y / length[:, None]).mean(axis=0), bitcodes.rotation(48, 256, 1)
    code, base, gain, spread = bitcodes.encoded(y, length, mean, turn)
    table = pa.table({"vec_id": pa.array(range(50)), "v": column[:50], "beat": pa.array([-INF] * 50)})
    block = bitcodes.Queries(table, 48, mean, turn)
    words = np.ascontiguousarray(code.T)
    most = block.ceilings(slice(0, 50), words, base, gain, spread)
    real = (y[:50] / length[:50, None]) @ (y / length[:, None]).T
    np.fill_diagonal(real, -1)
    assert (real <= most).mean() > 0.9995
    middle = most - bitcodes.EPS * (block.size[:, None] * spread + block.step[:, None] * math.sqrt(256 / 12) * gain)
    np.fill_diagonal(middle, -1)
    assert abs((middle - real).mean()) < 0.003 and (middle - real).std() < 0.08


def apart(rows, min_docs, top, unit=1_000_000_000, a=5):
    """Divergence with every group spelt out over every kept term."""
    docs, n, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words, word = [], ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                words, word = words + [word] * bool(word), ""
            else:
                word += c.lower() if c.isascii() else c
        docs[lang].update(set(words))
        n.update((lang, source, w) for w in words)
    out = []
    kept = {lang: [w for w in docs[lang] if docs[lang][w] >= min_docs] for lang in docs}

    def prices(lang, sources):
        counts = {w: sum(n[lang, s, w] for s in sources) for w in kept[lang]}
        total = sum(counts.values())
        return {w: (c, 1 + unit * (c + a) // (total + a * len(counts))) for w, c in counts.items()}

    for lang, source in groups:
        others = [s for x, s in groups if x == lang]
        p, q = prices(lang, [source]), prices(lang, others)
        apart = [(-sum(abs(p[w][1] - r[w][1]) for w in p), s.encode(), s) for s in others if s != source for r in [prices(lang, [s])]]
        out += [(lang, source, "pair", s, -v, rank) for rank, (v, _, s) in enumerate(sorted(apart), 1)]
        terms = sorted((q[w][1] - p[w][1], w.encode(), w) for w in p if p[w][0] and p[w][1] > q[w][1])
        out += [(lang, source, "term", w, -v, rank) for rank, (v, _, w) in enumerate(terms[:top], 1)]
    return sorted(out)


def test_divergence_is_that_of_groups_spelt_out(spark):
    rnd = random.Random(11)
    words = ["red", "Red", "blue", "ÉTÉ", "été", "naïve", "x", "语言", "a1b", "don't", "\u0080y", "ab" * 300]
    rows = []
    for i in range(400):
        lang, source = rnd.choice([("en", "hot")] * 5 + [(x, f"s{rnd.randrange(6)}") for x in ("en", "fr", None)])
        rows.append((" ".join(rnd.choice(words[: 4 + i % 9]) for _ in range(rnd.randrange(12))), lang, source))
    rows += [(None, "en", "none"), ("", "de", "alone"), ("1 2 !", "de", None), ("one two", "xx", "u"), ("one", "xx", "w"), ("red " * 3000, "fr", ""), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "text string, lang string, source string, n int, p int, term string")
    for min_docs, top in ((3, 4), (1, 50), (10_000, 5)):
        out = divergence.source_divergence(df.repartition(7), min_docs=min_docs, top=top)
        assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in out.collect()) == apart(rows, min_docs, top)
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_sources_dealt_over_tasks(spark, monkeypatch):
    rows = [(f"red w{'abcdefghij'[i % 10]} {'blue ' * (i % 3)}", "en", f"s{i % 11}") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "SOURCES_PER_TASK", 2)
    assert sorted(tuple(r) for r in divergence.source_divergence(df, min_docs=2).collect()) == apart(rows, 2, 50)


def test_terms_that_share_a_hash(monkeypatch):
    text, group = pa.array(["Red blue red", None, "blue, Été", "red"]), np.array([0, 1, 0, 1])
    plain = lambda got: sorted(zip(got[0].tolist(), got[1].to_pylist(), got[2].tolist(), got[3].tolist()))
    want = [(0, "blue", 2, 2), (0, "red", 2, 1), (0, "Été", 1, 1), (1, "red", 1, 1)]
    assert plain(divergence.counted(text, group)) == want
    monkeypatch.setattr(divergence, "hash_spans", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert plain(divergence.counted(text, group)) == want


@pytest.mark.parametrize("module", [codebooks, divergence, bitcodes])
def test_query_equals_sql(spark, module):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = module.query(spark, DATA), con.sql(module.SQL)
    names = sorted(got.columns)
    place = [want.columns.index(c) for c in names]
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert sorted(plain(r[c] for c in names) for r in got.collect()) == sorted(plain(r[i] for i in place) for r in want.fetchall())
