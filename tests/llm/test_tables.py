import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate as D
from plumbline.llm import langid, near_dedup, sharding, warc
from plumbline.llm.components import connected_components

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
ITEM = "A train leaves the old station at noon with 120 passengers and Maria counts 30 km before the next stop near the river."


def test_leaks_with_other_slots(spark):
    other = ITEM.replace("120", "77").replace("Maria", "Keisha").replace("30 km", "18 miles")
    twice = "One day 12 birds and then 12 more birds flew over the house of John while 12 cats slept below."
    docs = [
        (1, "Intro words here, " + ITEM + " More."), (2, "x " + other + " y"), (3, "A train leaves the station at once."), (4, None), (5, ""), (6, "word " * 50000 + ITEM), (6, ITEM),
        (7, twice.replace("12 ", "15 ")), (8, twice.replace("12 birds", "15 birds", 1)), (9, "A train leaves the old station at noon with many friends"), (10, "!!! ..."), (None, ITEM.upper()),
    ]
    bench = spark.createDataFrame([(100, ITEM), (101, twice), (102, "short item"), (103, None), (None, ITEM), (104, ""), (100, ITEM)], "item_id long, text string").selectExpr("*", "1 AS items", "2 AS doc_id")
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS items", "2 AS n_windows", "3 AS row")
    out = [(x.doc_id, x.item_ids, x.reparameterised) for x in D.contaminated(df, bench).collect()]
    found = {(i, tuple(items), c) for i, items, c in out if items}
    assert found == {(1, (100,), False), (2, (100,), True), (6, (100,), False), (7, (101,), True), (8, (101,), False), (None, (100,), False)}, found
    assert len(out) == len(docs)
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - 7
    assert D.contaminated(df.limit(0), bench).count() == 0 and not D.contaminated(df, bench.limit(0)).filter("contaminated").count()


def found_items(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {x.doc_id: x.item_ids for x in D.contaminated(spark.createDataFrame(list(enumerate(docs)), SCHEMA), bench).collect()}


def test_items_rich_in_slots(spark):
    items = ["What is 12 + 7 - 45 * 3 ?", "Compute 12 plus 7 minus 45 times 3 over 9 times 8.", "Ann paid 12 dollars and Bob paid 7 dollars while Sue owed Tom 45 euros and Kim 3 euros, so who still owes Max 9 dollars and Joe 8 dollars, so who still owes Pam 6 dollars?"]
    docs = [f"Some words before. {t} And some after." for t in items] + [items[2].replace("12", "15").replace("Tom", "Keisha"), "What is 12 + 7 - 45 * 4 ?", "Compute 12 plus 7 minus 45 and 3 over 9 times 8.", "Ann paid 12 dollars and Bob paid nothing, so someone still owes Max 9 dollars?"]
    assert found_items(spark, items, docs) == {0: [0], 1: [1], 2: [2], 3: [2], 4: [], 5: [], 6: []}


def test_names_that_open_sentences_and_changed_case(spark):
    item = "Maria bakes 12 loaves in the morning. John then eats 3 of the loaves. Maria sells 4 loaves to friends. How many remain?"
    other = item.replace("Maria", "Tom").replace("John", "Keisha").replace("12", "15")
    trip = "We saw that old Peter took 5 buses into town with Carla who met 9 friends from Lisbon whom only Bruno knew."
    docs = ["Some text. " + other + " More text.", trip.lower().replace("5", "6").replace("9", "8"), trip.upper().replace("5", "6"), "Maria bakes 12 cakes in the evening. John then eats 3 of the cakes."]
    assert found_items(spark, [item, trip], docs) == {0: [0], 1: [1], 2: [1], 3: []}


def leaked(item, doc):
    """The rule by plain loops, for texts of small words, numbers and names inside sentences: an alignment with a stretch of agreeing tokens and one value for each slot value, long enough, around a window that is joined."""
    kind = lambda w, i: "#" if w.isdigit() else "@" if w[0].isupper() and i else w.lower()
    a, b = item.split(), doc.split()
    s, t = [kind(w, i) for i, w in enumerate(a)], [kind(w, i) for i, w in enumerate(b)]
    need = min(D.RUN, max(1, len(a) - D.WINDOW + 1)) + D.WINDOW - 1 if len(a) >= D.WINDOW else len(a)
    for shift in range(-len(a), len(b)):
        pairs = [(i, i + shift) for i in range(len(a)) if 0 <= i + shift < len(b)]
        for x in range(len(pairs)):
            for y in range(x + need, len(pairs) + 1):
                part = pairs[x:y]
                if any(s[i] != t[j] for i, j in part):
                    break
                own: dict = {}
                if any(own.setdefault(a[i].lower(), b[j].lower()) != b[j].lower() for i, j in part):
                    break
                # the joined window may lie anywhere on the agreeing run
                lo, hi = part[0][0], part[-1][0] + 1
                while lo and lo - 1 + shift >= 0 and s[lo - 1] == t[lo - 1 + shift]:
                    lo -= 1
                while hi < len(a) and hi + shift < len(b) and s[hi] == t[hi + shift]:
                    hi += 1
                for k in range(lo, hi - D.WINDOW + 1):
                    plain = sum(w not in "#@" for w in s[k : k + D.WINDOW])
                    if plain >= D.LITERALS or all(a[i].lower() == b[i + shift].lower() for i in range(k, k + D.WINDOW)):
                        return True
    return False


def test_leaks_against_plain_loops(spark):
    r = random.Random(12)
    word = lambda: r.choice(["the", "old", "men", "saw", "a", "big", "dog", "run"])
    slot = lambda: r.choice(["1", "2", "3", "Ann", "Bob"])
    items = ["so " + " ".join(slot() if r.random() < p else word() for _ in range(r.randint(9, 16))) for p in (0.1, 0.2, 0.3, 0.4) for _ in range(8)]
    docs = []
    for _ in range(500):
        own = r.choice(items).split()
        lo = r.randint(0, 3)
        own = own[lo : len(own) - r.randint(0, 3)]
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            i = r.randrange(len(own))
            own[i] = slot() if own[i].isdigit() or own[i][0].isupper() else r.choice([own[i], own[i], word()])
        docs.append("so it was " + " ".join([word() for _ in range(3)] + own + [word() for _ in range(3)]))
    got = found_items(spark, items, docs)
    wrong = [(d, i, got[d]) for d in got for i in range(len(items)) if (i in got[d]) != leaked(items[i], docs[d])]
    assert sum(map(len, got.values())) > 200
    assert not wrong, (len(wrong), [(items[i], docs[d], g) for d, i, g in wrong[:3]])


def test_recall_of_variants(spark):
    """Items with all slots filled anew, placed in other text: at least 95 in 100 are found, and texts without items are left alone."""
    r = random.Random(7)
    nouns, verbs, names = "apples books chairs coins stamps shells marbles cards".split(), "buys sells finds loses keeps gives".split(), "Maria Tom Keisha Ivan Chen Omar Lena Paul".split()
    shapes = ["{n1} {v1} {a} {o1} every day and {n2} {v2} {b} of them. How many {o1} does {n1} have after {c} days?", "In a box there are {a} {o1} and {b} {o2}. If {n1} {v1} {c} {o1}, what share of what is left are {o2}?", "{n1} walks {a} km to school while {n2} rides {b} km. After {c} weeks, how much further has {n2} gone?", "A shop {v1} {a} {o1} for {b} dollars each. {n1} pays with {c} dollars and {n2} with the rest. What does {n2} pay?"]
    fill = lambda shape, seed: shape.format(**{**{k: r.choice(names) for k in ("n1",)}, "n2": r.choice(names), "a": r.randint(2, 90), "b": r.randint(2, 90), "c": r.randint(2, 90), **seed})
    items, docs = [], []
    for k in range(40):
        seed = {"v1": r.choice(verbs), "v2": r.choice(verbs), "o1": r.choice(nouns), "o2": r.choice(nouns)}
        items.append(fill(shapes[k % 4], seed))
        docs.append("Some words stand here first. " + fill(shapes[k % 4], seed) + " And some more follow.")
    docs += ["Once upon a time there was a shop that sold many things and nobody counted them at all."] * 3
    got = found_items(spark, items, docs)
    assert sum(k in got[k] for k in range(40)) >= 38, [items[k] for k in range(40) if k not in got[k]]
    assert not any(got[40 + k] for k in range(3))


def test_short_items_match_whole(spark):
    bench = spark.createDataFrame([(1, "Quite a short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here is quite a short item again"), (2, "quite a short thing")], SCHEMA)
    assert {x.doc_id: x.contaminated for x in D.contaminated(docs, bench).collect()} == {1: True, 2: False}


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 400)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == whole


@pytest.mark.parametrize("words", [D.BLOCK_WINDOWS, 10])
def test_items_named_by_texts(spark, monkeypatch, words):
    """Both plans, on items whose ids are texts, with slots filled differently."""
    monkeypatch.setattr(D, "BLOCK_WINDOWS", words)
    trip = "We saw that old Peter took 5 buses into town with Carla who met 9 friends from Lisbon whom only Bruno knew."
    short = "How many legs have three old green spiders ?"
    bench = spark.createDataFrame([("gsm-1", ITEM), ("gsm-10", trip), ("b", short), (None, ITEM), ("gsm-2", None)], "item_id string, text string")
    docs = [(1, "x " + ITEM.replace("120", "77") + " y " + trip.lower()), (2, "so: " + short), (3, trip.replace("Carla", "Anna").replace("9", "2")), (4, "nothing of it"), (5, None), (6, "A train leaves the old station at noon with nobody")]
    df = spark.createDataFrame(docs, SCHEMA)
    out = D.contaminated(df, bench)
    assert out.schema["item_ids"].dataType.simpleString() == "array<string>"
    assert {x.doc_id: (x.item_ids, x.reparameterised) for x in out.collect()} == {1: (["gsm-1", "gsm-10"], True), 2: (["b"], False), 3: (["gsm-10"], True), 4: ([], False), 5: ([], False), 6: ([], False)}
    assert sorted(r.doc_id for r in D.decontaminated(df, bench).collect()) == [4, 5, 6]


def test_both_plans_find_the_same(spark, monkeypatch):
    """Texts of items with words in another case, other names and other words, so that windows beside each other agree in different readings."""
    rnd = random.Random(5)
    names, plain = "Maria Tom Keisha Ivan Chen Omar".split(), "river table window garden yellow seven bridge paper 12 km".split()
    items = [(i, " ".join(rnd.choice(names) if rnd.random() < 0.3 else rnd.choice(plain) for _ in range(rnd.choice([5, 8, 9, 10, 14])))) for i in range(40)]
    other = lambda w: w if rnd.random() < 0.6 else rnd.choice([w.lower(), w.capitalize(), w + ".", rnd.choice(names) if w in names else w, rnd.choice(plain)])
    texts = [(k, "And so " + " ".join(other(w) for w in items[k % 40][1].split()) + " it was") for k in range(2000)]
    docs, bench = spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    whole = {x.doc_id: x for x in D.contaminated(docs, bench).collect()}
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 10)
    joined = {x.doc_id: x for x in D.contaminated(docs, bench).collect()}
    assert sum(x.contaminated for x in whole.values()) > 200
    assert [k for k in whole if whole[k] != joined[k]] == []


def test_a_phrase_of_many_items_and_texts_makes_no_product(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 10)
    rnd = random.Random(3)
    stock = "please read the question below and choose one"
    word = lambda: "".join(rnd.choice("bcdfghjklmnpqrst") + rnd.choice("aeiou") for _ in range(4))
    own = [" ".join(word() for _ in range(14)) for _ in range(1000)]
    bench = spark.createDataFrame([(i, f"{t} {stock} {word()}") for i, t in enumerate(own)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{' '.join(word() for _ in range(12))} {stock} {own[i] if i % 10 == 0 else word()}") for i in range(1000)], SCHEMA)
    sizes = {}
    write = D.Scratch.__call__

    def watched(self, rows, what):
        out = write(self, rows, what)
        sizes[what] = out.count()
        return out

    monkeypatch.setattr(D.Scratch, "__call__", watched)
    found = {x.doc_id: x.item_ids for x in D.contaminated(docs, bench).filter("contaminated").collect()}
    assert found == {i: [i] for i in range(0, 1000, 10)} and sizes["text-items"] < 5000


def test_leaks_against_plain_containment(spark):
    """Every document that holds an item word for word is found; any other hit has at least a run's words of the item in order."""
    docs, bench = ([tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))))
    found = {x.doc_id: set(x.item_ids) for x in D.contaminated(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert sum(map(len, found.values())) > 0
    norm = lambda t: re.findall(r"\w+", t.lower())
    n = D.WINDOW + D.RUN - 1
    for i, t in docs:
        for j, b in bench:
            if b in t:
                assert j in found[i]
            elif j in found[i]:
                w, v = norm(b), " ".join(norm(t))
                assert any(" ".join(w[k : k + 3]) in v for k in range(len(w) - 2)), (i, j, n)


def test_canonical_tokens():
    _, starts, ends, rows, token = D.canonical(pa.array(["We paid 30 km, to Maria. Then Bob", None, "3 apples km"]))
    assert [int(t) if t <= D.NAME else 0 for t in token] == [0, 0, 0xA1, 0xB2, 0, 0xC3, 0, 0xC3, 0xA1, 0, 0] and rows.tolist() == [0] * 8 + [2] * 3


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (4, 4), (3, 9), (9, 1), (11, 12), (20, 19)] + [(100 + i, 101 + i) for i in range(40)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 12: 10, 19: 19, 20: 19, **{100 + i: 100 for i in range(41)}}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_store_keeps_every_row(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=200_000, fanout=3)
    assert store.manifest()["version"] == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("run", F.lit(None).cast("int"))
    store.append(docs.limit(0))
    assert store.read().count() == 0 and store.manifest()["version"] == 1
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(7)))
    store.append(docs.filter("doc_id < 50"))
    done = store.compact()
    rows = store.read()
    assert rows.columns == docs.columns and rows.count() == docs.count() + 50
    want, got = Counter(map(tuple, docs.collect())), Counter(map(tuple, rows.collect()))
    assert all(got[k] == v + (k[0] < 50) for k, v in want.items())
    assert all(s["bytes"] <= 2 * 200_000 for s in done["shards"]) and sum(s["rows"] for s in done["shards"]) == docs.count() + 50
    assert not store.plan(done["shards"])


def test_store_commit_is_exclusive(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    base = store.append(spark.createDataFrame([(1, None), (1, None), (None, "")], SCHEMA))
    store.commit(base, base["shards"], base["schema"])
    with pytest.raises(sharding.Conflict):
        store.commit(base, [], base["schema"])
    assert store.manifest()["version"] == base["version"] + 1 and store.read().count() == 3


def test_store_keeps_older_versions_until_they_expire(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fanout=3)
    counts = {}
    for k in range(20):  # over a checkpoint
        counts[store.append(spark.createDataFrame([(k, "x" * k)], SCHEMA))["version"]] = k + 1
    old = store.read(5)
    merged = store.compact()
    assert len(merged["shards"]) < 3 and old.count() == 5  # a reader that began before the compaction ends
    assert all(store.read(v).count() == n for v, n in counts.items())
    assert store.expire(keep=2) == [] and store.read().count() == 20 == store.read(store.version() - 1).count()
    assert len(store.expire()) == 20 and store.read().count() == 20
    assert store.append(spark.createDataFrame([(99, None)], SCHEMA)) and store.read().count() == 21
    for version in range(1, store.version() - 1):
        with pytest.raises(sharding.Expired, match=f"version {version} has expired"):
            store.read(version)
    assert store.oldest() == store.version() - 1 and store.read(store.oldest()).count() == 20 and store.expire(keep=5) == []


def test_store_survives_other_writers(spark, tmp_path):
    """An append and a compaction lose the race to another writer's commits: nothing is lost, and orphans go."""
    root = f"file://{tmp_path}/s"
    store, other = sharding.ShardStore(spark, root, fanout=3), sharding.ShardStore(spark, root, fanout=3)
    rows = lambda k: spark.createDataFrame([(k, "t")], SCHEMA)
    for k in range(4):
        store.append(rows(k))
    real, raced = store.manifest, []

    def racing(version=None):
        found = real(version)
        if len(raced) < 1:
            raced.append(other.append(rows(100)))
        return found

    store.manifest = racing
    store.append(rows(4))
    assert raced and real()["version"] == 6 and store.read().count() == 6
    raced.clear()
    merging = store._counted

    def merged_first(files, schema):
        found = merging(files, schema)
        if not raced:
            raced.append(other.compact())
        return found

    raced.clear()
    store.manifest, store._counted = real, merged_first
    store.compact()
    assert raced and store.read().count() == 6
    other.spark.createDataFrame([(1, "lost")], SCHEMA).write.parquet(f"{root}/shards/orphan")
    assert any("orphan" in p for p in store.sweep(0)) and store.read().count() == 6


def test_sharding_query(spark):
    out = sharding.query(spark, DATA).collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {x.doc_id: x.text_sha256 for x in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()} and len(out) == len(docs)
    sizes = Counter(x.shard for x in out)
    assert all(x.shard_rows == sizes[x.shard] for x in out)


def records(spark, rows):
    return spark.createDataFrame(rows, "archive string, offset long, length long, sha256 string").withColumn("node", F.lit(1))


def test_audit_finds_each_difference(spark):
    first = [(f"a{k}", i * 1000, 1000, f"{k}-{i}") for k in range(3) for i in range(3000)] + [("z", 0, 5, None), ("a0", None, 1, "x"), ("a0", 0, 1000, "0-0")]
    second = [r for r in first if r not in (("a1", 5000, 1000, "1-5"), ("a2", 2_999_000, 1000, "2-2999"))]
    second = [(a, o, n, "bad" if (a, o) == ("a0", 70_000) else h) for a, o, n, h in second] + [("a1", 9_000_000, 7, "new"), ("b", 3, 1, "only")]
    out = sorted(tuple(x)[:3] for x in warc.audit(records(spark, first), records(spark, second)).collect())
    assert out == [("a0", 70_000, "corrupt"), ("a1", 5000, "missing"), ("a1", 9_000_000, "extra"), ("a2", 2_999_000, "missing"), ("b", 3, "extra")], out
    same = warc.audit(records(spark, first[:9000]), records(spark, first[:9000]))
    assert same.count() == 0 and warc.audit(records(spark, []), records(spark, [])).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two + b"broken")
    (tmp_path / "b.warc").write_bytes(gzip.compress(one) + gzip.compress(two))
    out = sorted((x.archive[-6:], x.offset, x.length, x.sha256) for x in warc.read_records(spark, str(tmp_path)).collect())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert [x[1:] for x in out if x[0] == "a.warc"] == [(0, len(one), digest(one)), (len(one), len(two), digest(two)), (len(one + two), 6, digest(b"broken"))]
    assert [x[3] for x in out if x[0] == "b.warc"] == [digest(one), digest(two)]


def test_damaged_archives(spark, tmp_path):
    """A flipped bit, a cut end and a false length cost the record that they are in; the audit names it."""
    import gzip

    made = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % (1000 + i) + bytes([65 + i]) * (1000 + i) + b"\r\n\r\n" for i in range(8)]
    zipped = [gzip.compress(x) for x in made]
    a, b = tmp_path / "a", tmp_path / "b"
    for folder in (a, b):
        folder.mkdir()
    starts = [sum(map(len, zipped[:i])) for i in range(9)]
    whole = b"".join(zipped)
    (a / "z.warc.gz").write_bytes(whole)
    for at in (starts[2] + 1, starts[2] + 15, starts[3] - 6, starts[3] + 3):
        (b / "z.warc.gz").write_bytes(whole[:at] + bytes([whole[at] ^ 0x40]) + whole[at + 1 :])
        read = lambda x: warc.read_records(spark, str(x)).withColumn("archive", F.lit("z"))
        found = warc.audit(read(a), read(b)).collect()
        hurt = 3 if at >= starts[3] else 2
        # damage in a header's flags may be none to the inflated bytes; elsewhere just the hurt record is named, or its neighbour where no start could be told
        assert {x.offset for x in found} <= {starts[hurt], starts[hurt - 1], starts[hurt + 1]} and len(found) >= (at != starts[3] + 3)
    (b / "z.warc.gz").write_bytes(whole[: starts[7] + 10])
    assert [(x.offset, x.status) for x in warc.audit(read(a), read(b)).collect()] == [(starts[7], "corrupt")]
    lied = made[1].replace(b"1001", b"1999")
    rows = list(warc.records_of(made[0] + lied + made[2]))
    assert [x[:2] for x in rows] == [(0, len(made[0])), (len(made[0]), len(lied)), (len(made[0] + lied), len(made[2]))] and list(warc.records_of(b"")) == []


def test_large_archive_is_read_in_linear_time():
    import gzip
    import time

    member = gzip.compress(b"WARC/1.1\r\n" + b"x" * 200)
    began = time.time()
    assert sum(1 for _ in warc.records_of(member * 300_000)) == 300_000  # 20 MB
    assert time.time() - began < 180


def test_page_records_edges(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é"), (1, "u", "<p>é"), (None, None, None), (2000, "", "")], "page_id long, url string, html string").withColumn("record", F.lit(1))
    out = sorted(warc.page_records(pages, per_archive=1000, extra={"whole": F.col("record")}).collect(), key=lambda x: (x.archive, x.offset))
    assert -4096 <= out[0].archive < 0 and [x.archive for x in out[1:]] == [0, 0, 2] and out[2].offset == out[1].length and all(hashlib.sha256(x.whole.encode()).hexdigest() == x.sha256 and len(x.whole.encode()) == x.length for x in out)
    assert warc.page_records(pages.limit(0)).count() == 0


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns = docs, docs.columns
    texts = {x.doc_id: x.text for x in docs.collect()}
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({x.doc_id for x in kept.select("doc_id").collect()})
        if k < 4:
            assert kept.columns == columns
    known = {x.doc_id for x in langid.identify(docs, docs.filter(~langid.held_out())).filter("lang_pred <> 'und' AND score >= 0.3").collect()}
    assert seen[0] == known and len(known) > 0.98 * len(texts)
    first = {}
    for i in sorted(seen[0]):
        first.setdefault(texts[i], i)
    assert seen[1] == set(first.values())
    from tests.llm.test_dedup import near_brute

    comp = near_brute([(i, texts[i]) for i in sorted(seen[1])], 5, 80)
    assert seen[2] == {i for i, c in comp.items() if i == c}
    bench = [x.text for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(b in texts[i] for i in seen[3] for b in bench) and len(seen[3]) > 0.9 * len(seen[2])
    assert seen[4] == seen[3]
    assert near_dedup.BANDS * near_dedup.ROWS <= near_dedup.HASHES
    assert {x.doc_id for x in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == seen[4]
