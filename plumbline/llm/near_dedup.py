"""Near-duplicate components by b-bit MinHash.

1. One pass over the texts gives each document's shingle-set size and 128-bit fingerprint, BANDS keys of ROWS minima each,
   and the low BITS bits of all HASHES minima, packed into longs.
2. Documents with equal sets form a class at once (a group-by that combines on the map side); all that follows works on one
   representative of a class, so exact copies cost nothing more.
3. Within a band bucket, members are compared to one head only, the member that meets most others in all of its buckets (in
   a family of edited copies that is the text that the others are nearest to): as many candidates as members. A candidate
   goes on if its similarity, estimated from equal lanes by bit counts and corrected for chance collisions of BITS bits,
   comes within SLACK standard errors of the threshold, and becomes a link if the full sets confirm it.
4. Members that share a head but are still in several components are compared with each other by their edits, the shingles in
   which they differ from the head. |A ^ B| of two members follows from their numbers of edits and of common edits, so the
   threshold says how many edits the two must have in common: at least one, where not both are links of the head, and mostly
   about half of the smaller side. Edits are put in order from the rarest on, and members meet that share one within the
   prefixes that such an overlap can't miss; sizes, edits that no other member has and places of the shared edit bound the
   overlap further. This loses no pair that shares a head. The estimate and the full sets decide about those that remain.

A pair at the threshold shares no band with probability (1 - 0.8^ROWS)^BANDS, below 5e-8, and fails the estimate with
probability below 4e-6 (SLACK standard errors); both are that unlikely for each of the ways in which a document is linked.
Sizes, fingerprints and edits are of 64-bit hashes of shingles: two shingles of one text of a million words collide with
probability 3e-8. Links are confirmed on the words themselves.

Texts meet at their head in runs of about RUN_ROWS members, the head's text in front of each run: a task holds the head's set
and one small batch, however many members a head has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.components import connected_components
from plumbline.llm.shared import FILE_BYTES, Scratch, map_arrow, only
from plumbline.llm.textbytes import mix, shingle_sets, slices

BANDS, ROWS, BITS, HASHES = 32, 4, 4, 512
LANES = 64 // BITS
LONGS = HASHES // LANES
SLACK = 4.5
RUN_ROWS = 16
_RNG = np.random.default_rng(77003)
_A = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND = _RNG.integers(0, 1 << 63, (ROWS + 1, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = [f"s{j}" for j in range(LONGS)]


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's mixed hashes; 0 for empty sets."""
    sums = []
    for salt in (np.uint64(0x1234567), np.uint64(0xABCDEF987654321)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt), dtype=np.uint64)))
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums[0], sums[1]


def minima(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, HASHES) minima of random linear functions of each set's 32-bit hashes; sets must not be empty."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(low * _A[k] + _B[k], bounds[:-1])
    return out


def sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, bounds = shingle_sets(part.column("text"), k)
            n = np.diff(bounds)
            f1, f2 = fingerprints(h, bounds)
            has = np.flatnonzero(n > 0)
            m = minima(h, np.append(bounds[:-1][has], bounds[-1])) if len(has) else np.zeros((0, HASHES), np.uint32)
            keys = np.zeros((len(n), BANDS), np.int64)
            packed = np.zeros((len(n), LONGS), np.int64)
            wide = m.astype(np.uint64)
            key = np.repeat(_BAND[ROWS][None, :], len(has), 0)
            for r in range(ROWS):
                key = mix(key ^ (wide[:, r : BANDS * ROWS : ROWS] * _BAND[r]))
            keys[has] = key.view(np.int64)
            bits = wide & np.uint64((1 << BITS) - 1)
            lanes = np.zeros((len(has), LONGS), np.uint64)
            for i in range(LANES):
                lanes |= bits[:, i::LANES] << np.uint64(BITS * i)
            packed[has] = lanes.view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(f1), pa.array(f2), bands, *[pa.array(packed[:, j].copy()) for j in range(LONGS)]], ["doc_id", "n", "f1", "f2", "bands", *SIGNATURE])


def estimated(left: str, right: str) -> Column:
    """Similarity from the share of equal lanes E: (E - 2^-b) / (1 - 2^-b)."""
    ones = sum(1 << (BITS * i) for i in range(LANES))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differ = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        y = x
        for shift in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(y.bitwiseAND(F.lit(ones)))
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def spelt_shingles(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The set of word shingles, as words. bytes.lower and bytes.split know ASCII only, as the contract does."""
    words = (text or "").encode().lower().split()
    return set(zip(*(words[j:] for j in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


def _meetings(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """(row, head's hashes, member's hashes, head's text, member's text) of rows (u, v, f1, f2, text) in which each run of members follows its head (v NULL). Rows whose set hasn't the fingerprints expected of it are left out: their identifier is repeated."""
    head: tuple = (None, None, None)
    for batch in batches:
        for part in slices(batch, "text"):
            h, bounds = shingle_sets(part.column("text"), k)
            f1, f2 = fingerprints(h, bounds)
            good = (f1 == part.column("f1").to_numpy()) & (f2 == part.column("f2").to_numpy())
            us, vs, texts = part.column("u").to_pylist(), part.column("v").to_pylist(), part.column("text")
            for i in np.flatnonzero(good).tolist():
                mine = h[bounds[i] : bounds[i + 1]]
                if vs[i] is None:
                    head = (us[i], mine.copy(), texts[i])
                elif head[0] == us[i]:
                    yield (us[i], vs[i]), head[1], mine, head[2], texts[i]


def _linked(batches: Iterator[pa.RecordBatch], k: int, percent: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose full sets reach the threshold; sets of hashes are looked at first, words decide."""
    good = []
    for pair, a, b, text_a, text_b in _meetings(batches, k):
        both = len(a) + len(b)
        merged = np.concatenate((a, b))
        merged.sort()
        common = int((merged[1:] == merged[:-1]).sum())
        if 100 * common >= percent * (both - common):
            x, y = spelt_shingles(text_a.as_py(), k), spelt_shingles(text_b.as_py(), k)
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                good.append(pair)
    u, v = zip(*good) if good else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])


def _edits(batches: Iterator[pa.RecordBatch], k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(u, v, head_n, added, removed, edit): one row for each shingle that only one of head u, of head_n shingles, and member v has."""
    pairs: list = []
    sizes: list = []
    made: list = []
    total = 0

    def out():
        n = np.array([len(x) for x in made])
        at = np.repeat(np.arange(len(pairs)), n)
        u, v = (pa.array([p[i] for p in pairs], kind).take(pa.array(at)) for i in (0, 1))
        counts = [pa.array(np.array([x[i] for x in sizes], np.int64)[at]) for i in range(3)]
        return pa.RecordBatch.from_arrays([u, v, *counts, pa.array(np.concatenate(made).view(np.int64))], ["u", "v", "head_n", "added", "removed", "edit"])

    for pair, a, b, _, _ in _meetings(batches, k):
        merged = np.concatenate((a, b))
        merged.sort()
        twice = np.flatnonzero(merged[1:] == merged[:-1])
        own = np.ones(len(merged), bool)
        own[twice] = own[twice + 1] = False
        pairs.append(pair)
        sizes.append((len(a), len(b) - len(twice), len(a) - len(twice)))
        made.append(merged[own])
        total += len(made[-1])
        if total > 1 << 17:
            yield out()
            pairs, sizes, made, total = [], [], [], 0
    if total:
        yield out()


def _met_at_heads(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (u, v, f1, f2, text) of the members v of pairs (u, v), dealt in runs of one u and about RUN_ROWS members; in front of each run the head's row, of NULL v."""
    many = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("having")).filter(F.col("having") > RUN_ROWS)
    runs = F.ceil(F.coalesce("having", F.lit(1)) / RUN_ROWS)
    dealt = pairs.join(many, "u", "left").select("u", F.pmod(F.xxhash64("v"), runs).alias("run"), "v")
    texts = reps.select("rep", "f1", "f2").join(docs.withColumnRenamed("doc_id", "rep"), "rep")
    members = dealt.join(texts, F.col("v") == F.col("rep")).select("u", "run", "v", "f1", "f2", "text")
    heads = dealt.select("u", "run").distinct().join(texts, F.col("u") == F.col("rep")).select("u", "run", F.lit(None).cast(pairs.schema["v"].dataType).alias("v"), "f1", "f2", "text")
    rows = heads.unionByName(members).repartition("u", "run").sortWithinPartitions("u", "run", F.col("v").asc_nulls_first())
    return rows.select("u", "v", "f1", "f2", "text")


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) of representatives that are links."""
    kind = pairs.schema["u"].dataType
    arrow = to_arrow_type(kind)
    return map_arrow(_met_at_heads(pairs, docs, reps), lambda b: _linked(b, k, percent, arrow), f"u {kind.simpleString()}, v {kind.simpleString()}").distinct()


def _rest(families: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of rows (u, v, component), members v of a head u and the components that they are in so far: links (u, v) with the head itself, and pairs (u, v) of members of one head and of different components that contain all further links among these.

    With a member's `need` = (100 + percent)(added + removed) - (100 - percent)(size of the head + added - removed), two members
    are a link if and only if 2 (100 + percent) |common edits| >= the sum of their needs, and one is a link of the head if and
    only if its need is at most (100 - percent) times the head's size.
    """
    kind = families.schema["u"].dataType
    arrow = to_arrow_type(kind)
    whole = 100 + percent
    spelt = map_arrow(_met_at_heads(families.select("u", "v"), docs, reps), lambda b: _edits(b, k, arrow), f"u {kind.simpleString()}, v {kind.simpleString()}, head_n long, added long, removed long, edit long")
    edits = scratch(spelt, "edits")
    shared = edits.groupBy("u", "edit").agg(F.count(F.lit(1)).alias("having")).filter("having > 1")
    need = whole * (F.col("added") + F.col("removed")) - (100 - percent) * (F.col("head_n") + F.col("added") - F.col("removed"))
    over = F.col("need") - (100 - percent) * F.col("head_n")  # above 0: no link of the head
    # the least overlap with any partner: for a link of the head, with members that aren't; for others, with any set
    least = F.when(over <= 0, F.floor((percent * F.col("added") + 100 * F.col("removed")) / whole) + 1).otherwise(F.ceil(over / 200))
    own = Window.partitionBy("u", "v")
    known = edits.join(shared, ["u", "edit"]).join(families, ["u", "v"]).withColumn("need", need)
    known = known.withColumns({"cap": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy("having", "edit")), "least": F.greatest(least, F.lit(1))})
    prefix = scratch(known.filter(F.col("place") <= F.col("cap") - F.col("least") + 1).select("u", "edit", "v", "component", "need", "cap", "place"), "edit-prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    room = 1 + F.least(F.col("a.cap") - F.col("a.place"), F.col("b.cap") - F.col("b.place"))
    met = a.join(b, (F.col("a.u") == F.col("b.u")) & (F.col("a.edit") == F.col("b.edit")) & (F.col("a.v") < F.col("b.v")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.need") + F.col("b.need") <= 2 * whole * room))
    with_head = edits.select("u", "v", "head_n", "added", "removed").distinct().withColumn("need", need).filter(over <= 0).select("u", "v")
    return with_head, met.select(F.col("a.v").alias("u"), F.col("b.v").alias("v")).distinct()


def near_dedup(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct word shingles (A-Z in lower case;
    fewer words: the whole sequence is one shingle). component_id is the least identifier reachable by links. NULL, empty
    and word-less texts have an empty set and stay alone. Rows that repeat an identifier share its component: kept is true
    for each of them if it is the component's identifier. Rows without identifier are never linked: component_id is NULL and
    kept is true. Empty tables give empty results; further columns are ignored.
    """
    return _near_dedup(docs, shingle, percent, id_col, text_col)[0]


def _near_dedup(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """What near_dedup returns, and how many files texts and sketches fill."""
    scratch = Scratch()
    docs = only(docs, id_col, text_col).toDF("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, f1 long, f2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)
    sketches = scratch(map_arrow(docs, lambda b: sketch(b, shingle), schema), "sketches")
    n_docs, n_shingles = sketches.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    scratch.files = max(1, -(-(1024 * n_docs + 8 * n_shingles) // FILE_BYTES))  # of a sketch and the text: what the widest tables hold
    usable = sketches.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = scratch(usable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in SIGNATURE]), "classes")
    rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = scratch(rows.join(shared, "key"), "band-members")
    meets = met.groupBy("rep").agg(F.sum("members").alias("meets"))
    heads = met.join(meets, "rep").groupBy("key").agg(F.min_by("rep", F.struct(-F.col("meets"), F.col("rep"))).alias("head"))
    buckets = scratch(met.join(heads, "key"), "buckets")
    # only what shares a band with something else is carried further
    sides = scratch(reps.join(meets, "rep", "left_semi").select("rep", "f1", "f2", "n", *SIGNATURE), "sides")
    docs = scratch(docs.join(meets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "texts")

    share = percent / 100
    lanes = share + (1 - share) * 2.0**-BITS
    floor = share - SLACK * (lanes * (1 - lanes) / HASHES) ** 0.5 / (1 - 2.0**-BITS)

    def probable(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose sizes and estimate allow a link."""
        a, b = sides.alias("a"), sides.alias("b")
        near = pairs.alias("p").join(a, F.col("p.u") == F.col("a.rep")).join(b, F.col("p.v") == F.col("b.rep"))
        return near.filter((100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (estimated("a", "b") >= floor)).select("u", "v")

    first = scratch(probable(buckets.filter("rep != head").select(F.col("head").alias("u"), F.col("rep").alias("v")).distinct()), "star-pairs")
    edges = scratch(_confirm(first, docs, sides, shingle, percent), "star-links")
    comps = scratch(connected_components(edges), "star-components")

    seen = buckets.filter("members > 2").select("key", "rep", "head").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    unsettled = seen.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("greatest")).filter("least != greatest").select("key")
    families = scratch(seen.join(unsettled, "key").filter("rep != head").select(F.col("head").alias("u"), F.col("rep").alias("v"), "component").distinct(), "families")
    with_head, pairs = _rest(families, docs, sides, shingle, percent, scratch)
    again = scratch(probable(pairs), "late-pairs")
    late = scratch(_confirm(again.unionByName(with_head.join(edges, ["u", "v"], "left_anti")), docs, sides, shingle, percent), "late-links")
    joined = scratch(connected_components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late)), "components")
    scratch.drop("band-members", "buckets", "sides", "texts", "star-pairs", "star-links", "star-components", "families", "edits", "edit-prefixes", "late-pairs", "late-links")

    groups = reps.select("n", "f1", "f2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("n").alias("gn"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "rep").alias("group"))
    out = sketches.select("doc_id", "n", "f1", "f2").join(groups, (F.col("n") == F.col("gn")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), scratch.files


def without_near_copies(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but for those whose identifier is not their component's; rows without identifier stay."""
    found, files = _near_dedup(docs, shingle, percent, id_col, text_col)
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti").coalesce(files)


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2, percent=80)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets
), grams AS (SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), pairs AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, pairs.v FROM reach JOIN pairs ON pairs.u = reach.seen
)
SELECT doc_id, any_value(n) AS n_shingles, min(seen) AS component_id, min(seen) = doc_id AS kept FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""
