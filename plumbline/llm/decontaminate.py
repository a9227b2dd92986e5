"""Benchmark decontamination by template canonicalisation.

Words lose the punctuation around them. Numbers, spelt out or not, become <NUM>, units that follow a number <UNIT>, capitalised words inside a
sentence <NAME>; other words stand for themselves in lower case. Windows of WINDOW such tokens with at least LITERALS ordinary
words are hashed on both sides and joined on the hash; windows that hold placeholders are joined by their words as written,
too, so that verbatim copies are found however few ordinary words they have. A capitalised word that opens a sentence or line
may be a name or not, and where case was changed names can't be told: windows are joined with such openers as <NAME>, and
with no <NAME> at all, too. From hits on one diagonal (document position
minus item position) runs are extended token by token, over windows of few ordinary words as well. The longest stretch of a run
whose slots are consistent, that is, in which each slot value of the item always corresponds to the same value in the document,
makes the document contaminated if it has RUN windows (all of them, in shorter items).

The benchmark side is the hash join's build side. While it has at most BLOCK_WINDOWS words it is broadcast whole, and documents
aren't shuffled; a larger one is joined by a shuffle of window hashes, behind a filter of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.shared import Scratch, map_arrow, only
from plumbline.llm.textbytes import LOWER, buffers, hash_spans, mix, running, slices, word_spans

WINDOW, LITERALS, RUN = 8, 5, 3
BLOCK_WINDOWS = 2_000_000
#: The filter's bits, and those of a piece of it that one task makes, as powers of two; and items that are held against a text at a time.
FILTER_BITS, PIECE_BITS, RUN_ITEMS = 28, 18, 64
#: Unit words that count as units after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kph kmh hz khz mhz ghz w kw mw kwh v a j kj cal kcal n pa kpa bar k c f degree degrees percent usd eur gbp dollar dollars euro euros cent cents"
).split()
#: Words that count as numbers.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
NUM, UNIT, NAME = (np.uint64(x) for x in (0xA1, 0xB2, 0xC3))

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SMALL = np.zeros(256, bool)
_SMALL[0x61:0x7B] = True
_INNER = _DIGIT | _UPPER | _SMALL
_INNER[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _hashed(words: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(words, pa.string()))
    return hash_spans(data, offsets[:-1], offsets[1:])


_UNIT_HASHES, _NUMBER_HASHES = np.sort(_hashed(UNITS)), np.sort(_hashed(NUMBERS))


def _among(token: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token


class Text:
    """The words of a column that hold a letter or digit: data, starts, ends, rows; token: a word's hash or the value of its placeholder; wild: with capitalised openers of sentences as names, too; caseless: without names; literal: its hash."""

    def __init__(self, column: pa.Array):
        self.data, offsets = buffers(column)
        data = self.data
        starts, ends, rows = word_spans(data, offsets)
        if not len(starts):
            self.starts, self.ends, self.rows = starts, ends, rows
            self.token = self.wild = self.caseless = self.literal = np.zeros(0, np.uint64)
            return
        inner = np.flatnonzero(_INNER[data]).astype(np.int32)
        a, b = np.searchsorted(inner, starts), np.searchsorted(inner, ends) - 1
        has = b >= a
        # a word ends a sentence if a stop is among the bytes after its last letter or digit, or a line ends before the next word
        last = np.where(has, inner[np.minimum(b, len(inner) - 1)] + 1, starts)
        stops = running(_STOP[data] | (data == 0x0A))
        nxt = np.append(starts[1:], len(data))
        closes = stops[nxt] > stops[last]
        opens = np.concatenate(([True], closes[:-1] | (rows[1:] != rows[:-1])))
        starts, ends, rows, opens = inner[a[has]], inner[b[has]] + 1, rows[has], opens[has]
        token = hash_spans(data, starts, ends)
        digits = running(_DIGIT[data])
        number = _DIGIT[data[starts]] & (2 * (digits[ends] - digits[starts]) >= np.minimum(ends - starts, 8)) | _among(token, _NUMBER_HASHES)
        del stops
        small = running(_SMALL[data])
        shaped = _UPPER[data[starts]] & (small[ends] - small[starts] >= np.maximum(1, (ends - starts) // 2))
        before = np.concatenate(([False], number[:-1] & (rows[1:] == rows[:-1])))
        unit = before & _among(token, _UNIT_HASHES)
        self.starts, self.ends, self.rows, self.literal = starts, ends, rows, token
        self.caseless = np.where(number, NUM, np.where(unit, UNIT, token))
        self.wild = np.where(shaped & (self.caseless > NAME), NAME, self.caseless)
        self.token = np.where(opens, self.caseless, self.wild)

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.data[x:y].tobytes().lower() for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first positions of the windows of size tokens, of `token`, and of the other readings where these differ."""
        found = [
            windows(self.token, self.rows, size),
            windows(self.wild, self.rows, size, self.wild != self.token),
            windows(self.caseless, self.rows, size, self.caseless != self.token),
            windows(self.literal, self.rows, size, self.literal != self.caseless),
        ]
        h, at = (np.concatenate(x) for x in zip(*found))
        return h, at

    def agree(self, mine: slice, other: Text, theirs: slice) -> np.ndarray:
        """Whether tokens are equal in some reading."""
        return np.logical_or.reduce([x[mine] == y[theirs] for x, y in zip((self.token, self.wild, self.caseless, self.literal), (other.token, other.wild, other.caseless, other.literal))])


def canonical(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end, row, token) of each word that holds a letter or digit; token: its hash or the value of its placeholder."""
    text = Text(column)
    return text.data, text.starts, text.ends, text.rows, text.token


def windows(token: np.ndarray, rows: np.ndarray, size: int, over: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of the windows of size tokens within a row that have enough ordinary words and, if given, one of the tokens `over`."""
    full = len(token) - size + 1
    if full <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    plain = np.concatenate(([0], np.cumsum(token > NAME)))
    ok = (rows[:full] == rows[size - 1 :]) & (plain[size:] - plain[:-size] >= min(LITERALS, size - size // 3))
    if over is not None:
        held = np.concatenate(([0], np.cumsum(over)))
        ok &= held[size:] > held[:-size]
    at = np.flatnonzero(ok)
    h = np.full(len(at), np.uint64(size))
    for j in range(size):
        h += token[at + j] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    return mix(h), at


class Block:
    """Windows of some benchmark items, sorted by hash, and the items' tokens and words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.text = text = Text(pa.array([t for _, t in items], pa.string()))
        self.first = np.searchsorted(text.rows, np.arange(len(items) + 1))
        self.words = text.words(0, len(text.rows))
        self.length = np.diff(self.first)
        self.sizes = sorted({WINDOW} | {int(n) for n in np.unique(self.length) if 0 < n < WINDOW})
        found = []
        for size in self.sizes:
            h, at = text.windows(size)
            own = (self.length[text.rows[at]] == size) if size < WINDOW else np.ones(len(at), bool)
            found.append((h[own], at[own], np.full(int(own.sum()), size)))
        h, at, size = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h, kind="stable")
        self.hashes, self.at, self.size = h[order], at[order], size[order]
        self.item = text.rows[self.at] if len(self.at) else np.zeros(0, np.int64)


def _consistent(block: Block, words: list[bytes], text: Text, first: int, item_at: int, doc_at: int, n: int) -> tuple[int, bool]:
    """The longest stretch of n tokens aligned from these places in which each slot value of the item has one value in the document: its tokens, and whether a value differs. An opener of a sentence is a slot only where it differs."""
    slots: dict[bytes, list[int]] = {}  # of each value of the item the places in the stretch
    best, begin, differ = (0, False), 0, 0
    pairs = []
    for j in range(n):
        mine, theirs = block.words[item_at + j], words[doc_at + j - first]
        slot = mine != theirs or text.token[doc_at + j] <= NAME or block.text.token[item_at + j] <= NAME
        pairs.append((mine, theirs, slot))
        if slot:
            own = slots.setdefault(mine, [])
            if own and pairs[own[-1]][1] != theirs:  # the stretch goes on behind the last place that says otherwise
                stop = own[-1] + 1
                for k in range(begin, stop):
                    if pairs[k][2]:
                        slots[pairs[k][0]].pop(0)
                        differ -= pairs[k][0] != pairs[k][1]
                begin = stop
            own.append(j)
            differ += mine != theirs
        if j + 1 - begin > best[0]:
            best = j + 1 - begin, differ > 0
    return best


def _extended(block: Block, text: Text, item: int, shift: int, span: tuple[int, int], places: set[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(first token, end, windows) of each stretch of agreeing tokens on a diagonal that holds a hit; span: the document's tokens."""
    if block.length[item] <= WINDOW:
        yield from ((p, p + size, 1) for p, size in places)
        return
    lo, hi = max(span[0], int(block.first[item]) + shift), min(span[1], int(block.first[item + 1]) + shift)
    mine, theirs = slice(lo - shift, hi - shift), slice(lo, hi)
    agrees = block.text.agree(mine, text, theirs)
    gaps = np.concatenate(([lo - 1], np.flatnonzero(~agrees) + lo, [hi]))
    for k in sorted({int(np.searchsorted(gaps, p, "right")) for p, _ in places}):
        a, b = int(gaps[k - 1]) + 1, int(gaps[k])
        yield a, b, b - a - WINDOW + 1


def _matches(part: pa.RecordBatch, block: Block) -> dict[int, list[tuple[int, int, bool]]]:
    """row -> (item, windows, changed) of each item found in it."""
    text = Text(part.column("text"))
    rows = text.rows
    hits: dict[int, dict[tuple[int, int], set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
    for size in block.sizes:
        h, at = text.windows(size)
        lo, hi = (np.searchsorted(block.hashes, h, side) for side in ("left", "right"))
        i = np.repeat(np.arange(len(h)), hi - lo)
        j = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - hi + lo, hi - lo) + lo[i]
        same = block.size[j] == size
        i, j = i[same], j[same]
        for row, item, shift, p in zip(*(x.tolist() for x in (rows[at[i]], block.item[j], at[i] - block.at[j], at[i]))):
            hits[row][item, shift].add((p, size))
    out: dict[int, list[tuple[int, int, bool]]] = {}
    for row, diagonals in hits.items():
        a, b = np.searchsorted(rows, [row, row + 1]).tolist()
        words = None
        best: dict[int, tuple[int, bool]] = {}
        for (item, shift), places in diagonals.items():
            need = min(RUN, max(1, int(block.length[item]) - WINDOW + 1))
            for p, end, n in _extended(block, text, item, shift, (a, b), places):
                if n >= need and n > best.get(item, (0, False))[0]:
                    if words is None:
                        words = text.words(a, b)
                    tokens, changed = _consistent(block, words, text, a, p - shift, p, end - p)
                    n -= end - p - tokens  # windows of the stretch
                    if n >= need and n > best.get(item, (0, False))[0]:
                        best[item] = (n, changed)
        if best:
            out[row] = [(block.ids[item], n, changed) for item, (n, changed) in sorted(best.items())]
    return out


def _scan(batches: Iterator[pa.RecordBatch], block: Block, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Adds a block's matches to those in the columns items (of ids of a kind), n_windows and changed."""
    for batch in batches:
        for part in slices(batch, "text"):
            found = _matches(part, block)
            items, counts, changed = (part.column(c).to_pylist() for c in ("items", "n_windows", "changed"))
            for row, own in found.items():
                items[row] = sorted(items[row] + [x[0] for x in own])
                counts[row] += sum(x[1] for x in own)
                changed[row] = changed[row] or any(x[2] for x in own)
            new = {"items": pa.array(items, pa.list_(kind)), "n_windows": pa.array(counts, pa.int64()), "changed": pa.array(changed, pa.bool_())}
            yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names], part.schema.names)


def _codes(text: Text, at: np.ndarray, h: np.ndarray, size: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, index into at) of windows with the need - 1 tokens beside them, before, behind or on both sides: a code for each way in which these can be read.

    A window within a stretch of `need` windows that agree has a code in common with its like, whatever the readings in which its neighbours agree.
    """
    found = []
    for left in range(need):
        beside = [*range(-left, 0), *range(size, size + need - 1 - left)]
        places = [at + j for j in beside]
        ok = np.logical_and.reduce([(p >= 0) & (p < len(text.rows)) & (text.rows[np.clip(p, 0, len(text.rows) - 1)] == text.rows[at]) for p in places] or [np.ones(len(at), bool)])
        index = np.flatnonzero(ok)
        codes = [h[index] + np.uint64(need * RUN + left)]
        for p in places:
            values = [text.token[p[index]]]
            values += [np.where(x[p[index]] == values[0], values[0], x[p[index]]) for x in (text.wild, text.caseless, text.literal)]
            codes = [mix(c * np.uint64(0xC2B2AE3D27D4EB4F) + v) for c in codes for v in values]
        found += [np.stack((c, index.astype(np.uint64))) for c in codes]
    code, index = np.unique(np.concatenate(found, axis=1), axis=1)
    return code, index.astype(np.int64)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, hash, size, need, code) of the windows of items (item, item_id, text) with the tokens beside them; need: how many successive windows of the item a text must have."""
    for batch in batches:
        block = Block(list(zip(range(batch.num_rows), batch.column("text").to_pylist())))
        needed = np.minimum(RUN, np.maximum(1, block.length[block.item] - WINDOW + 1))
        for size in block.sizes:
            for need in range(1, RUN + 1):
                own = np.flatnonzero((block.size == size) & (needed == need))
                if len(own):
                    code, index = _codes(block.text, block.at[own], block.hashes[own], size, need)
                    columns = [block.hashes[own[index]].view(np.int64), np.full(len(code), size), np.full(len(code), need), code.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(block.item[own[index]])), *map(pa.array, columns)], ["item", "hash", "size", "need", "code"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, bits) of the places of hashes in a filter of 1 << FILTER_BITS bits, for a partition that has all hashes of its pieces."""
    pieces: dict[int, np.ndarray] = {}
    for batch in batches:
        place = batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        piece, inner = (place >> np.uint64(PIECE_BITS)).astype(np.int64), (place & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int64)
        for k in np.unique(piece).tolist():
            own = pieces.setdefault(k, np.zeros(1 << PIECE_BITS, bool))
            own[inner[piece == k]] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([np.packbits(b).tobytes() for b in pieces.values()], pa.binary())], ["piece", "bits"])


def _possible(batches: Iterator[pa.RecordBatch], bits: np.ndarray, sizes: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(key, code, size) of windows of texts (key, text) that the filter doesn't rule out; sizes: (size, need) of the items' windows."""
    for batch in batches:
        for part in slices(batch, "text"):
            text = Text(part.column("text"))
            for size in sorted({s for s, _ in sizes}):
                h, at = text.windows(size)
                place = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                good = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                h, at = h[good], at[good]
                for need in (n for s, n in sizes if s == size):
                    code, index = _codes(text, at, h, size, need)
                    found = np.unique(np.stack((text.rows[at[index]], code.view(np.int64))), axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(found[0])), pa.array(found[1]), pa.array(np.full(found.shape[1], size))], ["key", "code", "size"])


def _verified(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(key, item_id, n, changed) of the items found in texts, from rows (key, item_id, text) in which each run of items follows its text (item_id NULL)."""
    key, body, items = None, None, []

    def judged() -> Iterator[pa.RecordBatch]:
        found = _matches(pa.RecordBatch.from_arrays([pa.array([body], pa.string())], ["text"]), Block(items)).get(0, []) if items else []
        ids, n, changed = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(ids), pa.string()), pa.array(ids, kind), pa.array(n, pa.int64()), pa.array(changed, pa.bool_())], ["key", "item_id", "n", "changed"])

    for batch in batches:
        for k, i, t in zip(*(batch.column(c).to_pylist() for c in ("key", "item_id", "text"))):
            if i is None:
                yield from judged()
                key, body, items = k, t, []
            else:
                items.append((i, t))
    yield from judged()


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """What _scan adds, by a join of window hashes: for a benchmark that is too large to be sent to the workers.

    A window is joined with the tokens beside it that make a stretch long enough, so a phrase of many items joins no text to all of them, and yet each pair
    that the broadcast would find is among those joined. Of the texts' windows those go into the join that a filter of 1 << FILTER_BITS bits, made of the items' windows, lets
    through. The items that share a window with a text are then held against it one by one, RUN_ITEMS at a time in one task
    with the text in front, so neither a text with many items nor a window that many have meets in one task. Equal texts are
    judged once.
    """
    spark = rows.sparkSession
    scratch = Scratch()
    kind, name = to_arrow_type(items.schema["item_id"].dataType), items.schema["item_id"].dataType.simpleString()
    items = scratch(items.select(F.sha2(F.concat_ws("|", F.col("item_id").cast("string"), "text"), 256).alias("item"), "item_id", "text"), "items")
    own = scratch(map_arrow(items, _item_windows, "item string, hash long, size long, need long, code long"), "item-windows")
    piece = F.shiftrightunsigned("hash", 64 - FILTER_BITS + PIECE_BITS)
    bits = np.zeros((1 << (FILTER_BITS - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8)
    for r in map_arrow(own.select("hash").repartition(piece), _bits, "piece long, bits binary").toLocalIterator():  # as many bits in all as the filter has
        bits[r["piece"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    sizes = sorted((r["size"], r["need"]) for r in own.select("size", "need").distinct().collect())  # at most WINDOW + RUN
    shared = spark.sparkContext.broadcast(bits.ravel())
    key = F.sha2(F.col("text").cast("binary"), 256)
    texts = rows.select(key.alias("key"), "text").filter("text IS NOT NULL")
    seen = map_arrow(texts, lambda b: _possible(b, shared.value, sizes), "key string, code long, size long").distinct()
    pairs = scratch(seen.join(own.select("item", "code", "size").distinct(), ["code", "size"]).select("key", "item").distinct(), "text-items")
    many = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("having")).filter(F.col("having") > RUN_ITEMS)
    dealt = scratch(pairs.join(many, "key", "left").select("key", "item", F.pmod(F.xxhash64("item"), F.ceil(F.coalesce("having", F.lit(1)) / RUN_ITEMS)).alias("run")), "text-runs")
    heads = texts.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).join(dealt.select("key", "run").distinct(), "key").select("key", "run", F.lit(None).cast(name).alias("item_id"), "text")
    members = dealt.join(items, "item").select("key", "run", "item_id", "text")
    met = heads.unionByName(members).repartition("key", "run").sortWithinPartitions("key", "run", F.col("item_id").asc_nulls_first(), "text").select("key", "item_id", "text")
    found = map_arrow(met, lambda b: _verified(b, kind), f"key string, item_id {name}, n long, changed boolean")
    found = scratch(found.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"), F.sum("n").alias("n_windows"), F.bool_or("changed").alias("changed")), "texts-found")
    scratch.drop("items", "item-windows", "text-items", "text-runs")
    out = rows.withColumn("found_key", key).join(found.withColumnRenamed("key", "found_key"), "found_key", "left").drop("found_key")
    return out.withColumns({"items": F.coalesce("items", F.array().cast(f"array<{name}>")), "n_windows": F.coalesce("n_windows", F.lit(0).cast("long")), "changed": F.coalesce("changed", F.lit(False))})


def _found(rows: DataFrame, benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """rows (text, and others) with items, n_windows and changed. A benchmark of at most BLOCK_WINDOWS words is sent to the workers whole: an item has no more windows than words."""
    items = only(benchmark, item_col, text_col).toDF("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    kind = items.schema["item_id"].dataType
    if (items.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0) > BLOCK_WINDOWS:
        return _joined(rows, items)
    block = rows.sparkSession.sparkContext.broadcast(Block([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]))  # bounded by BLOCK_WINDOWS words
    out = rows.withColumns({"items": F.array().cast(f"array<{kind.simpleString()}>"), "n_windows": F.lit(0).cast("long"), "changed": F.lit(False)})
    arrow = to_arrow_type(kind)
    return map_arrow(out, lambda b: _scan(b, block.value, arrow), out.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, contaminated, item_ids (sorted), n_windows (of the items' longest consistent runs), reparameterised (a slot's value differs).

    NULL, empty and wordless texts are clean; so are all texts if the benchmark is empty; items of NULL id or text, and items
    without words, match nothing; repeated items count once. item_ids are of the benchmark's own type, numbers or texts. Repeated documents are judged each by itself. Of several places
    where an item matches, the longest counts. Further columns of either table are ignored.
    """
    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    found = _found(rows, benchmark, item_col, item_text_col)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.col("items").alias("item_ids"), "n_windows", F.col("changed").alias("reparameterised"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item is found; rows of NULL text stay."""
    rows = docs.select(F.struct(F.lit(0).alias("none"), *[docs[c] for c in docs.columns if c != text_col]).alias("rest"), docs[text_col].alias("text"))
    clean = _found(rows, benchmark, item_col, item_text_col).filter(F.size("items") == 0)
    return clean.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
