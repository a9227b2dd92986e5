"""n-grams of many texts at once: numpy over the UTF-8 buffer of an Arrow column, without a Python object per token.

Tokens are runs of ASCII letters, digits and apostrophes in lower case, as `text.alnum_tokens` has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TOKEN = np.zeros(256, bool)
for _from, _to in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x27, 0x28)):
    _TOKEN[_from:_to] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are cut at a time, and n-grams that a task gathers before it passes them on.
BLOCK, GATHERED = 1 << 20, 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Grams:
    """The distinct n-grams of each text of a column: row, hash and 32 bits of another one, and the first and last byte of one occurrence; `spelt` has their text."""

    def __init__(self, column: pa.Array, n: int) -> None:
        column = column.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data, self.n = _LOWER[data], n
        # a mark before and after each text keeps its tokens from running into the next
        token = np.zeros(len(data) + 1, bool)
        token[:-1] = _TOKEN[data]
        edges = np.flatnonzero(np.diff(token, prepend=False))
        cuts = (at - at[0])[1:-1]
        inside = cuts[(cuts > 0) & (cuts < len(data))]
        inside = np.unique(inside[token[inside] & token[inside - 1]])
        edges = np.sort(np.concatenate((edges, inside, inside)))
        starts, ends = edges[0::2], edges[1::2]
        rows = np.searchsorted(at - at[0], starts, "right") - 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[self.data] * _powers(_STEP, len(data)), dtype=np.uint64)))
        words = _mixed((total[ends] - total[starts]) * _powers(_BACK, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
        full = max(0, len(words) - n + 1)
        h = np.zeros(full, np.uint64)
        other = np.zeros(full, np.uint64)
        for j in range(n):
            h = h * _STEP + words[j : j + full]
            other = other * _OTHER + words[j : j + full]
        whole = np.flatnonzero(rows[:full] == rows[n - 1 :][:full]) if full else np.zeros(0, np.int64)
        h, rows = _mixed(h[whole]), rows[whole]
        order = np.lexsort((h, rows))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        keep = order[new]
        self.checks = (_mixed(other[whole[keep]] ^ _OTHER) >> np.uint64(32)).astype(np.uint32)
        self.rows, self.hashes, self.first, self.last = rows[keep], h[keep], starts[whole[keep]], ends[whole[keep] + n - 1]

    def spelt(self, which: np.ndarray) -> list[str]:
        held, token = self.data.tobytes(), _TOKEN.tobytes()
        blank = bytes(0x20 if not token[i] else i for i in range(256))
        return [b" ".join(held[a:b].translate(blank).split()).decode() for a, b in zip(self.first[which].tolist(), self.last[which].tolist())]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The first column in runs of whole texts of about BLOCK bytes; a longer text by itself."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + BLOCK, "right")))
            yield batch.column(0).slice(start, stop - start)
            start = stop


def counted(batches: Iterator[pa.RecordBatch], n: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, hashes, counts): in how many texts each hash is, as arrays for each range of hashes."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        h, counts = np.unique(np.concatenate(held), return_counts=True)
        of = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        bounds = np.searchsorted(of, np.arange(ranges + 1))
        parts = [(r, h[a:b], counts[a:b]) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
        columns = [pa.array([r for r, _, _ in parts], pa.int32()), *[pa.array([x[i].astype(kind).tobytes() for x in parts], pa.binary()) for i, kind in ((1, np.uint64), (2, np.uint32))]]
        return pa.RecordBatch.from_arrays(columns, ["range", "hashes", "counts"])

    for block in blocks(batches):
        held.append(Grams(block, n).hashes)
        if sum(map(len, held)) >= GATHERED:
            yield out()
            held = []
    if held:
        yield out()


def frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The hashes of at least `least` texts, of rows (range, hashes, counts) in order of their ranges."""
    now, held = None, []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            h, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            total = np.bincount(place, np.concatenate([c for _, c in held]))
            yield pa.RecordBatch.from_arrays([pa.array(h[total >= least].view(np.int64))], ["h"])

    for batch in batches:
        for r, h, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if r != now:
                yield from out()
                now, held = r, []
            held.append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)))
    yield from out()


def planes(x: np.ndarray) -> bytes:
    """Numbers by their first bytes, then their second ones and so on: of numbers in order the high bytes repeat, and so shrink."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _summed(h: np.ndarray, checks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of hash and check in order, and the sums of their counts."""
    order = np.lexsort((checks, h))
    h, checks = h[order], checks[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (checks[1:] != checks[:-1]))))
    return h[new], checks[new], np.add.reduceat(counts[order], new)


def checked(batches: Iterator[pa.RecordBatch], n: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, hashes, checks, counts): in how many texts each hash with its check is, as planes for each range of hashes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        h, checks = (np.concatenate(x) for x in zip(*held))
        h, checks, counts = _summed(h, checks, np.ones(len(h), np.int64))
        bounds = np.searchsorted((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
        parts = [(r, a, b) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
        columns = [pa.array([planes(x[a:b].astype(kind)) for _, a, b in parts], pa.binary()) for x, kind in ((h, np.uint64), (checks, np.uint32), (counts, np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in parts], pa.int32()), *columns], ["range", "hashes", "checks", "counts"])

    total = 0
    for block in blocks(batches):
        grams = Grams(block, n)
        if len(grams.hashes):
            held.append((grams.hashes, grams.checks))
            total += len(grams.hashes)
        if total >= GATHERED:
            yield out()
            held, total = [], 0
    if held:
        yield out()


def shared(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(n): how many hashes with their checks at least `least` texts have, for each range of rows (range, hashes, checks, counts) in order of their ranges."""
    now, held = None, []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            *_, total = _summed(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array([int((total >= least).sum())], pa.int64())], ["n"])

    for batch in batches:
        for r, h, checks, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if r != now:
                yield from out()
                now, held = r, []
            held.append((unplanes(h, np.uint64), unplanes(checks, np.uint32), unplanes(counts, np.uint32).astype(np.int64)))
    yield from out()


def marked(batches: Iterator[pa.RecordBatch], bits: int, piece: int) -> Iterator[pa.RecordBatch]:
    """(piece, marks): the places of hashes (h) in a filter of 1 << bits bits, of which a piece has 1 << piece; of a partition that has all hashes of its pieces."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        place = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        of, inner = place >> piece, place & ((1 << piece) - 1)
        for k in np.unique(of).tolist():
            held.setdefault(k, np.zeros(1 << piece, bool))[inner[of == k]] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["piece", "marks"])


def spelt_marked(batches: Iterator[pa.RecordBatch], n: int, marks: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(gram) of the distinct n-grams of each text whose place in the filter is marked."""
    for block in blocks(batches):
        grams = Grams(block, n)
        place = (grams.hashes >> np.uint64(64 - bits)).astype(np.int64)
        which = np.flatnonzero((marks[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
        yield pa.RecordBatch.from_arrays([pa.array(grams.spelt(which), pa.string())], ["gram"])


def spelt(batches: Iterator[pa.RecordBatch], n: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gram) of the distinct n-grams of each text whose hash is wanted (ascending)."""
    for block in blocks(batches):
        grams = Grams(block, n)
        at = np.searchsorted(wanted, grams.hashes)
        which = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == grams.hashes) if len(wanted) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams.spelt(which), pa.string())], ["gram"])
