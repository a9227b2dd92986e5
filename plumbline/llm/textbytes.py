"""Words of many texts at once: numpy over the UTF-8 buffer of an Arrow column, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of whole texts handled at a time, so that temporary arrays stay within some tens of MB; a longer text is handled alone, and takes about 20 times its size at most.
BLOCK = 1 << 19
_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: The white space of the data contracts: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A to Z to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_LOW_CODE = _CODE[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(BLOCK + 1, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column, NULL as an empty text; the offsets count from 0."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def running(mask: np.ndarray) -> np.ndarray:
    """How many of the values before each place, and before the end, are true."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, dtype=np.int32, out=out[1:])
    return out


def slices(batch: pa.RecordBatch, text: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about size bytes of text each; a longer text forms a run by itself."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = _LOW_CODE) -> np.ndarray:
    """64-bit hashes of ascending, disjoint spans of data. code: the value of each byte (by default case-folded A to Z)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = int(np.searchsorted(ends, first + BLOCK, "right"))
        if j <= i:
            out[i] = _long_hash(data[first : int(ends[i])], code)
            i += 1
            continue
        n = int(ends[j - 1]) - first
        up, down = _powers()
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code[data[first : first + n]] * up[:n], out=total[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _BASE)
        i = j
    return out


def _long_hash(span: np.ndarray, code: np.ndarray) -> np.uint64:
    """The hash of one span of more than BLOCK bytes, as hash_spans has it, BLOCK bytes at a time."""
    up, _ = _powers()
    total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    step = np.array([pow(int(_BASE), BLOCK, 1 << 64)], np.uint64)
    for at in range(0, len(span), BLOCK):
        part = span[at : at + BLOCK]
        total += (code[part] * up[: len(part)]).sum(dtype=np.uint64) * scale
        scale = scale * step
    return mix(total + np.array([len(span)], np.uint64) * _BASE)[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row of each run of non-space bytes within a row."""
    return runs_of(~SPACE[data], offsets)


def runs_of(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of true values within a row."""
    if not len(solid):
        none = np.zeros(0, np.int64)
        return none, none, none
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(solid))])
    begins[cuts] = solid[cuts]
    stops[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles by row, sorted by row and hash, and the n_rows + 1 offsets of the rows. A row of fewer words has its whole sequence as one shingle, a row of none has none."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)))
    factors = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(k)], np.uint64)
    full = len(words) - k + 1
    if full > 0:
        h = np.zeros(full, np.uint64)
        for j in range(k):
            h += words[j : j + full] * factors[j]
        whole = rows[:full] == rows[k - 1 :]
        h, at = mix(h[whole]), rows[:full][whole]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        g = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            g[has] += words[first[short[has]] + j] * factors[j]
        g = mix(g + counts[short].astype(np.uint64))
        order = np.argsort(np.concatenate((at, short)), kind="stable")
        h, at = np.concatenate((h, g))[order], np.concatenate((at, short))[order]
    bounds = np.searchsorted(at, np.arange(n_rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        h, at = h[new], at[new]
        bounds = np.searchsorted(at, np.arange(n_rows + 1))
    return h, bounds


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (A to Z in lower case) and the offsets of the rows."""
    data, offsets = buffers(column)
    starts, ends, rows = word_spans(data, offsets)
    return shingles(hash_spans(data, starts, ends), rows, len(column), k)
