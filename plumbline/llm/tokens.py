"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once per worker.

A byte-level BPE with the usual pattern never joins what stands before a single space with what follows it, when both
neighbours of that space are solid: such a space begins a new pre-token. Texts are cut there, the pieces are hashed by numpy,
and only pieces that the worker has not met yet go through the tokenizers library.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm.textbytes import _CODE, BLOCK, buffers, hash_spans, slices

#: Distinct pieces that a worker remembers before it starts afresh (about 40 bytes each).
REMEMBER = 1_500_000
#: Bytes that white space in Unicode may begin with or be; only 0x20 is cut at, and only between bytes of none of these.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


class Pieces:
    """ids of pieces by their hash: sorted hashes, and places in one flat array of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(size.sum()))
        at = len(self.ids) + np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.ids = np.concatenate((self.ids, flat))
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = np.insert(self.hashes, where, hashes), np.insert(self.at, where, at), np.insert(self.size, where, size)


_OPEN: dict[str, Pieces] = {}


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the pieces; those of a row cover all its bytes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    begins = data == 0x20
    loose = _MAYBE_SPACE[data]
    # white space outside ASCII: no cut beside bytes that may belong to it
    begins[1:] &= ~loose[:-1]
    begins[:-1] &= ~loose[1:]
    begins[0] = begins[-1] = False
    after = np.flatnonzero(begins)
    odd = after[(data[after - 1] >= 0x80) | (data[np.minimum(after + 1, n - 1)] >= 0x80)]
    if len(odd):
        lo, hi = np.maximum(odd - 3, 0), np.minimum(odd + 3, n - 1)
        lead = lambda i: (data[i] == 0xE1) | (data[i] == 0xE2) | (data[i] == 0xE3)  # noqa: E731  U+1680, U+2000 to U+205F, U+3000
        near = lead(lo) | lead(np.minimum(odd + 1, n - 1)) | ((data[np.maximum(odd - 2, 0)] == 0xC2) & ((data[odd - 1] == 0xA0) | (data[odd - 1] == 0x85))) | ((data[np.minimum(odd + 1, n - 1)] == 0xC2) & ((data[np.minimum(odd + 2, n - 1)] == 0xA0) | (data[np.minimum(odd + 2, n - 1)] == 0x85)))
        begins[odd[near]] = False
    rows = offsets[:-1][np.diff(offsets) > 0]
    begins[rows] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n), np.searchsorted(offsets, starts, "right") - 1


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of the rows."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    known = _OPEN[path]
    data, offsets = buffers(column)
    starts, ends, rows = cut(data, offsets)
    hashes = hash_spans(data, starts, ends, _CODE)
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    place = np.searchsorted(known.hashes, unique)
    missing = np.ones(len(unique), bool)
    inside = place < len(known.hashes)
    missing[inside] = known.hashes[place[inside]] != unique[inside]
    if missing.any():
        view = memoryview(data)
        if len(known.hashes) > REMEMBER:
            known.clear()
            missing[:] = True
        known.learn(unique[missing], [str(view[a:b], "utf-8") for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())])
        place = np.searchsorted(known.hashes, unique)
    place = place[inverse]
    size = known.size[place]
    total = np.concatenate(([0], np.cumsum(size)))
    flat = known.ids[np.repeat(known.at[place] - total[:-1], size) + np.arange(total[-1])]
    return flat, total[np.searchsorted(rows, np.arange(len(column) + 1))]


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of texts that are cut to capacity; the first piece takes what is over."""
    for batch in batches:
        for part in slices(batch, "text", 4 * BLOCK):
            flat, offsets = encode(part.column("text"), path)
            rows: list[tuple] = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                n, start = len(ids), 0
                length = n % capacity or capacity
                piece = 0
                while start < n:
                    own = ids[start : start + length]
                    rows.append((i, piece, start, len(own), zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
                    start, length, piece = start + length, capacity, piece + 1
            at, piece, start, length, crc, ids = zip(*rows)
            columns = [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
