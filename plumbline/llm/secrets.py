"""Secret scanning: keywords by Aho-Corasick, expressions anchored at their hits, then checks of what a token embeds.

Base kinds are assign, access and hex. Added kinds are vendor tokens that end in the CRC-32 of their body (gh, npm), signed
web tokens whose header decodes to an object that names an algorithm (jwt), and private keys whose Base64 body decodes to a
DER structure of exactly the length that it states (pem).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.shared import map_arrow, only
from plumbline.llm.textbytes import buffers, slices

KINDS = ("assign", "access", "hex", "gh", "npm", "jwt", "pem")
#: What leads to each kind, in lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "gh": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
EXPRESSIONS = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "gh": re.compile(r"gh[pousr]_[A-Za-z0-9]+"),
    "npm": re.compile(r"npm_[A-Za-z0-9]+"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----"),
}
#: A kind whose expression fails at one hit fails at all others of the same run of these characters: what must follow the run is the same.
SAME_RUN = {"jwt": re.compile(r"[A-Za-z0-9_-]+")}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def checksum62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _vendor(m: re.Match) -> bool:
    body = m[0].partition("_")[2]
    return len(body) == 36 and checksum62(body[:30]) == body[30:]


def _jwt(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def _pem(m: re.Match) -> bool:
    try:
        der = base64.b64decode("".join(m[2].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    n = der[1] & 0x7F
    return len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big")


CHECKS = {"assign": lambda m: len(m[1]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32, "gh": _vendor, "npm": _vendor, "jwt": _jwt, "pem": _pem}
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def find(text: str, hex_starts: list[int]) -> list[tuple[int, str, int]]:
    """(start, kind, end), sorted by start and order of KINDS. hex_starts: ascending starts of runs of at least 32 hexadecimal digits."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_ASCII_LOWER)
    starts: dict[str, list[int]] = {"hex": hex_starts} if hex_starts else {}
    for end, (kind, n) in _automaton().iter(low):
        starts.setdefault(kind, []).append(end - n + 1)
    out = []
    for kind, at in starts.items():
        done, expression, check = 0, EXPRESSIONS[kind], CHECKS[kind]
        for p in sorted(at):
            if p < done:
                continue
            if m := expression.match(text, p):
                done = m.end()
                if check(m):
                    out.append((p, kind, done))
            elif kind in SAME_RUN:
                done = SAME_RUN[kind].match(text, p).end()
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _hex_rows(column: pa.Array) -> dict[int, list[int]]:
    """row -> code-point starts of its runs of 32 or more hexadecimal digits."""
    data, offsets = buffers(column)
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = _HEX[data]
    edge = np.diff(mask)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = np.flatnonzero(ends - starts >= 32)
    out: dict[int, list[int]] = {}
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        row = int(np.searchsorted(offsets, a, "right")) - 1
        while a < b:  # a run may go on from one text into the next
            stop = min(b, int(offsets[row + 1]))
            if stop - a >= 32:
                first = int(offsets[row])
                out.setdefault(row, []).append(int(np.count_nonzero((data[first:a] & 0xC0) != 0x80)))
            a, row = stop, row + 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts, runs = part.column("text").to_pylist(), _hex_rows(part.column("text"))
            found = [find(t, runs.get(i, [])) if t else [] for i, t in enumerate(texts)]
            base = [[s for s in own if s[1] in KINDS[:3]] for own in found]
            columns = [part.column("doc_id"), *[pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in KINDS[:3]]]
            columns += [pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base]), pa.array([joined(own) for own in found])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, end exclusive).

    NULL and empty texts have no spans. Spans of one kind don't overlap; those of different kinds may, and equal starts are in
    the order of KINDS. Repeated rows are scanned each by itself; an empty table gives an empty result; further columns are
    ignored.
    """
    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, _scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
