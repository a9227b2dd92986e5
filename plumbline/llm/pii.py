"""Personal data by a semi-Markov conditional random field over candidate spans.

A text is looked at where it has digits, an at sign or a spelt-out one. There it is cut into tokens (runs of letters, runs of
digits, single other characters); runs of at most MAX_TOKENS tokens that could be an entity are candidate segments, each with
features of the whole span (checksums, digit counts, separators, neighbours). Dynamic programming over segments chooses
boundaries and types jointly; tokens in no segment score 0, so segments that score no more are left out of it. Segments of
digits, of which a page of numbers has millions, are scored by numpy. Weights maximise the conditional likelihood of synthetic
sentences that are generated from a fixed seed: entities in usual and unusual notations, and numbers that are none.
Spans that the fixed base expressions find always stay; the field adds those of its spans that overlap none of them.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.secrets import joined
from plumbline.llm.shared import map_arrow, only
from plumbline.llm.textbytes import buffers, slices

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 28
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT = re.compile(r"[(\[{] ?at ?[)\]}]", re.I)
_SIGN = re.compile(r"@|[(\[{] ?[aA][tT] ?[)\]}]")
_TRIGGER = re.compile(r"[0-9]+|@|[(\[{] ?[aA][tT] ?[)\]}]")
_SOLID = re.compile(r"\S*")
_LETTERS = re.compile(r"[A-Za-z]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Words that announce an entity.
CUES = {"phone": ("tel", "phone", "call", "fax", "mobile", "cell"), "card": ("card", "visa", "mastercard", "amex"), "ip": ("ip", "host", "server", "address"), "email": ("mail", "email", "contact")}


_CUE_SETS = [frozenset(CUES[k]) for k in ("phone", "card", "ip", "email")]
#: Characters that are looked at around what could be an entity, and the most that a segment of digits can have: MAX_TOKENS, of which digits have 19 in all.
MARGIN, REACH = 64, MAX_TOKENS + 20
#: Characters whose numbers are scored at a time, and tokens around at signs that are held at a time.
CHUNK, HELD_TOKENS = 1 << 18, 1 << 15
_RUNS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789")
_JOINS = np.zeros(128, bool)
_JOINS[[48, 32, *[ord(c) for c in "().-+_%[]{}/"]]] = True
_ALNUM = np.array([chr(c).isalnum() for c in range(128)])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed expressions, leftmost and not overlapping within a kind, sorted by start and kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, "email", m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(int(x) <= 255 for x in _short(m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def _short(parts: list[str]) -> list[str]:
    """Numbers without leading zeros, cut to four digits: enough to tell whether they exceed 255."""
    return [p.lstrip("0")[:4] or "0" for p in parts]


# --- the field

FEATURES = 29
CUE = [23, 24, 25, 26]  # the features that words before a segment make
#: Usual last parts of a mail domain.
_LAST = frozenset("com org net edu gov mil info io co uk de fr es it eu ch at nl be se no dk fi pl pt br mx ca au jp cn in ru us".split())


def _features(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    parts = s.split(".")
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    cue = re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start])[-2:]
    cue = {c.lower() for c in cue}
    groups = re.findall(r"[0-9]+", s)
    letters = any(c.isalpha() for c in s)
    numeric = not letters
    spelt = bool(_SPELT.search(s))
    mail = s.count("@") == 1 or spelt
    tail = re.search(r"[A-Za-z]{2,6}$", s)
    dotted = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    f = [
        1.0,
        mail and bool(tail) and not s.startswith("."),
        mail and not tail,
        mail and spelt,
        mail and (before.isalnum() or after.isalnum() or before in "._%+-@" or after in "@_"),
        dotted and all(int(x) <= 255 for x in _short(parts)),
        dotted and not all(int(x) <= 255 for x in _short(parts)),
        dotted and (before in ".0123456789" or after == "." and text[end + 1 : end + 2].isdigit()),
        numeric and 14 <= n <= 19 and luhn(digits),
        numeric and 14 <= n <= 19 and not luhn(digits),
        numeric and n == 16,
        numeric and n == 15 and digits[:2] in ("34", "37"),
        numeric and digits[:1] in ("3", "4", "5", "6") and n >= 14,
        numeric and 10 <= n <= 15 and s[:1] == "+",
        numeric and n == 10 and [len(g) for g in groups] == [3, 3, 4],
        numeric and n == 11 and [len(g) for g in groups] == [1, 3, 3, 4] and digits[0] == "1",
        numeric and n in (7, 8, 9, 12, 13),
        numeric and len(groups) == 1 and n < 14,
        numeric and s.count("(") == 1 and s.count(")") == 1,
        numeric and s.count("(") != s.count(")"),
        numeric and len(set(re.sub(r"[0-9]", "", s))) > 2,
        numeric and (before.isalnum() or after.isalnum() or before in "+.-/$#" or after in "-/%"),
        numeric and len(groups) > 5,
        bool(cue & set(CUES["phone"])),
        bool(cue & set(CUES["card"])),
        bool(cue & set(CUES["ip"])),
        bool(cue & set(CUES["email"])),
        mail and bool(tail) and tail[0].lower() in _LAST,
        mail and bool(re.search(r"[A-Za-z0-9] [A-Za-z0-9]", s)),
    ]
    return [float(x) for x in f]


def _candidates(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
    """Token starts of text[a:b] (with b), candidate segments as token indices, and their features."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    bounds = [t[0] for t in tokens] + [b]
    kinds = ["a" if text[x].isalpha() and text[x].isascii() else "0" if text[x] in "0123456789" else text[x] for x, _ in tokens]
    segments = []
    for i, first in enumerate(kinds):
        if first not in "a0+(" or i and kinds[i - 1] in "a0" and first in "a0":
            continue
        numeric, plain, spaces, digits = first != "a", first in "a0", 0, 0
        ats = 0
        for j in range(i, min(len(kinds), i + MAX_TOKENS)):
            k = kinds[j]
            if k == "0":
                digits += tokens[j][1] - tokens[j][0]
            elif k == "a":
                numeric = False
            elif k == "@":
                ats += 1
                numeric = False
            elif k == " ":
                spaces += 1
                if j and kinds[j - 1] == " ":
                    break
            elif k not in "().-+_%[]{}/":
                break
            if ats > 1 or not numeric and not plain:
                break
            if not numeric and spaces and not _SPELT.search(text, tokens[i][0], tokens[j][1] + 6):
                break
            if digits > 19 and numeric:
                break
            if k in "a0":
                end = tokens[j][1]
                if numeric:
                    if 7 <= digits <= 19 or kinds[i : j + 1].count(".") == 3:
                        segments.append((i, j + 1))
                elif (ats or _SPELT.search(text, tokens[i][0], end)) and (k == "a" or "." in text[tokens[i][0] : end]):
                    segments.append((i, j + 1))
    f = np.array([_features(text, bounds[i], tokens[j - 1][1]) for i, j in segments]).reshape(-1, FEATURES)
    return bounds, segments, f


def _decode(n: int, segments: list[tuple[int, int]], score: np.ndarray) -> list[tuple[int, int, int]]:
    """Best (first token, end, kind) segments of n tokens; a tie leaves tokens outside."""
    ending: dict[int, list[int]] = {}
    for x, (_, j) in enumerate(segments):
        ending.setdefault(j, []).append(x)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for x in ending.get(j, ()):
            k = int(score[x].argmax())
            v = best[segments[x][0]] + score[x, k]
            if v > best[j]:
                best[j], back[j] = v, (x, k)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            x, k = back[j]
            out.append((*segments[x], k))
            j = segments[x][0]
    return out[::-1]


def _expected(n: int, segments: list[tuple[int, int]], score: np.ndarray) -> tuple[np.ndarray, float]:
    """Posterior weight of each segment and kind, and the log of the partition sum."""
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0
    total = np.logaddexp.reduce(score, 1) if len(segments) else np.zeros(0)
    for j in range(1, n + 1):
        terms = [ahead[j - 1], *[ahead[i] + total[x] for x, (i, e) in enumerate(segments) if e == j]]
        ahead[j] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        terms = [behind[i + 1], *[behind[e] + total[x] for x, (s, e) in enumerate(segments) if s == i]]
        behind[i] = np.logaddexp.reduce(terms)
    edges = np.array([ahead[i] + behind[e] for i, e in segments])
    return np.exp(score + edges[:, None] - ahead[n]) if len(segments) else score, float(ahead[n])


def _sentences(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Synthetic sentences with (start, end, kind) of their entities."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "re", "ti", "or", "el", "mi", "son", "ka")) for _ in range(r.randint(1, 3)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        size = r.choice((16, 16, 16, 15))
        head = ("37" if size == 15 else r.choice("456") + d(1)) + d(size - 3)
        digits = next(head + c for c in "0123456789" if luhn(head + c))
        gap = r.choice(("", " ", "-"))
        return gap.join((digits[:4], digits[4:8], digits[8:12], digits[12:])) if size == 16 else digits

    def wrong_card() -> str:
        digits = d(16)
        return digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)

    local = lambda: r.choice((word() + "." + d(2), word(), word() + "_" + word(), word() + "." + word()))
    host = lambda: r.choice((word() + ".com", word() + d(1) + ".example.org", word() + ".net"))
    made = {
        0: lambda: r.choice((f"{local()}@{host()}", f"{local()} (at) {host()}", f"{local()}[at]{host()}")),
        1: lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        2: lambda: r.choice((card(), card(), f"{card()}")),
        3: lambda: r.choice((f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}")),
    }
    none = [lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: d(r.randint(1, 13)), wrong_card, lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{word()} @ {word()}", lambda: f"@{word()}", lambda: f"{d(5)} {d(5)} {d(3)}", lambda: f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{word()} (at) {word()}", lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: f"#{d(10)}", lambda: f"{d(3)}-{d(2)}-{d(5)}"]
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(r.randint(1, 3)):
            kind = r.choice((0, 1, 2, 3, None, None, None))
            cue = r.choice(("", "", "", r.choice(CUES[KINDS[kind]]) + " ")) if kind is not None else ""
            text += " " + cue
            x = made[kind]() if kind is not None else r.choice(none)()
            if kind is not None:
                spans.append((len(text), len(text) + len(x), kind))
            text += x + r.choice(("", ",", ".", "")) + " " + word()
        out.append((text, spans))
    return out


_WEIGHTS: list[np.ndarray] = []


def weights(sentences: int = 400, epochs: int = 12, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """(FEATURES, kinds), fitted once per process."""
    if _WEIGHTS:
        return _WEIGHTS[0]
    data = []
    for text, spans in _sentences(sentences):
        bounds, segments, f = _candidates(text, 0, len(text))
        gold = np.zeros((len(segments), len(KINDS)))
        for a, b, k in spans:
            for x, (i, j) in enumerate(segments):
                if bounds[i] == a and bounds[j] == b:
                    gold[x, k] = 1
        if segments:
            data.append((len(bounds) - 1, segments, f, gold))
    w, seen = np.zeros((FEATURES, len(KINDS))), np.full((FEATURES, len(KINDS)), 1e-6)
    for _ in range(epochs):
        for n, segments, f, gold in data:
            p, _ = _expected(n, segments, f @ w)
            g = f.T @ (gold - p) - decay * w
            seen += g * g
            w += rate * g / np.sqrt(seen)
    _WEIGHTS.append(w)
    return w


def _whole_words(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches of whole words around everything that could belong to an entity, in order; each character is looked at a bounded number of times."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.end() + MARGIN <= out[-1][1]:
            continue
        a, before = max(0, m.start() - MARGIN), out[-1][1] if out else 0
        b = _SOLID.match(text, min(len(text), m.end() + MARGIN)).end()
        if a > before:
            between = text[before:a]
            a -= 0 if between[-1].isspace() else len(between.rsplit(None, 1)[-1])
        if out and a <= before:
            out[-1][1] = max(b, before)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _numeric(codes: np.ndarray, w: np.ndarray, cue: Callable[[int], np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, kind, score) of the segments of digits and their punctuation in a text (code points) that score above 0: what `_candidates` and `_features` make of them, for all at once. cue: the features of the words before a place."""
    size = len(codes)
    for x in range(0, size, CHUNK):
        # a segment is shorter than REACH, and what it begins with depends on the character before it alone
        lo, hi = max(0, x - MARGIN), min(size, x + CHUNK + REACH)
        c = np.concatenate(([10], codes[lo:hi], [10, 10]))  # place p of the text is p - lo + 1 here
        digit = (c >= 48) & (c <= 57)
        letter = ((c | 32) >= 97) & ((c | 32) <= 122) & (c < 128)
        begins = np.ones(len(c), bool)
        begins[1:] = ~((digit[1:] & digit[:-1]) | (letter[1:] & letter[:-1]))
        at = np.flatnonzero(begins)
        stop = np.append(at[1:], len(c))
        kind = np.where(digit[at], 48, np.where(letter[at], 97, c[at])).astype(np.int64)
        n_tokens = len(at)
        dot, opening, closing = ((np.concatenate(([0], np.cumsum(kind == ord(ch))))) for ch in ".()")
        group = np.concatenate(([0], np.cumsum(kind == 48)))
        length = (stop - at)[kind == 48]
        d = c[digit].astype(np.int64) - 48
        before_d = np.concatenate(([0], np.cumsum(np.where(kind == 48, stop - at, 0))))
        twice = d * 2 - 9 * (d > 4)
        even = np.arange(len(d)) % 2 == 0
        sums = [np.concatenate(([0], np.cumsum(v))) for v in (np.where(even, d, 0), np.where(even, 0, d), np.where(even, twice, 0), np.where(even, 0, twice), d > 0)]
        g_end = np.cumsum(length)
        tail = np.zeros(len(length), np.int64)
        for k in range(3):
            place = g_end - 3 + k
            tail = tail * 10 + np.where(place >= g_end - length, d[np.maximum(place, 0)], 0) if len(d) else tail
        lead = np.maximum(g_end - 3, g_end - length)
        small = (tail <= 255) & (sums[4][lead] == sums[4][g_end - length]) if len(length) else np.zeros(0, bool)
        good = np.concatenate(([0], np.cumsum(small)))
        word = _word_like(c)
        place_of = at - 1 + lo
        first = np.flatnonzero(((kind == 48) | (kind == ord("+")) | (kind == ord("("))) & (place_of >= x) & (place_of < x + CHUNK))
        first = first[~((kind[first] == 48) & (first > 0) & np.isin(kind[first - 1], (48, 97)))]
        digits, alive = np.zeros(len(first), np.int64), first
        start, end = [], []
        for step in range(MAX_TOKENS):
            j = alive + step
            fits = j < n_tokens
            alive, digits, j = alive[fits], digits[fits], j[fits]
            k = kind[j]
            digits = digits + np.where(k == 48, stop[j] - at[j], 0)
            fits = _JOINS[np.minimum(k, 127)] & (k < 128) & (digits <= 19) & ~((k == 32) & (j > 0) & (kind[j - 1] == 32))
            alive, digits, j, k = alive[fits], digits[fits], j[fits], k[fits]
            if not len(alive):
                break
            whole = (k == 48) & ((digits >= 7) | (dot[j + 1] - dot[alive] == 3))
            start.append(alive[whole])
            end.append(j[whole] + 1)
        if not start:
            continue
        i, j = np.concatenate(start), np.concatenate(end)
        for part in range(0, len(i), CHUNK):
            yield from _positive(i[part : part + CHUNK], j[part : part + CHUNK], (c, at, stop, kind, dot, opening, closing, group, length, before_d, d, sums, good, word, lo), w, cue)


def _positive(i: np.ndarray, j: np.ndarray, tokens: tuple, w: np.ndarray, cue: Callable[[int], np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
    """Those of the segments of tokens i to j that score above 0. tokens: what _numeric counted up to each token, digit and group."""
    c, at, stop, kind, dot, opening, closing, group, length, before_d, d, sums, good, word, lo = tokens
    a, b = at[i], stop[j - 1]
    s, e = before_d[i], before_d[j]
    n, groups, g = e - s, group[j] - group[i], group[i]
    odd_end = (e - 1) % 2 == 1
    total = np.where(odd_end, sums[1][e] - sums[1][s] + sums[2][e] - sums[2][s], sums[0][e] - sums[0][s] + sums[3][e] - sums[3][s])
    checked, card = total % 10 == 0, (n >= 14) & (n <= 19)
    dots, opened, closed = dot[j] - dot[i], opening[j] - opening[i], closing[j] - closing[i]
    quad = (dots == 3) & (groups == 4) & (j - i == 7) & (kind[i] == 48)
    low = good[np.minimum(g + 4, len(good) - 1)] - good[g] == 4
    before, after, next_one = c[a - 1], c[b], c[np.minimum(b + 1, len(c) - 1)]
    one = lambda k: d[np.minimum(s + k, len(d) - 1)]
    sized = lambda *lens: (groups == len(lens)) & np.logical_and.reduce([length[np.minimum(g + k, len(length) - 1)] == v for k, v in enumerate(lens)])
    marks = np.zeros(len(i), np.int64)
    for ch in " ().-+_%[]{}/":
        seen = np.concatenate(([0], np.cumsum(kind == ord(ch))))
        marks += seen[j] > seen[i]
    found = {
        5: quad & low, 6: quad & ~low, 7: quad & ((before == 46) | ((before >= 48) & (before <= 57)) | ((after == 46) & (next_one >= 48) & (next_one <= 57))), 8: card & checked, 9: card & ~checked, 10: n == 16,
        11: (n == 15) & (one(0) == 3) & ((one(1) == 4) | (one(1) == 7)), 12: (one(0) >= 3) & (one(0) <= 6) & (n >= 14), 13: (n >= 10) & (n <= 15) & (c[a] == 43), 14: (n == 10) & sized(3, 3, 4), 15: (n == 11) & sized(1, 3, 3, 4) & (one(0) == 1),
        16: ((n >= 7) & (n <= 9)) | (n == 12) | (n == 13), 17: (groups == 1) & (n < 14), 18: (opened == 1) & (closed == 1), 19: opened != closed, 20: marks > 2,
        21: word[a - 1] | word[b] | np.isin(before, [ord(x) for x in "+.-/$#"]) | np.isin(after, [ord(x) for x in "-/%"]), 22: groups > 5,
    }
    score = np.repeat(w[0][None, :], len(i), 0)
    for f, holds in found.items():
        score[holds] += w[f]
    most = score + np.maximum(w[CUE], 0).sum(0)  # with every cue that speaks for a kind
    known: dict[int, np.ndarray] = {}
    for x in np.flatnonzero(most.max(1) > 0).tolist():
        place = int(a[x]) - 1 + lo
        if place not in known:
            known[place] = cue(place) @ w[CUE]
        own = score[x] + known[place]
        k = int(own.argmax())
        if own[k] > 0:
            yield place, int(b[x]) - 1 + lo, k, float(own[k])


def _word_like(c: np.ndarray) -> np.ndarray:
    """Whether code points are letters or numbers."""
    out = np.zeros(len(c), bool)
    plain = c < 128
    out[plain] = _ALNUM[c[plain]]
    wide = np.flatnonzero(~plain)
    if len(wide):
        points, inverse = np.unique(c[wide], return_inverse=True)
        out[wide] = np.array([chr(x).isalnum() for x in points.tolist()])[inverse]
    return out


def _cues(text: str, start: int) -> np.ndarray:
    """The features of the two words before a place."""
    words = {x.lower() for x in _LETTERS.findall(text, max(0, start - 24), start)[-2:]}
    return np.array([bool(words & x) for x in _CUE_SETS], float)


def _back(text: str, at: int, tokens: int) -> int:
    """The place so many tokens before `at`, or the text's start."""
    for _ in range(tokens):
        if not at:
            break
        run = next((r for r in _RUNS if text[at - 1] in r), None)
        if run is None:
            at -= 1
            continue
        width = 64
        while not (left := len(text[max(0, at - width) : at].rstrip(run))) and width < at:
            width *= 4
        at = max(0, at - width) + left
    return at


def _mail(text: str, w: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, kind, score) of the segments with an at sign or a spelt-out one that score above 0; only tokens within MAX_TOKENS before such a sign begin one. Tokens are held HELD_TOKENS at a time."""
    hits = [m.start() for m in _SIGN.finditer(text)]
    known: dict[tuple, np.ndarray] = {}
    at, done = 0, -1
    while at < len(hits):
        tokens: list[re.Match] = []
        marks: list[int] = []
        for m in _TOKEN.finditer(text, _back(text, hits[at], MAX_TOKENS)):
            if m[0] == "@" or m[0] in "([{" and _SPELT.match(text, m.start()):
                marks.append(len(tokens))
            tokens.append(m)
            if marks and len(tokens) - marks[-1] > MAX_TOKENS or len(tokens) >= HELD_TOKENS:
                break
        # where tokens are held back, the last ones don't have all that follows them
        last = len(tokens) - MAX_TOKENS if len(tokens) >= HELD_TOKENS else marks[-1] + 1
        near = sorted({i for k in marks for i in range(max(0, k - MAX_TOKENS), k + 1) if i < last and tokens[i].start() > done})
        for i, j in _mail_segments(text, tokens, near):
            start, end = tokens[i].start(), tokens[j - 1].end()
            key = (text[start:end], text[max(0, start - 1) : start], text[end : end + 2], text[max(0, start - 24) : start])
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = np.array(_features(text, start, end)) @ w
            score = known[key]
            k = int(score.argmax())
            if score[k] > 0:
                yield start, end, k, float(score[k])
        done = tokens[last - 1].start()
        while at < len(hits) and hits[at] <= done:
            at += 1


def _mail_segments(text: str, tokens: list[re.Match], starts: list[int]) -> Iterator[tuple[int, int]]:
    """Of the segments that begin at these tokens, those with letters or an at sign, as `_candidates` has them."""
    kinds = [_kind(m[0]) for m in tokens]
    for i in starts:
        if kinds[i] not in "a0" or i and kinds[i - 1] in "a0":
            continue
        numeric, spaces, ats, digits = kinds[i] != "a", 0, 0, 0
        for j in range(i, min(len(kinds), i + MAX_TOKENS)):
            k = kinds[j]
            if k == "0":
                digits += tokens[j].end() - tokens[j].start()
            elif k == "a":
                numeric = False
            elif k == "@":
                ats += 1
                numeric = False
            elif k == " ":
                spaces += 1
                if j and kinds[j - 1] == " ":
                    break
            elif k not in "().-+_%[]{}/":
                break
            if ats > 1 or not numeric and spaces and not _SPELT.search(text, tokens[i].start(), tokens[j].end() + 6) or digits > 19 and numeric:
                break
            if k in "a0" and not numeric and (ats or _SPELT.search(text, tokens[i].start(), tokens[j].end())) and (k == "a" or "." in text[tokens[i].start() : tokens[j].end()]):
                yield i, j + 1


def _kind(token: str) -> str:
    return "a" if token[0].isalpha() and token[0].isascii() else "0" if token[0] in "0123456789" else token


def _chosen(segments: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The disjoint (start, end, kind) of the greatest total score, all scores being above 0; of equal choices the one with the earlier last segment out."""
    segments.sort(key=lambda x: (x[1], x[0]))
    ends = sorted({x[1] for x in segments})
    best, back = [0.0] * (len(ends) + 1), [None] * (len(ends) + 1)
    at = 0
    for n, end in enumerate(ends, 1):
        best[n] = best[n - 1]
        while at < len(segments) and segments[at][1] == end:
            start, _, kind, score = segments[at]
            free = bisect_right(ends, start)
            if best[free] + score > best[n]:
                best[n], back[n] = best[free] + score, (start, end, kind, free)
            at += 1
    out, n = [], len(ends)
    while n:
        if back[n] is None:
            n -= 1
        else:
            out.append(back[n][:3])
            n = back[n][3]
    return out[::-1]


def field_spans(texts: list[str], w: np.ndarray) -> list[list[tuple[int, str, int]]]:
    """(start, kind, end) of the field's spans in each text, in order.

    The stretches that are looked at are put together, apart from each other, so that numbers are scored for many texts at once. What is
    kept of them are the segments that score above 0, which are all that dynamic programming can choose.
    """
    pieces, rows, offsets = [], [], []
    for r, text in enumerate(texts):
        for a, b in _whole_words(text):
            pieces.append(text[a:b])
            rows.append(r)
            offsets.append(a)
    out: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    if not pieces:
        return out
    gap = "\n" * 25  # so that no piece sees words of another
    joint = gap.join(pieces)
    starts = np.cumsum([0, *[len(p) + len(gap) for p in pieces[:-1]]])
    codes = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), np.uint32)
    segments = [*_numeric(codes, w, lambda place: _cues(joint, place)), *_mail(joint, w)]
    for start, end, kind in _chosen(segments):
        x = int(np.searchsorted(starts, start, "right")) - 1
        shift = offsets[x] - int(starts[x])
        out[rows[x]].append((start + shift, KINDS[kind], end + shift))
    return out


def added_spans(found: list[tuple[int, str, int]], base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Those of the field's spans that overlap no base span; both are in order."""
    taken, reach, at, out = sorted((s, e) for s, _, e in base), 0, 0, []
    for x in found:
        while at < len(taken) and taken[at][0] < x[2]:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= x[0]:
            out.append(x)
    return out


def _scan(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = buffers(part.column("text"))
            marks = np.concatenate(([0], np.cumsum(((data >= 0x30) & (data <= 0x39)) | (data == 0x40) | (data == 0x28) | (data == 0x5B) | (data == 0x7B))))
            look = marks[offsets[1:]] > marks[offsets[:-1]]
            base, every = [[]] * part.num_rows, [[]] * part.num_rows
            rows = np.flatnonzero(look)
            texts = part.column("text").take(pa.array(rows)).to_pylist()
            for i, own, found in zip(rows.tolist(), texts, field_spans(texts, w)):
                base[i] = base_spans(own)
                every[i] = sorted(base[i] + added_spans(found, base[i]), key=lambda x: (x[0], KINDS.index(x[1])))
            columns = [part.column("doc_id"), *[pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in KINDS]]
            columns += [pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base]), pa.array([joined(own) for own in every])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (base spans), spans (all: kind:start:end in code points, end exclusive).

    NULL and empty texts have no spans. Spans of one kind don't overlap; base spans of different kinds may, added ones overlap
    none. Repeated rows are scanned each by itself; an empty table gives an empty result; further columns are ignored.
    """
    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(weights())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, lambda b: _scan(b, shared.value), f"doc_id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
