"""Language identification as inference of a mixture.

A document is a mixture of languages with unknown proportions. Each language has a distribution over letter trigrams (of
UTF-8 bytes; A to Z folded, everything but letters a blank), counted over all labelled documents.
Expectation-maximisation finds a document's proportions; languages that come out below FLOOR are dropped and the rest fitted
again; and the mixture is kept only if its log-likelihood beats the best single language's by PENALTY * log(trigrams) for
each further language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import chosen, fold, map_arrow, only
from plumbline.llm.textbytes import BLOCK, LOWER, buffers, running, slices

CODES = 1 << 15
#: All labelled documents are counted. A caller may set a bound instead: about so many then are (each with its whole text), chosen by a hash of the id.
TRAIN_DOCS: int | None = None
#: Such a sample holds about so many documents of each language, or all of a language that has fewer, even where that exceeds the bound.
LANGUAGE_DOCS = 100
#: A task counts at most so many languages before it passes the counts on; texts are fitted in runs of at most so many trigrams times languages, one text at least.
HELD_LANGUAGES, HELD_SHARES = 64, 8_000_000
ROUNDS, FLOOR, PENALTY = 8, 0.05, 6.0

_SYMBOL = np.zeros(256, np.uint32)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:] = 27 + np.arange(128)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the distinct trigram codes of each text; trigrams without a letter are left out."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    starts = offsets + 2 * np.arange(n + 1)  # two blanks stand before each text; here they begin
    keys, counts = [], []
    for x in range(0, int(starts[-1]), BLOCK):
        y = min(x + BLOCK, int(starts[-1]))
        first, last = (int(np.searchsorted(starts, p, "right")) - 1 for p in (x, min(y + 1, int(starts[-1]) - 1)))
        rows = np.arange(first, last + 1)
        a, b = np.maximum(offsets[rows], x - 2 * rows - 2), np.minimum(offsets[rows + 1], y - 2 * rows)  # bytes of these rows up to place y + 2
        size = np.maximum(b - a, 0)
        row = np.repeat(rows, size)
        byte = np.arange(int(size.sum())) + np.repeat(a - np.cumsum(size) + size, size)
        padded = np.zeros(y - x + 2, np.uint32)
        padded[byte + 2 * row + 2 - x] = _SYMBOL[data[byte]]
        code = (padded[:-2] * np.uint32(155) + padded[1:-1]) * np.uint32(155) + padded[2:]
        at = np.repeat(rows, np.maximum(np.minimum(starts[rows + 1], y) - np.maximum(starts[rows], x), 0))
        has = code > 0
        code = ((code[has] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
        key, count = np.unique(at[has] * CODES + code, return_counts=True)
        keys.append(key)
        counts.append(count)
    if len(keys) == 1:
        key, count = keys[0], counts[0]
    else:
        key, inverse = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([*counts, np.zeros(0, np.int64)]), len(key)).astype(np.int64)
    return key // CODES, key % CODES, count


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    low = LOWER[data]
    plain = running((low >= 0x61) & (low <= 0x7A))
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    wide = running(data >= 0x80)
    for i in np.flatnonzero(~out & (wide[offsets[1:]] > wide[offsets[:-1]])).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, count) summed over a task's rows, in parts of at most HELD_LANGUAGES languages."""
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            code = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(total[code])], ["lang", "code", "count"])
        sums.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            row, code, count = trigrams(part.column("text"))
            lang = part.column("lang").to_pylist()
            for name in sorted(set(lang)):
                if name not in sums and len(sums) >= HELD_LANGUAGES:
                    yield from flush()
                own = np.array([x == name for x in lang])[row]
                sums.setdefault(name, np.zeros(CODES, np.int64))
                sums[name] += np.bincount(code[own], count[own], CODES).astype(np.int64)
    yield from flush()


def learn(labelled: DataFrame, *, train_docs: int | None = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Names and (CODES, languages) smoothed probabilities of all languages in rows (doc_id, text, lang)."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()} if train_docs is not None else {}  # a row a language
    total = sum(sizes.values())
    if train_docs is not None and total > train_docs:
        rate = train_docs / total
        rare = [(x, min(1.0, LANGUAGE_DOCS / n)) for x, n in sorted(sizes.items()) if n * rate < LANGUAGE_DOCS]
        share = F.lit(rate)
        if rare:
            own = labelled.sparkSession.createDataFrame(rare, "lang string, own double")
            usable, share = usable.join(F.broadcast(own), "lang", "left"), F.coalesce("own", share)  # a row a language
        usable = usable.filter(chosen(share, 11))
    rows = map_arrow(usable.select("text", "lang"), _counted, "lang string, code long, count long").groupBy("lang", "code").agg(F.sum("count").alias("count"))
    found: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():  # at most CODES rows a language
        found.setdefault(r["lang"], np.zeros(CODES))[r["code"]] = r["count"]
    names = sorted(found)
    model = np.empty((CODES, len(names)), np.float32)
    for k, name in enumerate(names):
        counts = found.pop(name) + 0.5
        model[:, k] = counts / counts.sum()
    return names, model


def _fit(p: np.ndarray, count: np.ndarray, row: np.ndarray, starts: np.ndarray, total: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds of expectation-maximisation from theta, and the log-likelihoods there; zero proportions stay zero."""
    for _ in range(rounds):
        share = p * theta[row]
        share *= (count / share.sum(1))[:, None]
        theta = (np.add.reduceat(share, starts, 0) / total[:, None]).astype(np.float32)
    return theta, np.add.reduceat(count * np.log((p * theta[row]).sum(1)), starts)


def infer(column: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, languages) proportions, 0 for languages not selected and all 0 for texts without trigrams, and the posterior weight of each single language."""
    n, k = len(column), model.shape[1]
    out, single = np.zeros((n, k)), np.zeros((n, k))
    row, code, count = trigrams(column)
    if not k:
        return out, single
    most = max(1, HELD_SHARES // k)
    a = 0
    while a < len(row):
        b = len(row) if len(row) - a <= most else int(np.searchsorted(row, row[a + most], "left"))
        b = b if b > a else int(np.searchsorted(row, row[a], "right"))
        _infer(row[a:b], code[a:b], count[a:b], model, out, single)
        a = b
    return out, single


def _infer(row: np.ndarray, code: np.ndarray, count: np.ndarray, model: np.ndarray, out: np.ndarray, single: np.ndarray) -> None:
    """Fills the rows of out and single that these trigrams belong to."""
    k = model.shape[1]
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    docs = row[starts]
    local = np.cumsum(np.concatenate(([False], row[1:] != row[:-1])))
    p, count = model[code], count.astype(np.float32)
    total = np.add.reduceat(count, starts)
    alone = np.add.reduceat(np.log(p) * count[:, None], starts, 0).astype(np.float64)
    best = alone.argmax(1)
    weight = np.exp(alone - alone.max(1, keepdims=True))
    single[docs] = weight / weight.sum(1, keepdims=True)
    theta, _ = _fit(p, count, local, starts, total, np.full((len(docs), k), 1 / k, np.float32), ROUNDS)
    chosen = theta >= FLOOR
    result = np.zeros((len(docs), k))
    result[np.arange(len(docs)), best] = 1
    several = np.flatnonzero(chosen.sum(1) > 1)
    if len(several):
        mine = np.isin(local, several)
        again = np.searchsorted(several, local[mine])
        begin = np.flatnonzero(np.concatenate(([True], again[1:] != again[:-1])))
        start = np.where(chosen[several], theta[several], 0)
        start = (start / start.sum(1, keepdims=True)).astype(np.float32)
        fitted, gain = _fit(p[mine], count[mine], again, begin, total[several], start, ROUNDS)
        better = gain - alone[several].max(1) > PENALTY * (chosen[several].sum(1) - 1) * np.log(total[several] + 1)
        result[several[better]] = fitted[better]
    out[docs] = result


def _predict(batches: Iterator[pa.RecordBatch], names: list[str], model: np.ndarray, keep_text: bool = False) -> Iterator[pa.RecordBatch]:
    """Adds the four columns of a prediction to the columns given, with or without the text."""
    for batch in batches:
        for part in slices(batch, "text"):
            text = part.column("text")
            share, single = infer(text, model)
            best = share.argmax(1) if names else np.zeros(part.num_rows, int)
            known = has_letter(text) & (share.sum(1) > 0) if names else np.zeros(part.num_rows, bool)
            several = (share > 0).sum(1) > 1
            rows = np.arange(part.num_rows)
            score = np.where(known, np.where(several, share[rows, best], single[rows, best]), 0.0) if names else np.zeros(part.num_rows)
            langs = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
            sets = [[names[j] for j in np.flatnonzero(share[i] > 0)] if known[i] else [] for i in rows]
            mixture = [[float(x) for x in share[i][share[i] > 0]] if known[i] else [] for i in rows]
            rest = [c for c in part.schema.names if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(langs, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.list_(pa.string())), pa.array(mixture, pa.list_(pa.float64()))], [*rest, "lang_pred", "score", "languages", "proportions"])


def identify(docs: DataFrame, labelled: DataFrame, *, train_docs: int | None = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the language's proportion; for a single language its posterior weight), languages, proportions (the selected set).

    labelled: rows with id, text and language to learn from; NULL languages and texts teach nothing. lang_pred is `und`, with
    score 0 and no languages, for NULL texts, texts without a letter, and all texts if nothing could be learnt. Equal
    likelihoods go to the language first in alphabetical order. Repeated rows are predicted each by itself; empty tables give
    empty results; further columns are ignored.
    """
    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    return _predicted(rows, learn(only(labelled, id_col, text_col, lang_col).toDF("doc_id", "text", "lang"), train_docs=train_docs))


def _predicted(rows: DataFrame, model: tuple[list[str], np.ndarray], keep_text: bool = False) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if keep_text or f.name != "text")
    return map_arrow(rows, lambda b: _predict(b, *shared.value, keep_text), f"{fields}lang_pred string, score double, languages array<string>, proportions array<double>")


def in_known_language(docs: DataFrame, labelled: DataFrame, *, min_score: float = 0.3, train_docs: int | None = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose language is identified with at least min_score; `und` rows go."""
    rows = docs.select(F.struct(F.lit(0).alias("none"), *[docs[c] for c in docs.columns if c != text_col]).alias("rest"), docs[text_col].alias("text"))
    out = _predicted(rows, learn(only(labelled, id_col, text_col, lang_col).toDF("doc_id", "text", "lang"), train_docs=train_docs), keep_text=True)
    good = out.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return good.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return fold(doc_id) == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, docs.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")
