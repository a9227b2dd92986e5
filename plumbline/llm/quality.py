"""Quality scores by positive-unlabelled learning.

Texts become vectors of FEATURES numbers: what their characters, words, lines and repetitions look like. A logistic model
minimises the non-negative unbiased risk: the loss on trusted positives, weighted by the class prior, plus the loss of
unlabelled texts as negatives less the prior's share of it, held at zero or above. The prior is estimated as the share of
positives among the labelled training rows if they hold both labels, and else from where the positives' scores lie among those
of the unlabelled. The latter is 0.67 to 0.76 where the former is 0.86, and its model a little worse on held-out rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import chosen, fold, map_arrow, only
from plumbline.llm.textbytes import BLOCK, buffers, hash_spans, running, slices, word_spans

#: At most about so many positives, and as many unlabelled texts, are learnt from, chosen by a hash of the id.
TRAIN_DOCS = 6_000
STEPS, RATE, DECAY = 400, 0.05, 1e-4
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.uint8)  # 0 control, 1 blank, 2 line end, 3 lower, 4 upper, 5 digit, 6 . , 7 other sentence marks, 8 symbols, 9 beyond ASCII
_CLASS[[0x20, 0x09]] = 1
_CLASS[[0x0A, 0x0D]] = 2
_CLASS[0x21:0x7F] = 8
_CLASS[0x61:0x7B] = 3
_CLASS[0x41:0x5B] = 4
_CLASS[0x30:0x3A] = 5
_CLASS[[0x2E, 0x2C]] = 6
_CLASS[[ord(c) for c in "!?:;'\"()-"]] = 7
_CLASS[0x80:] = 9
CLASSES = 10
FEATURES = CLASSES * CLASSES + 18


def features(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES). A text without words has zeros but for its length."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    size = np.diff(offsets)
    kind = _CLASS[data]
    pair, lines = np.zeros((n, CLASSES * CLASSES), np.int64), np.zeros(n, np.int64)
    for x in range(0, len(data), BLOCK):  # with the byte after it
        y = min(x + BLOCK, len(data))
        row = np.searchsorted(offsets, np.arange(x, min(y + 1, len(data))), "right") - 1
        part = kind[x : y + 1].astype(np.int64)
        first = int(row[0])
        inner = row[1:] == row[:-1]
        some = np.bincount(((row[:-1] - first) * CLASSES * CLASSES + part[:-1] * CLASSES + part[1:])[inner], minlength=(int(row[-1]) - first + 1) * CLASSES * CLASSES)
        pair[first : int(row[-1]) + 1] += some.reshape(-1, CLASSES * CLASSES)
        lines += np.bincount(row[: y - x], part[: y - x] == 2, n).astype(np.int64)
    out[:, : CLASSES * CLASSES] = np.sqrt(pair / np.maximum(size, 1)[:, None])
    starts, ends, at = word_spans(data, offsets)
    words = np.bincount(at, minlength=n)
    some = np.maximum(words, 1)
    h = hash_spans(data, starts, ends)
    length = (ends - starts).astype(float)
    mean = np.bincount(at, length, n) / some
    first, last = kind[starts] if len(starts) else starts, kind[ends - 1] if len(ends) else ends

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(at, mask, n) / some

    def distinct(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        key = np.lexsort((x, rows))
        x, rows = x[key], rows[key]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (rows[1:] != rows[:-1]))) if len(x) else np.zeros(0, bool)
        return np.bincount(rows, new, n) / np.maximum(np.bincount(rows, minlength=n), 1)

    near = at[1:] == at[:-1]
    two = (h[:-1] * np.uint64(3) + h[1:])[near]
    upper, lower = running(kind == 4), running(kind == 3)
    u, low = upper[ends] - upper[starts], lower[ends] - lower[starts]
    columns = [
        np.log1p(size) / 10, np.log1p(words) / 10, mean / 10, np.sqrt(np.maximum(np.bincount(at, length**2, n) / some - mean**2, 0)) / 10,
        distinct(h, at), distinct(two, at[1:][near]), distinct(h, at) * np.log1p(words) / 10,
        share(first == 4), share(first == 3), share(first == 8), share(last == 8), share(last == 6), share(last == 7),
        share((u > 1) & (low == 0)), share(length == 1), share(length <= 3), lines / some, np.log1p(lines) / 10,
    ]
    out[:, CLASSES * CLASSES :] = np.stack(columns, 1)
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["label", "x"])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def parts(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the unbiased risk with the logistic loss, that of positives and that of negatives, and their gradients; rows have a last 1."""
    zp, zu = p @ w, u @ w
    sp, su = sigmoid(zp), sigmoid(zu)
    as_positive = prior * np.logaddexp(0, -zp).mean()
    as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return as_positive, as_negative, prior * (p.T @ (sp - 1)) / len(p), u.T @ su / len(u) - prior * (p.T @ sp) / len(p)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative risk with the logistic loss, by Adam on all rows; where the negative part of the risk is below zero, a step goes against it alone."""
    p, u = (np.hstack((x, np.ones((len(x), 1)))) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for t in range(1, steps + 1):
        _, as_negative, g_positive, g_negative = parts(w, p, u, prior)
        g = g_positive + g_negative if as_negative >= 0 else -g_negative
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the unlabelled's to the positives' share above a score, of a model that tells the two apart, over scores that at least a tenth of the positives exceed."""
    w = fit(positive, unlabelled, 0.5, 150)
    sp, su = (np.sort(np.hstack((x, np.ones((len(x), 1)))) @ w) for x in (positive, unlabelled))
    cuts = np.quantile(sp, np.linspace(0, 0.9, 46))
    above = lambda s: 1 - np.searchsorted(s, cuts) / len(s)
    return float(np.clip((above(su) / np.maximum(above(sp), 1e-9)).min(), 0.01, 0.99))


class Model:
    """A fitted scorer; without positives or unlabelled texts it gives every text the prior."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None):
        self.prior = prior if prior is not None else 0.5
        self.weights = None
        if len(positive) and len(unlabelled):
            self.centre, scale = unlabelled.mean(0), unlabelled.std(0)
            self.scale = np.where(scale > 1e-6, scale, 1)
            p, u = self.norm(positive), self.norm(unlabelled)
            if prior is None:
                self.prior = estimated_prior(p, u)
            self.weights = fit(p, u, self.prior)

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -5, 5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return sigmoid(self.norm(x) @ self.weights[:-1] + self.weights[-1])


def learn(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS) -> Model:
    """docs (doc_id, text) and labels (doc_id, quality) to learn from. NULL ids and labels teach nothing; a document with several labels is positive if any is 1."""
    marks = only(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("label"))
    docs = only(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull())

    def sample(rows: DataFrame) -> np.ndarray:
        n = rows.count()
        if n > train_docs:
            rows = rows.filter(chosen(train_docs / n, 29))
        return np.array([r["x"] for r in map_arrow(rows.select("label", "text"), _vectors, "label int, x array<double>").toLocalIterator()]).reshape(-1, FEATURES)

    n, ones = marks.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)), F.sum("label")).first()
    prior = min(max(ones / n, 0.01), 0.99) if n and 0 < ones < n else None
    positive = sample(docs.join(marks.filter("label = 1"), "doc_id"))
    return Model(positive, sample(docs.withColumn("label", F.lit(0))), prior)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(features(part.column("text"))))], ["doc_id", "score"])


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted (1 at the threshold or above).

    NULL counts as empty, and empty texts are scored by the vector of an empty text. Repeated rows are scored each by
    itself; an empty table gives an empty result; further columns are ignored.
    """
    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = map_arrow(rows, lambda b: _scored(b, shared.value), f"doc_id {kind}, score double")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold() == 0
    model = learn(docs.filter(~held_out), labels.filter(~held_out))
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
