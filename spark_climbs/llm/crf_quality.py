"""Document quality from a linear-chain conditional random field over its lines.

Every line with a word gets a label, good or bad. Its features are those of the line and
of both neighbours; the chain adds a weight for each pair of following labels.
Forward-backward gives each line's probability of being good given the whole document,
and the document's score is their mean weighted by the lines' lengths.

Training lines take the label of their document. The model is fitted on the driver from at
most ``TRAIN_DOCS`` labelled documents, chosen by a hash of the id, with all their lines (a few numbers for each);
scoring reads whole texts, in map tasks, without a shuffle.

Inputs of a score are the text alone. Defined results: a null, empty or blank text gets the
training documents' share of good ones (0.5 without any); without labels of both kinds
every text does; rows are independent, so repeated rows and equal ids are scored alike; of a
null doc_id, held_out is false; labels that are null are not used; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 2400
FOLDS, HELD_OUT, LIMIT = 5, 0, 0.3
STEPS, RATE, RIDGE = 80, 0.15, 1e-4
#: Bounds of the bins into which each measure of a line falls.
BINS = {
    "upper": (0.05, 0.2, 0.5),
    "sign": (0.02, 0.06, 0.15, 0.3),
    "repeat": (0.02, 0.1, 0.3, 0.6),
    "distinct": (0.3, 0.6, 0.9),
    "length": (3.0, 4.5, 6.0, 8.0),
    "short": (0.1, 0.25, 0.4),
    "words": (5.0, 15.0, 60.0),
    "digit": (0.02, 0.1),
}
WIDTH = sum(len(b) + 1 for b in BINS.values())

_UPPER, _LETTER, _DIGIT, _SIGN = 1, 2, 3, 4
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = _UPPER, _LETTER, _LETTER, _DIGIT
for _c in b"#*$%&|<>!?=+/@^~_[]{}\\":
    _CLASS[_c] = _SIGN


def line_measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Measures (a row for each line with a word, in the order of ``BINS``) and lengths in
    bytes of the lines."""
    lines = [x for x in text.encode().split(b"\n") if x and not x.isspace()] if text else []
    if not lines:
        return np.zeros((0, len(BINS))), np.zeros(0)
    size = np.array([len(x) for x in lines])
    at = np.cumsum(size) - size
    kinds = _CLASS[np.frombuffer(b"".join(lines), dtype=np.uint8)]
    of = [np.add.reduceat((kinds == k).view(np.uint8), at, dtype=np.int64) for k in (_UPPER, _LETTER, _DIGIT, _SIGN)]
    cut = [x.split() for x in lines]
    n = np.array([len(w) for w in cut], dtype=float)
    chars = np.array([sum(map(len, w)) for w in cut], dtype=float)
    repeat = np.array([sum(map(operator.eq, w, w[1:])) for w in cut])
    distinct = np.array([len(set(w)) for w in cut])
    short = np.array([sum([len(x) < 4 for x in w]) for w in cut])
    letters = np.maximum(of[0] + of[1], 1)
    columns = (of[0] / letters, of[3] / size, repeat / n, distinct / n, chars / n, short / n, n, of[2] / size)
    return np.stack(columns, axis=1), size.astype(float)


def _indicators(measures: np.ndarray) -> np.ndarray:
    out = np.zeros((len(measures), WIDTH), dtype=np.float32)
    at = 0
    for k, bounds in enumerate(BINS.values()):
        out[np.arange(len(measures)), at + np.searchsorted(bounds, measures[:, k], side="right")] = 1
        at += len(bounds) + 1
    return out


class Packed:
    """Lines of many documents in order of their place in the document, so that a step of
    the chain is taken for all documents at once. Documents are in order of length."""

    def __init__(self, n_lines: np.ndarray):
        order = np.argsort(-n_lines, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.document = np.repeat(np.arange(len(n_lines)), n_lines)
        first = np.cumsum(n_lines) - n_lines
        self.place = np.arange(len(self.document)) - first[self.document]
        self.active = np.bincount(self.place, minlength=1)
        self.start = np.cumsum(self.active) - self.active
        self.at = self.start[self.place] + rank[self.document]


def features(measures: list[np.ndarray]) -> tuple[np.ndarray, Packed]:
    """Features of all lines of the documents: the line's, the previous one's, the next one's."""
    packed = Packed(np.array([len(m) for m in measures], dtype=np.int64))
    own = _indicators(np.concatenate(measures))
    same = packed.document[1:] == packed.document[:-1]
    out = np.zeros((len(own), 3 * WIDTH + 3), dtype=np.float32)
    out[:, :WIDTH] = own
    out[1:, WIDTH : 2 * WIDTH] = own[:-1] * same[:, None]
    out[:-1, 2 * WIDTH : 3 * WIDTH] = own[1:] * same[:, None]
    out[:, -3] = 1
    out[:, -2] = np.r_[1, ~same]
    out[:, -1] = np.r_[~same, 1]
    return out, packed


def forward_backward(odds: np.ndarray, pair: np.ndarray, packed: Packed) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and the expected numbers of label pairs.
    ``odds`` are the lines' own log odds, ``pair`` the weights of following labels."""
    emit = np.empty((len(odds), 2))
    z = np.clip(odds[np.argsort(packed.at)], -30, 30)
    emit[:, 1] = 1 / (1 + np.exp(-z))
    emit[:, 0] = 1 - emit[:, 1]
    step = np.exp(pair - pair.max())
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    start, active = packed.start, packed.active
    last = None
    for t, n in enumerate(active):
        own = slice(start[t], start[t] + n)
        a = emit[own] if last is None else (last[:n] @ step) * emit[own]
        last = ahead[own] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        n = active[t]
        own, before = slice(start[t], start[t] + n), slice(start[t - 1], start[t - 1] + n)
        right = emit[own] * back[own]
        both = ahead[before][:, :, None] * step * right[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = right @ step.T
        back[before] = b / b.sum(axis=1, keepdims=True)
    good = ahead * back
    return (good[:, 1] / good.sum(axis=1))[packed.at], pairs


class Model:
    """Weights of the features, of the pairs of labels, and the share of good documents."""

    def __init__(self, width: int, prior: float):
        self.weights, self.pair, self.prior, self.trained = np.zeros(width), np.zeros((2, 2)), prior, False

    def scores(self, measures: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(measures), self.prior)
        some = [k for k, m in enumerate(measures) if len(m)]
        if not some or not self.trained:
            return out
        x, packed = features([measures[k] for k in some])
        good, _ = forward_backward(x @ self.weights, self.pair, packed)
        size = np.concatenate([sizes[k] for k in some])
        total = np.bincount(packed.document, size * good) / np.bincount(packed.document, size)
        out[some] = np.clip(total, 0.0, 1.0)
        return out


def train(measures: list[np.ndarray], labels: np.ndarray) -> Model:
    """Gradient ascent (Adam) on the likelihood of the lines' labels. Every line counts alike, so a document weighs
    as its lines, and a label as the lines of its documents."""
    keep = [k for k, m in enumerate(measures) if len(m)]
    prior = float(labels.mean()) if len(labels) else 0.5
    model = Model(3 * WIDTH + 3, prior)
    if not keep or len(set(labels[keep])) < 2:
        return model
    x, packed = features([measures[k] for k in keep])
    y = labels[keep][packed.document]
    same = packed.place[1:] > 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
    theta = np.zeros(x.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, pairs = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), packed)
        slope = np.r_[x.T @ (y - good), (seen - pairs).ravel()] / len(y) - RIDGE * theta
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.weights, model.pair, model.trained = theta[:-4], theta[-4:].reshape(2, 2), True
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [line_measures(t)[0].ravel() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["quality", "measures"])


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves the remainder of the held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == HELD_OUT, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAIN_DOCS)
    # TRAIN_DOCS rows
    texts = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text")
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "quality").limit(TRAIN_DOCS)
    rows = texts.select("quality", "text").mapInArrow(_measured, "quality int, measures array<double>").toPandas()
    measures = [np.asarray(m, dtype=float).reshape(-1, len(BINS)) for m in rows["measures"]]
    return train(measures, rows["quality"].to_numpy(dtype=np.int64))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_measures(t) for t in batch.column("text").to_pylist()]
            scores = model.scores([m for m, _ in found], [s for _, s in found]) if found else np.zeros(0)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= LIMIT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return run


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(documents, labels)
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(_scored(model), schema)
