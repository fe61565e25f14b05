"""Quality by positive-unlabelled learning: non-negative unbiased risk with an estimated class prior.

Trusted positives are labelled rows of good quality; the unlabelled sample is web text at large, whatever its label. No row
labelled as bad is used. The share of positives in the unlabelled text is estimated from the best bin of a first classifier
that tells the two samples apart: among its highest scores, unlabelled text holds the least it can of anything but positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import learning as L

#: Most rows of each of the two samples. Scores are made from whole texts.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 6000
STEPS, RATE, DECAY = 600, 0.05, 1e-4
PREDICT_FROM = 0.7

#: Byte classes: 33 to 64 and 91 to 96 and 123 to 126 singly, then lower, upper, digit, space, line end, other.
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_MARKS = [b for b in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))]
_CLASS[_MARKS] = np.arange(6, 6 + len(_MARKS))
_KINDS = 6 + len(_MARKS)
_COARSE = np.minimum(_CLASS, 6)


def features(column: pa.Array) -> np.ndarray:
    """For each text the square roots of its shares of byte classes and of pairs of coarse classes, and word statistics."""
    data, bounds = C.text_bytes(column)
    n, owner = len(column), np.repeat(np.arange(len(column)), np.diff(bounds))
    size = np.maximum(1, np.diff(bounds))[:, None]
    single = np.bincount(owner * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS) / size
    coarse = _COARSE[data]
    inside = owner[1:] == owner[:-1]
    pairs = np.bincount((owner[1:] * 49 + coarse[:-1] * 7 + coarse[1:])[inside], minlength=n * 49).reshape(n, 49) / size
    starts, ends, counts = C.word_bounds(data, bounds)
    words, length = np.repeat(np.arange(n), counts), ends - starts
    total = np.maximum(1, counts)
    mean = np.bincount(words, length, minlength=n) / total
    spread = np.sqrt(np.maximum(0, np.bincount(words, length.astype(float) ** 2, minlength=n) / total - mean**2))
    last = np.bincount(words, coarse[ends - 1] == 6, minlength=n) / total if len(ends) else np.zeros(n)
    hashes = C.hash_words(data, starts, ends)
    again = [np.bincount(words[lag:], (hashes[lag:] == hashes[:-lag]) & (words[lag:] == words[:-lag]), minlength=n) / total for lag in (1, 2, 3)]
    return np.column_stack([*(np.sqrt(x) for x in again), np.sqrt(single), np.sqrt(pairs), np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, last, np.log1p(counts) / 5])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least share of positives in the unlabelled text, over score bounds with enough rows, with a deviation bound on each."""
    score = L.logistic(np.concatenate([positive[::2], unlabelled[::2]]), np.repeat([1.0, 0.0], [len(positive[::2]), len(unlabelled[::2])]))
    p, u = (np.sort(x[1::2] @ score[:-1]) for x in (positive, unlabelled))
    if not len(p) or not len(u):
        return 0.5
    bounds = p[: max(1, int(len(p) * 0.95))]
    share = lambda x: 1 - np.searchsorted(x, bounds) / len(x)
    slack = np.sqrt(np.log(20) / (2 * len(u))) + np.sqrt(np.log(20) / (2 * len(p)))
    q_p, q_u = share(p), share(u)
    best = int(np.argmin((q_u + slack) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


class QualityModel:
    """Fitted on feature rows; without both samples every score is 1, so that a filter keeps all."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        self.weights = None
        if len(positive) < 4 or len(unlabelled) < 4:
            return
        self.mean, self.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
        p, u = ((x - self.mean) / self.scale for x in (positive, unlabelled))
        self.prior = class_prior(p, u)
        p, u = (np.column_stack([x, np.ones(len(x))]) for x in (p, u))
        w, first, second = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
        loss = lambda z: np.logaddexp(0, -z)
        for step in range(1, STEPS + 1):
            a, b = p @ w, u @ w
            down_p = -p.T @ (1 - L.sigmoid(a)) / len(p)  # gradient of the positive loss on positives
            up_p, up_u = p.T @ L.sigmoid(a) / len(p), u.T @ L.sigmoid(b) / len(u)  # of the negative loss on each sample
            negative = loss(-b).mean() - self.prior * loss(-a).mean()
            slope = self.prior * down_p + up_u - self.prior * up_p if negative >= 0 else self.prior * up_p - up_u
            slope = slope + DECAY * w
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        return L.sigmoid((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1])


def _with_features(batches):
    for part in C.chunks(batches):
        found = features(part.column(1))
        yield pa.RecordBatch.from_arrays([C.list_column(found.ravel(), np.full(len(found), found.shape[1]), pa.float64())], names=["x"])


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from bounded samples of rows that are not held out; only their features reach the driver."""
    found = []
    for ids, most in ((labels.where("quality = 1"), MOST_POSITIVE), (docs, MOST_UNLABELLED)):
        rows = L.rows_of(docs, L.sample_ids(ids, most)).select("doc_id", "text").mapInArrow(_with_features, "x array<double>")
        got = [r["x"] for r in rows.toLocalIterator()]
        got.sort()
        found.append(np.array(got) if got else np.zeros((0, 1)))
    # sorted rows, dealt by a set permutation, so that a rerun learns the same
    return QualityModel(*(x[np.random.Generator(np.random.PCG64(7)).permutation(len(x))] for x in found))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. A null text is an empty one, a null doc_id is kept and not held out.

    Equal texts get equal scores. Only doc_id and text are read, so other columns may have any names. An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in C.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(features(part.column(1))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        part = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["text"])
        found = np.concatenate([shared.value.score(features(x.column(0))) for x in C.chunks([part])]) if len(text) else np.zeros(0)
        C.trim()
        return pd.Series(found)

    return docs.where(score(F.col("text").cast("string")) >= PREDICT_FROM)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, C.table(spark, sf_dir, "labels")))
