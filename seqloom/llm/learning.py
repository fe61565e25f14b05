"""What the two classifiers share: bounded samples of labelled rows and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def sample_ids(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct doc_ids, the same at every run: those with the smallest hashes. Held-out ids are left out."""
    ids = rows.where(F.col("doc_id").isNotNull() & ~C.held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids``, a sample of bounded size, which is broadcast."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge-penalised logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], decay * len(x))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w
