"""Labels for the classifiers: which rows are held out, and the bounded sample that a classifier is fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """True where the checksum of the id leaves the remainder 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_ids(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, y) of at most ``bound`` labelled documents that are not held out, the first by a hash of their id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Coefficients (last one: intercept) of a ridge-penalised logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])

    def loss(v):
        z = a @ v
        return np.sum(np.logaddexp(0.0, z) - y * z) + 0.5 * np.sum(penalty * v * v)

    for _ in range(steps):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w
