"""Labelled documents for the operators that learn: a bounded sample, its bound a parameter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.session import durable


def fold(key: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its key's digits."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int, held_out: int,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of about ``bound`` labelled documents outside the held-out fold, all if they are fewer.

    Rows are drawn by a hash of the key.  Only the drawn keys, at most a few bytes times ``bound``, meet the
    documents, by a broadcast; texts of other documents do not move.  Null keys, labels and texts are left out.
    """
    usable = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).filter(
        (F.col("label").isin(0, 1)) & F.col("id").isNotNull() & (fold(F.col("id"), folds) != held_out))
    one = usable.groupBy("id").agg(F.max("label").alias("label"))
    count = max(1, usable.count())
    share = min(1.0, bound / count)
    drawn = one.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return durable(rows.join(F.broadcast(drawn), "id"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last weight is the intercept's."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
