"""What the fitted operators share: a bounded sample of labelled rows, logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import durable


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most most[y] labelled rows of each class that are not held out, by hash order; and all such rows' counts.

    A doc_id with several labels has the largest of them; of several documents with one doc_id, one is taken (by the texts' hashes).
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    picked = None
    for y, n in most.items():
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("x")).join(F.broadcast(picked), "doc_id")
    return durable(found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("doc_id", "x.text", "y")), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small ridge on all but the first weight, the intercept."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + keep @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w
