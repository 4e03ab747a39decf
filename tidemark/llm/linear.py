"""Sparse logistic regression in numpy, and the labelled samples it is fitted on."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that are multiplied at once: the results of each operation are that long, not as long as the sample.
BLOCK = 1 << 17


def held_out() -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id counts as not held out, and is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, max_chars: int, learnable: Column | None = None) -> list[tuple[str, int]]:
    """(text, label) of at most `limit` labelled rows, those whose ids have the smallest hashes; texts of over max_chars are left out.

    learnable: a condition on doc_id.  Rows with a null id, text or label aren't used; of
    labels that are given twice for an id the larger counts, and one text for each id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if learnable is not None:
        known = known.where(learnable)
    known = known.groupBy("doc_id").agg(F.max(label).alias("__label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", "text")
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text"))
    return [(r["text"], int(r["__label"])) for r in rows.orderBy("doc_id").collect()]


def give_back() -> None:
    """Return freed memory to the system, after training on the driver: the allocators would keep it while the JVM beside them grows."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def summed_by(by: np.ndarray, of: np.ndarray, value: np.ndarray, factor: np.ndarray, size: int) -> np.ndarray:
    """np.bincount(by, value * factor[of], size), a block of entries at a time; added in the same order, so the sums are the same."""
    total = np.zeros(size)
    for at in range(0, len(by), BLOCK):
        part = slice(at, at + BLOCK)
        np.add.at(total, by[part].astype(np.intp), value[part] * factor[of[part]])
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n_docs: int, n_features: int, target: np.ndarray, weight: np.ndarray | None = None, steps: int = 120, rate: float = 0.3, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) for entries (doc, feature, value) and soft targets, by full-batch Adam."""
    weight = np.ones(n_docs) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    w, bias = np.zeros(n_features), float(np.log((weight @ target + 1e-3) / (weight @ (1 - target) + 1e-3)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, steps + 1):
        error = weight * (sigmoid(summed_by(doc, feature, value, w, n_docs) + bias) - target)
        g, gb = summed_by(feature, doc, value, error, n_features) + l2 * w, float(error.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v) + 1e-8)
        bias -= scale * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def fit_platt(score: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is a probability: damped Newton steps on smoothed targets."""
    pos, neg = target.sum(), (1 - target).sum()
    soft = np.where(target > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mid, spread = float(score.mean()), float(score.std()) or 1.0
    x = np.stack([(score - mid) / spread, np.ones(len(score))])

    def loss(c: np.ndarray) -> float:
        z = c @ x
        return float(np.sum(np.logaddexp(0, z) - soft * z) + 1e-3 * c @ c)

    c = np.array([0.0, np.log((soft.sum() + 1e-9) / ((1 - soft).sum() + 1e-9))])
    for _ in range(60):
        p = sigmoid(c @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 2e-3 * np.eye(2), x @ (p - soft) + 2e-3 * c)
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
    return float(c[0] / spread), float(c[1] - c[0] * mid / spread)
