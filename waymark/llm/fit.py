"""Bounded labelled samples and a small logistic model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, n: int) -> Column:
    """crc32 of the key's text, mod ``n``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int, key: str = "doc_id") -> DataFrame:
    """``key``, text, label of at most about ``bound`` labelled documents.

    If more rows of ``labels`` are allowed, the hash of their key decides. The
    sample of keys is small by this bound, so it is broadcast to the documents.
    Of several documents of a key the one counts whose text has the least hash,
    so the sample is as small however often a key occurs.
    """
    known = labels.where(allowed & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    found = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), key)
    return found.groupBy(key).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))


class Logistic:
    """Logistic regression with ridge, on standardised features; Newton's steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        n, k = x.shape
        self.mean = x.mean(axis=0) if n else np.zeros(k)
        spread = x.std(axis=0) if n else np.ones(k)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        rate = (y.sum() + 0.5) / (n + 1)
        self.w = np.zeros(k + 1)
        self.w[0] = np.log(rate / (1 - rate))
        if n == 0 or y.min() == y.max():
            return
        z = np.column_stack([np.ones(n), (x - self.mean) / self.scale])
        penalty = np.diag([1e-6] + [ridge] * k)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -40, 40)))
            grad = z.T @ (p - y) + penalty @ self.w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, grad)
            step *= min(1.0, 4 / (np.abs(step).max() + 1e-12))
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        z = self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
