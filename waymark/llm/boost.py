"""Gradient-boosted trees on a bounded training table, and thresholds for a wanted precision."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Binary logistic boosting; each tree splits binned features to ``depth``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, leaf: int = 5):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees, self.depth = float(np.log(p / (1 - p))), [], depth
        if not len(y) or y.min() == y.max():
            return
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)])
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            tree: list = []
            self._grow(binned, grad, hess, np.arange(len(y)), depth, leaf, rate, tree)
            self.trees.append(tree)
            score += self._walk(tree, x)

    def _grow(self, binned, grad, hess, rows, depth, leaf, rate, tree) -> int:
        """Adds the nodes for ``rows`` to ``tree`` as (feature, cut, left, right) or (-1, value)."""
        at = len(tree)
        g, h = grad[rows].sum(), hess[rows].sum()
        tree.append((-1, rate * g / (h + 1.0), 0, 0))
        if not depth or len(rows) < 2 * leaf:
            return at
        best = (1e-6, None)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            b = binned[rows, f]
            n = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, grad[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < leaf) | (len(rows) - n < leaf)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (f, i))
        if best[1] is None:
            return at
        f, i = best[1]
        left = binned[rows, f] <= i
        a = self._grow(binned, grad, hess, rows[left], depth - 1, leaf, rate, tree)
        b = self._grow(binned, grad, hess, rows[~left], depth - 1, leaf, rate, tree)
        tree[at] = (f, float(self.cuts[f][i]), a, b)
        return at

    @staticmethod
    def _walk(tree, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        feature, value = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        left, right = np.array([t[2] for t in tree]), np.array([t[3] for t in tree])
        for _ in range(12):
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= value[node]
            node = np.where(inner, np.where(go, left[node], right[node]), node)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        total = np.full(len(x), self.base)
        for t in self.trees:
            total += self._walk(t, x)
        return 1 / (1 + np.exp(-total))


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float, least: float = 0.5) -> float:
    """Midway below the least score down to which at least ``precision`` are positive; 1.1 (never) if none."""
    by = np.argsort(-score, kind="stable")
    right = np.cumsum(y[by]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & (score[by] >= least))
    if not len(good):
        return 1.1
    last, below = score[by][good[-1]], np.append(score[by], 0.0)[good[-1] + 1]
    return float(max(least, (last + below) / 2))
