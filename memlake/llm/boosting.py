"""Gradient-boosted regression trees for a binary target in numpy: histogram splits, logistic loss."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees over small non-negative integer features (bins)."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.clip(x, 0, self.bins - 1).astype(np.int64)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, self.bins)
            first = 0
            for level in range(self.depth):
                for k in range(2**level):
                    rows = np.flatnonzero(node == k)
                    if len(rows) > 1:
                        feature[first + k], cut[first + k] = self._split(x[rows], grad[rows], hess[rows])
                node = 2 * node + (x[np.arange(len(y)), feature[first + node]] >= cut[first + node])
                first += 2**level
            g = np.bincount(node, grad, 2**self.depth)
            h = np.bincount(node, hess, 2**self.depth)
            leaf = self.rate * g / (h + self.ridge)
            margin += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def _split(self, x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        n, f = x.shape
        keys = (x + np.arange(f) * self.bins).ravel()
        g = np.bincount(keys, np.repeat(grad, f), f * self.bins).reshape(f, -1)
        h = np.bincount(keys, np.repeat(hess, f), f * self.bins).reshape(f, -1)
        left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
        all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
        gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
        gain[(left_h < 1e-6) | (all_h - left_h < 1e-6)] = -1
        at = int(gain.argmax())
        if gain.ravel()[at] <= 1e-9:
            return 0, self.bins
        return at // (self.bins - 1), at % (self.bins - 1) + 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0, self.bins - 1).astype(np.int64)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node, first = np.zeros(len(x), dtype=np.int64), 0
            for level in range(self.depth):
                node = 2 * node + (x[rows, feature[first + node]] >= cut[first + node])
                first += 2**level
            out += leaf[node]
        return out
