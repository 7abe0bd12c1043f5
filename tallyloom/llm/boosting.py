"""Gradient-boosted trees for a yes/no label, in numpy: histogram splits, trees of fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        inner = 2**depth - 1
        self.feature = np.zeros((rounds, inner), np.int32)
        self.threshold = np.full((rounds, inner), np.inf)
        self.value = np.zeros((rounds, inner + 1))
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        margin = np.full(n, self.bias)
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, curvature = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)  # in the heap order of a full tree
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.zeros(count)
                for f in range(width):
                    cell = (node - first) * (self.bins + 1) + binned[:, f]
                    g = np.bincount(cell, gradient, count * (self.bins + 1)).reshape(count, -1).cumsum(axis=1)
                    h = np.bincount(cell, curvature, count * (self.bins + 1)).reshape(count, -1).cumsum(axis=1)
                    gain = g**2 / (h + self.least) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.least) - g[:, -1:] ** 2 / (h[:, -1:] + self.least)
                    gain = gain[:, : len(edges[f])]
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    for k in np.flatnonzero(top > best + 1e-9):
                        best[k] = top[k]
                        self.feature[r, first + k], self.threshold[r, first + k] = f, edges[f][at[k]]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[r, node]] > self.threshold[r, node])
            leaf = node - (2**self.depth - 1)
            g, h = np.bincount(leaf, gradient, 2**self.depth), np.bincount(leaf, curvature, 2**self.depth)
            self.value[r] = self.rate * g / (h + self.least)
            margin += self.value[r][leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes."""
        margin = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-margin))
