"""Gradient-boosted trees for two classes, in numpy: logistic loss, quantile bins, fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> None:
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, value, leaf = self._grow(b, g, h)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), dtype=np.int64)

    def _grow(self, b, g, h):
        """Heap-ordered splits (feature -1: all go left), leaf values, each row's leaf."""
        inner = (1 << self.depth) - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, dtype=np.int64)
        node = np.zeros(len(g), dtype=np.int64)
        width = self.bins + 1
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            for j in range(b.shape[1]):
                at = (node - first) * width + b[:, j]
                gs = np.bincount(at, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(at, h, count * width).reshape(count, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.least) + (gt - gs) ** 2 / (ht - hs + self.least) - gt**2 / (ht + self.least)
                k = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(count), k] > best):
                    best[i], feature[first + i], cut[first + i] = gain[i, k[i]], j, k[i]
            node = self._down(b, node, feature, cut)
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, cut, self.rate * gs / (hs + self.least), leaf

    @staticmethod
    def _down(b, node, feature, cut):
        f = feature[node]
        right = (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node])
        return 2 * node + 1 + right

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = self._down(b, node, feature, cut)
            f += value[node - len(feature)]
        return 1 / (1 + np.exp(-f))
