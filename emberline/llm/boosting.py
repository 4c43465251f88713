"""Small gradient-boosted trees on histograms, and isotonic calibration, in numpy.

Training runs on a sample of bounded size; a model is a few arrays that go to
the tasks with the scoring function.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """Log-loss boosting of depth-limited trees over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.bias, self.trees, self.edges = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # A value shared by most rows still gets a border above it.
        self.edges = [np.unique(np.append(e, np.quantile(x[:, j][x[:, j] > x[:, j].min()], (0.0, 0.25, 0.5, 0.75)))) if (x[:, j] > x[:, j].min()).any() else e for j, e in enumerate(self.edges)]
        b = self._binned(x)
        mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.bias = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.bias)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int32)
            for level in range(self.depth):
                base = 2**level - 1
                for k in range(base, 2 * base + 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2 * self.least:
                        continue
                    best = (1e-6, -1, 0)
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j, e in enumerate(self.edges):
                        size = len(e) + 1
                        v = b[rows, j]
                        left_g = np.cumsum(np.bincount(v, g[rows], size))[:-1]
                        left_h = np.cumsum(np.bincount(v, h[rows], size))[:-1]
                        left_n = np.cumsum(np.bincount(v, minlength=size))[:-1]
                        gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                        gain[(left_n < self.least) | (len(rows) - left_n < self.least)] = -1
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), j, int(gain.argmax()))
                    if best[1] >= 0:
                        feature[k], cut[k] = best[1], best[2]
                node = self._step(b, node, feature, cut, base)
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _step(self, b: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, base: int) -> np.ndarray:
        """Children of the nodes of one level; a node without a split sends all rows left."""
        f = feature[node]
        right = (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node])
        return 2 * node + 1 + right

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = self._step(b, node, feature, cut, 2**level - 1)
            out += value[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """Pool-adjacent-violators fit of labels to scores; linear between the pools' means."""

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Isotonic":
        order = np.argsort(score, kind="stable")
        weight = np.ones(len(y)) if weight is None else weight
        pools: list[list[float]] = []  # mean label, weight, mean score
        for s, v, n in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist()):
            pools.append([v, n, s])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                v1, w1, s1 = pools.pop()
                v0, w0, s0 = pools.pop()
                w = w0 + w1
                pools.append([(v0 * w0 + v1 * w1) / w, w, (s0 * w0 + s1 * w1) / w])
        self.x, self.y = np.array([p[2] for p in pools]), np.array([p[0] for p in pools])
        return self

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)
