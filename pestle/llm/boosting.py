"""Gradient-boosted regression trees with a softmax loss, on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth, stored as flat arrays; ``fit`` is deterministic."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 20, ridge: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = classes, rounds, depth, rate, bins, least, ridge
        self.features: np.ndarray = np.empty((0, 0), np.int64)
        self.cuts: np.ndarray = np.empty((0, 0))
        self.values: np.ndarray = np.empty((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # code <= k: x <= edge k
        flat = codes + np.arange(m) * self.bins
        hot = np.eye(self.classes)[y]
        score = np.zeros((n, self.classes))
        features, cuts, values = [], [], []
        for _ in range(self.rounds):
            e = np.exp(score - score.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            for c in range(self.classes):
                g, h = hot[:, c] - p[:, c], p[:, c] * (1 - p[:, c])
                f, t, v, leaf = self.grow(codes, flat, edges, g, h)
                score[:, c] += v[leaf]
                features.append(f)
                cuts.append(t)
                values.append(v)
        self.features, self.cuts, self.values = np.array(features), np.array(cuts, np.float32), np.array(values)
        return self

    def grow(self, codes, flat, edges, g, h):
        n, m = codes.shape
        width = m * self.bins
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            first = (1 << level) - 1
            for k in range(1 << level):
                rows = np.flatnonzero(node == first + k)
                if len(rows) < 2 * self.least:
                    continue
                idx = flat[rows].ravel()
                gs = np.bincount(idx, np.repeat(g[rows], m), width).reshape(m, self.bins).cumsum(axis=1)
                hs = np.bincount(idx, np.repeat(h[rows], m), width).reshape(m, self.bins).cumsum(axis=1)
                cs = np.bincount(idx, minlength=width).reshape(m, self.bins).cumsum(axis=1)
                tg, th, tc = gs[0, -1], hs[0, -1], len(rows)
                gain = gs**2 / (hs + self.ridge) + (tg - gs) ** 2 / (th - hs + self.ridge) - tg**2 / (th + self.ridge)
                gain[(cs < self.least) | (tc - cs < self.least)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], cut[first + k] = j, edges[j][b]
            at = node - 0
            go = codes[np.arange(n), feature[at]] > np.array([np.searchsorted(edges[feature[i]], cut[i]) if np.isfinite(cut[i]) else self.bins for i in range(inner)])[at]
            node = 2 * node + 1 + go
        leaf = node - inner
        v = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge)
        return feature, cut, v, leaf

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        score = np.zeros((n, self.classes))
        rows = np.arange(n)
        inner = (1 << self.depth) - 1
        for t in range(len(self.features)):
            f, c = self.features[t], self.cuts[t]
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            score[:, t % self.classes] += self.values[t][node - inner]
        top = score.max(axis=1, keepdims=True)
        return score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))
