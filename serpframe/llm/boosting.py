"""Gradient-boosted trees on binned features, in numpy: logistic loss, depth-limited trees."""

from __future__ import annotations

import numpy as np


class Booster:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, leaf: int = 20):
        self.n, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        code = self._codes(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            node = np.zeros(len(y), int)
            size = 2 ** (self.depth + 1) - 1
            feat, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
            g, h = y - p, p * (1 - p)
            for k in range(2 ** self.depth - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 2 * self.leaf:
                    continue
                best = self._split(code[rows], g[rows], h[rows])
                if best:
                    feat[k], cut[k] = best
                    right = code[rows, feat[k]] > cut[k]
                    node[rows] = np.where(right, 2 * k + 2, 2 * k + 1)
            for k in np.unique(node):
                rows = node == k
                value[k] = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
            f += value[node]
            self.trees.append((feat, cut, value))
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def _split(self, code: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, gain = None, 1e-3
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(code.shape[1]):
            n = len(self.edges[j]) + 1
            gs, hs = np.cumsum(np.bincount(code[:, j], g, n)), np.cumsum(np.bincount(code[:, j], h, n))
            cs = np.cumsum(np.bincount(code[:, j], minlength=n))
            ok = (cs[:-1] >= self.leaf) & (len(g) - cs[:-1] >= self.leaf)
            if ok.any():
                got = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
                at = int(np.where(ok, got, -1).argmax())
                if got[at] > gain and ok[at]:
                    best, gain = (j, at), got[at]
        return best

    def probability(self, x: np.ndarray) -> np.ndarray:
        code = self._codes(x)
        f = np.full(len(x), self.base)
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                split = feat[node]
                go = 2 * node + 1 + (code[np.arange(len(x)), np.maximum(split, 0)] > cut[node])
                node = np.where(split >= 0, go, node)
            f += value[node]
        return 1 / (1 + np.exp(-f))
