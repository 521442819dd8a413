"""Gradient-boosted trees on binned dense features, and isotonic calibration.

Small enough to fit on the driver: the rows are a bounded sample and the model
is a few hundred split points.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting; every tree is complete, node k's children are 2k+1 and 2k+2."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 48, least: float | None = None, shrink: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.least = self.least or min(12.0, max(1.5, n / 1000))  # of the second derivatives in a child
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        binned = self.bin(x)
        mean = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(mean / (1 - mean)))
        self.feature, self.cut, self.value = [], [], []
        f = np.full(n, self.base)
        for _ in range(self.rounds if n else 0):
            p = 1 / (1 + np.exp(-f))
            feature, cut, value = self.grow(binned, y - p, p * (1 - p))
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
            f += value[self.leaf(binned, feature, cut)]
        return self

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros(x.shape, int)

    def grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, inner = binned.shape[1], 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins + 1, np.int64)
        node = np.zeros(len(g), np.int64)  # within its level
        for level in range(self.depth):
            k, b = 2**level, self.bins + 1
            best, pick = np.full(k, 1e-6), np.zeros((k, 2), np.int64)
            pick[:, 1] = self.bins + 1
            for j in range(m):
                at = node * b + binned[:, j]
                gs, hs = (np.bincount(at, w, k * b).reshape(k, b).cumsum(1) for w in (g, h))
                gl, hl = gs[:, :-1], hs[:, :-1]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = gl**2 / (hl + self.shrink) + gr**2 / (hr + self.shrink) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.shrink)
                gain[(hl < self.least) | (hr < self.least)] = -1
                top = gain.argmax(1)
                gains = gain[np.arange(k), top]
                better = gains > best
                best[better], pick[better, 0], pick[better, 1] = gains[better], j, top[better]
            start = k - 1
            feature[start : start + k], cut[start : start + k] = pick[:, 0], pick[:, 1]
            node = 2 * node + (binned[np.arange(len(g)), pick[node, 0]] > pick[node, 1])
        gs, hs = (np.bincount(node, w, 2**self.depth) for w in (g, h))
        return feature, cut, self.rate * gs / (hs + self.shrink)

    def leaf(self, binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        rows, node = np.arange(len(binned)), np.zeros(len(binned), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return node - (2**self.depth - 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, f = self.bin(x), np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            f += value[self.leaf(binned, feature, cut)]
        return f


class Isotonic:
    """Pool-adjacent-violators fit, read off by linear interpolation between the pools' centres."""

    def fit(self, f: np.ndarray, y: np.ndarray) -> Isotonic:
        at, inverse = np.unique(f, return_inverse=True)
        weight = np.bincount(inverse, minlength=len(at)).astype(float)
        value = np.bincount(inverse, y, len(at)) / np.maximum(weight, 1)
        pools: list[list[float]] = []  # value, weight, sum of places
        for v, w, place in zip(value, weight, at, strict=True):
            pools.append([v, w, w * place])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                b, a = pools.pop(), pools.pop()
                w = a[1] + b[1]
                pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
        self.x = np.asarray([p[2] / p[1] for p in pools] or [0.0])
        self.y = np.asarray([p[0] for p in pools] or [0.0])
        return self

    def read(self, f: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(f, self.x, self.y), 0.0, 1.0)
