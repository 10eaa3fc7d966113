"""Gradient boosted oblivious trees over small integer features, with calibrated probabilities."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Boosted:
    """Logistic boosting: each tree asks the same ``depth`` questions of every row."""

    def __init__(self, rounds: int = 100, depth: int = 5, rate: float = 0.3, bins: int = 17, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.clip(x, 0, self.bins - 1).astype(np.int64)
        n, width = x.shape
        flat = x + np.arange(width) * self.bins
        score = np.zeros(n)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score += self.base
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        for _ in range(self.rounds):
            p = sigmoid(score)
            g, h = y - p, p * (1 - p)
            leaf, asks = np.zeros(n, np.int64), []
            for level in range(self.depth):
                shape = (1 << level, width, self.bins)
                at = (leaf[:, None] * width * self.bins + flat).ravel()
                total = shape[0] * width * self.bins
                sg = np.bincount(at, np.repeat(g, width), total).reshape(shape).cumsum(axis=2)
                sh = np.bincount(at, np.repeat(h, width), total).reshape(shape).cumsum(axis=2)
                rg, rh = sg[:, :, -1:] - sg, sh[:, :, -1:] - sh
                gain = (sg**2 / (sh + self.ridge) + rg**2 / (rh + self.ridge)).sum(axis=0)
                f, t = np.unravel_index(np.argmax(gain), gain.shape)
                asks.append((int(f), int(t)))
                leaf = leaf * 2 + (x[:, f] > t)
            size = 1 << self.depth
            values = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            self.trees.append((asks, values))
            score += values[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0, self.bins - 1)
        score = np.full(len(x), self.base)
        for asks, values in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for f, t in asks:
                leaf = leaf * 2 + (x[:, f] > t)
            score += values[leaf]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt's scaling on rows the trees have not seen."""
        s, a, b = self.raw(x), 1.0, 0.0
        for _ in range(50):
            p = sigmoid(a * s + b)
            w, d = p * (1 - p) + 1e-6, y - p
            m = np.array([[np.sum(w * s * s) + 1e-3, np.sum(w * s)], [np.sum(w * s), np.sum(w) + 1e-3]])
            step = np.linalg.solve(m, np.array([np.sum(d * s) - 1e-3 * (a - 1), np.sum(d)]))
            a, b = a + step[0], b + step[1]
        self.scale = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return sigmoid(a * self.raw(x) + b)
