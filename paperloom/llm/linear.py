"""Small learners in numpy: logistic regression, Platt scaling, boosted trees."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300, rate: float = 0.05, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by Adam on the full (bounded) sample."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    s = np.ones(len(y), np.float32) if weight is None else weight.astype(np.float32)
    s = s / s.sum()
    for t in range(1, steps + 1):
        d = (sigmoid(x @ w + b) - y) * s
        g, gb = x.T @ d + l2 * w, float(d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b)


def fit_platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets: probability = sigmoid(a * score + b)."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * score + b)
        w = np.maximum(p * (1 - p), 1e-6)
        d = p - target
        h = np.array([[np.sum(w * score * score) + 1e-3, np.sum(w * score)], [np.sum(w * score), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, np.array([np.sum(d * score), np.sum(d)]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a, b


class Boosted:
    """Gradient-boosted depth-limited trees on binned features, logistic loss."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        x, y = x.astype(np.float64), y.astype(np.float64)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        q = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f, self.forest = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = sigmoid(f)
            tree, node = self._tree(q, p - y, np.maximum(p * (1 - p), 1e-6))
            self.forest.append(tree)
            f += self.rate * tree[2][node]
        return self

    def _tree(self, q: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        size = 2 ** (self.depth + 1)
        feat, cutpoint, value, node = np.full(size, -1), np.zeros(size, int), np.zeros(size), np.ones(len(g), int)
        for level in range(self.depth + 1):
            for n in range(2**level, 2 ** (level + 1)):
                rows = np.flatnonzero(node == n)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[n] = -gs / (hs + self.l2)
                if level == self.depth or len(rows) < 8:
                    continue
                best = (1e-6, -1, 0)
                for j in range(q.shape[1]):
                    k = len(self.edges[j]) + 1
                    gl = np.cumsum(np.bincount(q[rows, j], g[rows], k))[:-1]
                    hl = np.cumsum(np.bincount(q[rows, j], h[rows], k))[:-1]
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                    c = int(np.argmax(gain))
                    if gain[c] > best[0]:
                        best = (float(gain[c]), j, c)
                if best[1] >= 0:
                    feat[n], cutpoint[n] = best[1], best[2]
                    node[rows] = 2 * n + (q[rows, best[1]] > best[2])
        return (feat, cutpoint, value), node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row."""
        if not len(x):
            return np.zeros(0)
        q = np.stack([np.searchsorted(e, x[:, j].astype(np.float64), side="right") for j, e in enumerate(self.edges)], 1)
        f = np.full(len(x), self.base)
        for feat, cutpoint, value in self.forest:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                j = feat[node]
                inner = j >= 0
                go = 2 * node + (q[np.arange(len(x)), np.maximum(j, 0)] > cutpoint[node])
                node = np.where(inner, go, node)
            f += self.rate * value[node]
        return sigmoid(f)
