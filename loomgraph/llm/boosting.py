"""Histogram gradient-boosted trees, flattened into arrays.

Trees are complete binary trees of a fixed depth in heap order, so a forest is three
matrices (feature, threshold, leaf value) and a batch of rows walks all of them with
one gather per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def margin(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Sum of leaf values of each row."""
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        out = np.full(len(x), self.start)
        tree = np.arange(trees)
        for a in range(0, len(x), rows):
            part = x[a : a + rows]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            out[a : a + rows] += self.leaf[tree, node - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between distinct values, at most bins - 1 of them."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
    return (values[:-1] + values[1:]) / 2


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 5.0
) -> Forest:
    """Boosts the logistic loss. Without rows of both classes, a forest that gives the share of label 1 (0.5 without rows)."""
    inner, n = 2**depth - 1, len(y)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    start = float(np.log(share / (1 - share)))
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n == 0 or y.min() == y.max():
        return Forest(feature, threshold, leaf, start)
    edges = [_edges(c, bins) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            local = node - base
            g, h = np.bincount(local, grad, width), np.bincount(local, hess, width)
            best, cut = np.full(width, 1e-6), np.full(width, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                at = local * size + binned[:, f]
                gl = np.bincount(at, grad, width * size).reshape(width, size).cumsum(1)[:, :-1]
                hl = np.bincount(at, hess, width * size).reshape(width, size).cumsum(1)[:, :-1]
                gr, hr = g[:, None] - gl, h[:, None] - hl
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - (g**2 / (h + penalty))[:, None]
                gain[(hl < least) | (hr < least)] = -1
                top = gain.argmax(1)
                won = gain[np.arange(width), top]
                better = won > best
                best[better], cut[better] = won[better], top[better]
                feature[t, base : base + width][better] = f
                threshold[t, base : base + width][better] = e[top[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        local = node - inner
        g, h = np.bincount(local, grad, inner + 1), np.bincount(local, hess, inner + 1)
        leaf[t] = -rate * g / (h + penalty)
        margin += leaf[t][local]
    return Forest(feature, threshold, leaf, start)
