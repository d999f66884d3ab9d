"""Histogram gradient-boosted trees for two classes, in numpy.

Fitting bins each feature at quantiles and grows trees level by level from
histograms of gradients. A fitted model is four flat arrays over all nodes of
all trees, and scoring walks all rows through a tree at once.
"""

from __future__ import annotations

import numpy as np

BINS = 64


class Trees:
    """Flat trees: a node with feature -1 is a leaf; the right child follows the left."""

    def __init__(self, base: float, depth: int, roots, feature, threshold, left, value):
        self.base, self.depth, self.roots = base, depth, np.asarray(roots, dtype=np.int32)
        self.feature = np.asarray(feature, dtype=np.int16)
        self.threshold = np.asarray(threshold, dtype=np.float32)
        self.left = np.asarray(left, dtype=np.int32)
        self.value = np.asarray(value, dtype=np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        total = np.full(len(x), self.base)
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                f = self.feature[node]
                right = x[every, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(f < 0, node, self.left[node] + right)
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.1,
        least: int = 20, ridge: float = 1.0) -> Trees:
    """Fit to rows ``x`` (float32) and labels ``y`` (0/1); no rows give 0.5, one class
    its smoothed rate."""
    n = len(y)
    rate_1 = (float(np.sum(y)) + 0.5) / (n + 1.0)
    base = float(np.log(rate_1 / (1 - rate_1)))
    if n == 0 or y.min() == y.max():
        return Trees(base, 0, [], [], [], [], [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32)
             for j in range(x.shape[1])]
    # A value is in bin b if it is above edge b - 1 and not above edge b.
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)],
                      axis=0).astype(np.int64)
    roots, feature, threshold, left, value = [], [], [], [], []
    raw = np.full(n, base)

    def node():
        feature.append(-1)
        threshold.append(0.0)
        left.append(0)
        value.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        at = np.zeros(n, dtype=np.int64)  # place of each row's node in ``level``; -1: in a leaf
        level, where = [root], np.full(n, root)
        for d in range(depth + 1):
            live = at >= 0
            rows = np.flatnonzero(live)
            k = len(level)
            sum_g = np.bincount(at[rows], weights=g[rows], minlength=k)
            sum_h = np.bincount(at[rows], weights=h[rows], minlength=k)
            for i, v in enumerate(level):
                value[v] = float(-rate * sum_g[i] / (sum_h[i] + ridge))
            if d == depth or not k:
                break
            best = np.full(k, 1e-6)
            split = np.full((k, 2), -1)
            for j in range(len(edges)):
                if not len(edges[j]):
                    continue
                key = at[rows] * BINS + binned[j, rows]
                hg, hh, hn = (np.bincount(key, weights=w, minlength=k * BINS).reshape(k, BINS)
                              .cumsum(axis=1)[:, :len(edges[j])]
                              for w in (g[rows], h[rows], None))
                gain = hg ** 2 / (hh + ridge) \
                    + (sum_g[:, None] - hg) ** 2 / (sum_h[:, None] - hh + ridge) \
                    - (sum_g ** 2 / (sum_h + ridge))[:, None]
                total = np.bincount(at[rows], minlength=k)[:, None]
                gain[(hn < least) | (total - hn < least)] = 0
                b = gain.argmax(axis=1)
                won = gain[np.arange(k), b] > best
                best[won] = gain[np.arange(k), b][won]
                split[won] = np.column_stack([np.full(k, j), b])[won]
            nxt, first = [], np.full(k, -1)
            for i, v in enumerate(level):
                if split[i, 0] >= 0:
                    feature[v] = int(split[i, 0])
                    threshold[v] = float(edges[split[i, 0]][split[i, 1]])
                    first[i] = len(nxt)
                    left[v] = node()
                    nxt += [left[v], node()]
            i = at[rows]
            go = binned[split[i, 0], rows] > split[i, 1]
            at[rows] = np.where(split[i, 0] >= 0, first[i] + go, -1)
            level = nxt
            moved = rows[at[rows] >= 0]
            if moved.size:
                where[moved] = np.array(level)[at[moved]]
        raw += np.array(value)[where]
    return Trees(base, depth, roots, feature, threshold, left, value)
