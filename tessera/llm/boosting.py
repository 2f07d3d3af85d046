"""Gradient-boosted trees for two classes, in numpy, with monotonic constraints.

Trees are grown level by level on histograms and flattened into node arrays, so
that a batch is scored by `depth` vectorised steps for each tree.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class Forest:
    """feature, threshold, value: (trees, nodes) arrays; children of node i are 2i+1 and 2i+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.feature, self.threshold, self.value, self.base, self.depth = feature, threshold, value, base, depth

    def margins(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(np.asarray(x, float)), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: float = 1.0) -> Forest:
    """y: 0 or 1. monotone: for each feature 1 (never falls), -1 (never rises) or 0.

    A split on a constrained feature must order its children's values; both
    subtrees are then held to either side of the middle between them, so that the
    sum of trees is monotone in that feature everywhere.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)  # x > edges[b]: bin over b
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    margin = np.full(n, base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for i in range(inner):
            at = np.flatnonzero(node == i)
            own = _value(g[at].sum(), h[at].sum(), l2, low[i], high[i])
            value[k, i] = own
            left, right = 2 * i + 1, 2 * i + 2
            low[[left, right]], high[[left, right]] = low[i], high[i]
            best = _split(binned[at], g[at], h[at], [len(e) for e in edges], monotone, l2, low[i], high[i], least) if len(at) else None
            if best is None:  # all go left; both children keep this node's value
                value[k, [left, right]] = own
                low[[left, right]] = high[[left, right]] = own
                node[at] = left
                continue
            j, b, vl, vr = best
            feature[k, i], threshold[k, i] = j, edges[j][b]
            value[k, [left, right]] = vl, vr
            if monotone[j]:
                mid = (vl + vr) / 2
                (high if monotone[j] > 0 else low)[left] = mid
                (low if monotone[j] > 0 else high)[right] = mid
            node[at] = np.where(binned[at, j] > b, right, left)
        value[k] *= rate
        margin += value[k, node]
    return Forest(feature, threshold, value, base, depth)


def _value(g, h, l2, low, high):
    return np.clip(-g / (h + l2), low, high)


def _split(b: np.ndarray, g: np.ndarray, h: np.ndarray, sizes: list[int], monotone: np.ndarray, l2: float, low: float, high: float, least: float):
    best, found, gt, ht = 1e-6, None, g.sum(), h.sum()
    gain = lambda v, gs, hs: -(gs * v + 0.5 * (hs + l2) * v * v)
    whole = gain(_value(gt, ht, l2, low, high), gt, ht)
    for j, size in enumerate(sizes):
        if not size:
            continue
        gl, hl = (np.cumsum(np.bincount(b[:, j], w, size + 1))[:-1] for w in (g, h))
        vl, vr = _value(gl, hl, l2, low, high), _value(gt - gl, ht - hl, l2, low, high)
        gains = gain(vl, gl, hl) + gain(vr, gt - gl, ht - hl) - whole
        gains[(hl < least) | (ht - hl < least)] = -1
        if monotone[j]:
            gains[(vr - vl) * monotone[j] < 0] = -1
        if (i := int(gains.argmax())) >= 0 and gains[i] > best:
            best, found = gains[i], (j, i, float(vl[i]), float(vr[i]))
    return found
