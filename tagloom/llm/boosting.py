"""Histogram gradient boosting for logistic loss in numpy, with monotonic constraints.

Trees are kept flattened: for all trees together one array each of feature, threshold, left and
right child and leaf value, so that a block of rows is scored by ``depth`` gathers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Node arrays of all trees; a leaf points to itself. Rows go left where x <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Forest:
    """Boosted trees for labels ``y`` (0 or 1). ``monotone[f]``: 1 rising, -1 falling, 0 free."""
    n, width = x.shape
    monotone = monotone or (0,) * width
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.empty(0) for f in range(width)]
    codes = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1) if width else np.empty((n, 0), int)
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    margin = np.full(n, bias)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        nodes.append([0, 0.0, me, me, float(np.clip(-total_g / (total_h + ridge), low, high)) * rate])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for f in range(width):
                k = len(cuts[f]) + 1
                if k < 2:
                    continue
                c = codes[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, k))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = total_g - gl, total_h - hl, len(rows) - nl
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - (gr * wr + 0.5 * (hr + ridge) * wr**2)
                whole = nodes[me][4] / rate
                gain += total_g * whole + 0.5 * (total_h + ridge) * whole**2
                bad = (nl < least) | (nr < least)
                if monotone[f]:
                    bad |= (wr - wl) * monotone[f] < 0
                gain[bad] = -1
                if gain.max() > best[0]:
                    j = int(gain.argmax())
                    best = (float(gain[j]), f, j, float(wl[j]), float(wr[j]))
        if best[1] >= 0:
            _, f, j, wl, wr = best
            mid = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[f]]
            goes = codes[rows, f] <= j
            nodes[me][:2] = [f, float(cuts[f][j])]
            nodes[me][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
            nodes[me][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        else:
            out[rows] = nodes[me][4]
        return me

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(n)
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), 0, -np.inf, np.inf))
        margin += out
    flat = np.array(nodes, float).reshape(-1, 5)
    return Forest(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots, np.int64), depth, bias)
