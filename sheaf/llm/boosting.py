"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints.

A fitted model is five node arrays; scoring walks all rows down a tree at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees' nodes side by side; a leaf has feature -1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row. Values that are not numbers go left."""
        x = np.where(np.isnan(x), -np.inf, x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                feature = self.feature[at]
                goes_right = x[rows, np.maximum(feature, 0)] > self.threshold[at]
                at = np.where(feature < 0, at, np.where(goes_right, self.right[at], self.left[at]))
            out += self.value[at]
        return out


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: Sequence[int],
    rounds: int = 80,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 64,
    smallest: float = 1.0,
    ridge: float = 1.0,
) -> Trees:
    """Fit to labels 0 and 1. ``monotone`` has -1, 0 or 1 per column: the score may only fall, do either, or only rise.

    A split on a constrained column must order its sides' values, and each side
    is kept on its side of the middle below, so the whole tree is monotonic.
    With one class only, the model is that class's constant.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    mean = float(np.clip(y.mean() if len(y) else 1.0, 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots: list[int] = []
    if 0 < y.sum() < len(y):
        edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = p - y, p * (1 - p)
            roots.append(_grow(nodes, np.arange(len(y)), codes, edges, gradient, weight, monotone, depth, rate, smallest, ridge, -np.inf, np.inf, score))
    columns = list(zip(*nodes, strict=True)) if nodes else [[], [], [], [], []]
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Trees(base, np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), depth)


def _grow(nodes, rows, codes, edges, gradient, weight, monotone, depth, rate, smallest, ridge, low, high, score) -> int:
    here = len(nodes)
    g, h = gradient[rows].sum(), weight[rows].sum()
    value = float(np.clip(-g / (h + ridge), low, high))
    nodes.append([-1, 0.0, -1, -1, value * rate])
    best = (1e-6, None)
    if depth:
        for f, sign in enumerate(monotone):
            n = len(edges[f]) + 1
            gl = np.cumsum(np.bincount(codes[rows, f], gradient[rows], n))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, f], weight[rows], n))[:-1]
            gr, hr = g - gl, h - hl
            vl, vr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
            # loss saved with the clipped values
            gain = -(gl * vl + (hl + ridge) * vl**2 / 2 + gr * vr + (hr + ridge) * vr**2 / 2)
            gain += g * value + (h + ridge) * value**2 / 2
            gain[(hl < smallest) | (hr < smallest) | (sign * (vr - vl) < 0)] = -np.inf
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], (f, k, vl[k], vr[k]))
    if best[1] is None:
        score[rows] += value * rate
        return here
    f, k, vl, vr = best[1]
    middle = (vl + vr) / 2
    bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
    goes_left = codes[rows, f] <= k
    rest = (codes, edges, gradient, weight, monotone, depth - 1, rate, smallest, ridge)
    for side, part, (a, b) in zip((2, 3), (rows[goes_left], rows[~goes_left]), bounds[monotone[f]], strict=True):
        nodes[here][side] = _grow(nodes, part, *rest, a, b, score)
    nodes[here][:2] = [f, float(edges[f][k])]
    return here
