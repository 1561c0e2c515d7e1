"""Gradient-boosted trees for a bounded table: histogram fitting with monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Nodes of all trees one after another. feature < 0 marks a leaf; children are places in the same arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                step = np.where(x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, step, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _best_split(binned, rows, grad, hess, monotone, low, high, ridge, leaf):
    total_g, total_h, best = grad[rows].sum(), hess[rows].sum(), (1e-6, None)
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        g, h, n = (np.bincount(b, w, BINS).cumsum()[:-1] for w in (grad[rows], hess[rows], None))
        vl = np.clip(-g / (h + ridge), low, high)
        vr = np.clip(-(total_g - g) / (total_h - h + ridge), low, high)
        gain = -(g * vl + (h + ridge) * vl**2 / 2) - ((total_g - g) * vr + (total_h - h + ridge) * vr**2 / 2)
        whole = np.clip(-total_g / (total_h + ridge), low, high)
        gain += total_g * whole + (total_h + ridge) * whole**2 / 2
        gain[(n < leaf) | (len(rows) - n < leaf) | (monotone[f] * (vr - vl) < 0)] = -1
        if gain.max() > best[0]:
            i = int(gain.argmax())
            best = (gain[i], (f, i, vl[i], vr[i]))
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, leaf: int = 5) -> Forest:
    """Logistic boosting. monotone[f] is 1, -1 or 0: with it the score never falls, never rises, or may do either as f grows.

    A split against its constraint is refused, and the two sides' later values are kept on their own side of the
    middle between them, so that the whole tree keeps it.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, nodes, roots = float(np.log(share / (1 - share))), [], []
    raw = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)

        def grow(rows, level, low, high):
            at = len(nodes)
            nodes.append(None)
            split = _best_split(binned, rows, grad, hess, monotone, low, high, ridge, leaf) if level < depth else None
            if split is None:
                value = rate * float(np.clip(-grad[rows].sum() / (hess[rows].sum() + ridge), low, high))
                nodes[at] = (-1, 0.0, at, at, value)
                raw[rows] += value
                return at
            f, i, vl, vr = split
            middle = (vl + vr) / 2
            goes = binned[rows, f] <= i
            lows, highs = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
            left = grow(rows[goes], level + 1, *lows)
            right = grow(rows[~goes], level + 1, *highs)
            nodes[at] = (f, float(cuts[f][i]), left, right, 0.0)
            return at

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    columns = list(zip(*nodes))
    return Forest(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]), np.array(roots), base)
