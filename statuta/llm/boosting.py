"""Gradient-boosted trees for two classes and isotonic calibration, in numpy.

Models are plain arrays, so they travel to workers inside a task.  They are
fitted on the driver from a bounded sample of dense feature rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Perfect binary trees of one depth: ``feature`` and ``cut`` of inner nodes, ``leaf`` values; a row a tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner] if len(at) else 0
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over histograms of quantile bins."""
    n, width = x.shape
    share = min(max(float(y.mean()) if n else 0.0, 1e-6), 1 - 1e-6)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    model = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if n == 0 or y.min() == y.max():
        model.feature, model.cut, model.leaf = model.feature[:0], model.cut[:0], model.leaf[:0]
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)  # value <= cuts[k] iff bin <= k
    slots = bins + 1
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            own = node - first
            sums = []
            for w in (g, h):
                sums.append(np.stack([np.bincount(own * slots + binned[:, f], w, count * slots).reshape(count, slots) for f in range(width)], 1))
            gl, hl = (np.cumsum(s, 2) for s in sums)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), slots)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    model.feature[t, first + k], model.cut[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t][node]] > model.cut[t][node])
        leaf = node - inner
        num, den = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        model.leaf[t] = rate * num / (den + ridge)
        score += model.leaf[t][leaf]
    return model


@dataclass
class Isotonic:
    """A rising piecewise linear map from raw scores to shares of positives."""

    at: np.ndarray
    share: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.share) if len(self.at) else np.zeros(len(raw))


def fit_isotonic(raw: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators; a pool's share is drawn towards the overall one by ``prior`` rows."""
    if not len(raw):
        return Isotonic(np.zeros(0), np.zeros(0))
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # positives, rows, sum of scores
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(r)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            b = pools.pop()
            pools[-1] = [x + z for x, z in zip(pools[-1], b, strict=True)]
    base = float(y.mean())
    at = np.array([s / n for _, n, s in pools])
    share = np.array([(p + prior * base) / (n + prior) for p, n, _ in pools])
    return Isotonic(at, np.maximum.accumulate(share))
