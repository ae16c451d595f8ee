"""Gradient-boosted trees of fixed depth for a yes or no target, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature`` and ``threshold``: (trees, 2**depth - 1); ``leaf``: (trees, 2**depth). A value above the threshold goes right."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(rows) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 30.0, ridge: float = 4.0, sample: float = 1.0, seed: int = 1) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins. Each tree's splits are found on a new ``sample`` of the rows."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    code = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)  # code > b iff x > cuts[b]
    base = float(np.log((y @ weight + 1) / ((1 - y) @ weight + 1)))
    score, inner = np.full(n, base), 2**depth - 1
    feature, threshold, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1))
    rng = np.random.default_rng(seed)
    codes = np.ascontiguousarray(code.T)
    for tree in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        all_g, all_h = weight * (y - p), weight * p * (1 - p)
        rows = np.arange(n) if sample >= 1 else np.flatnonzero(rng.random(n) < sample)
        g, h, at, own = all_g[rows], all_h[rows], np.zeros(len(rows), np.int64), codes[:, rows]
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            for k in range(m):
                if not len(cuts[k]):
                    continue
                size = len(cuts[k]) + 1
                slot = local * size + own[k]
                gs = np.bincount(slot, g, width * size).reshape(width, size)
                hs = np.bincount(slot, h, width * size).reshape(width, size)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least * 0.1 * sample) | (ht - hl < least * 0.1 * sample)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                for v in np.flatnonzero(top > best).tolist():
                    best[v], feature[tree, first + v], threshold[tree, first + v] = top[v], k, cuts[k][b[v]]
            at = 2 * at + 1 + (x[rows, feature[tree, at]] > threshold[tree, at])
        at = np.zeros(n, np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[np.arange(n), feature[tree, at]] > threshold[tree, at])
        slot = at - inner
        leaf[tree] = rate * np.bincount(slot, all_g, inner + 1) / (np.bincount(slot, all_h, inner + 1) + ridge)
        score += leaf[tree][slot]
    return Trees(base, feature, threshold, leaf)
