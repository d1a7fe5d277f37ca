"""Gradient-boosted trees for two classes, in numpy: logistic loss, second-order gains, binned features, each tree on a
random choice of the columns (with a fixed seed)."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, BINS, RIDGE, LEAST, COLUMNS = 60, 4, 0.25, 32, 1.0, 8.0, 72


class Trees:
    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        x = x.astype(np.float64)
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        self.trees = []
        margin = np.full(len(y), self.start)
        useful = np.flatnonzero([len(c) > 0 for c in self.cuts])
        rng = np.random.default_rng(11)
        for _ in range(TREES):
            self.columns = np.sort(rng.choice(useful, min(COLUMNS, len(useful)), replace=False))
            p = 1 / (1 + np.exp(-margin))
            tree, value = self._grow(binned, weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += value

    def _binned(self, x: np.ndarray) -> np.ndarray:
        """Number of cuts below each value, features x rows."""
        return np.array([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], np.int64)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree as arrays: feature and cut of inner nodes (-1: none, go left), values of leaves."""
        feature, cut = np.full(2 ** DEPTH - 1, -1), np.zeros(2 ** DEPTH - 1, np.int64)
        at = np.zeros(len(g), np.int64)
        for node in range(2 ** DEPTH - 1):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if h[rows].sum() >= LEAST:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                own_g, own_h = g[rows], h[rows]
                for j in self.columns:
                    cuts = self.cuts[j]
                    b = binned[j][rows]
                    gl = np.cumsum(np.bincount(b, weights=own_g, minlength=len(cuts) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, weights=own_h, minlength=len(cuts) + 1))[:-1]
                    gain = gl ** 2 / (hl + RIDGE) + (total_g - gl) ** 2 / (total_h - hl + RIDGE) - total_g ** 2 / (total_h + RIDGE)
                    gain[(hl < LEAST / 4) | (total_h - hl < LEAST / 4)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, k
            right = (binned[feature[node]][rows] > cut[node]) if feature[node] >= 0 else np.zeros(len(rows), bool)
            at[rows] = 2 * node + 1 + right
        leaf = at - (2 ** DEPTH - 1)
        value = RATE * np.bincount(leaf, weights=g, minlength=2 ** DEPTH) / (np.bincount(leaf, weights=h, minlength=2 ** DEPTH) + RIDGE)
        return (feature, cut, value), value[leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        binned = self._binned(x.astype(np.float64))
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (binned[f, rows] > cut[at]))
            out += value[at - (2 ** DEPTH - 1)]
        return out
