"""Gradient-boosted trees: fitted on a bounded sample, flattened into numpy node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of equal depth, one row per tree: inner nodes in heap order, then leaves.
    A row goes right where its feature exceeds the threshold; a node that was not split sends all rows left."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2^depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2,
        bins: int = 64, l2: float = 1.0, min_rows: float = 1.0) -> Trees:
    """Logistic loss on histogram bins. monotone: feature -> +1 or -1, the only direction in which the score may
    move with it; splits against it are refused, and the midpoint of a constrained split bounds the leaves below."""
    n, k = x.shape
    monotone = monotone or {}
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not n or y.min() == y.max():  # one class or no rows: nothing to learn but the rate
        p = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
        return Trees(feature[:0], threshold[:0], leaf[:0], float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x > e[c] iff code > c
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, sign = np.full(n, base), np.array([monotone.get(j, 0) for j in range(k)])
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        bound = {0: (-np.inf, np.inf)}
        for d in range(depth):
            first, width = (1 << d) - 1, 1 << d
            local = node - first
            best = [(0.0, 0, -1, 0.0)] * width
            for j in range(k):
                m = len(edges[j])
                if not m:
                    continue
                flat = local * (m + 1) + code[:, j]
                gs = np.cumsum(np.bincount(flat, g, width * (m + 1)).reshape(width, m + 1), axis=1)
                hs = np.cumsum(np.bincount(flat, h, width * (m + 1)).reshape(width, m + 1), axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gr, hr = ga - gl, ha - hl
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - ga ** 2 / (ha + l2)
                lv, rv = -gl / (hl + l2), -gr / (hr + l2)
                ok = (hl >= min_rows * 0.1) & (hr >= min_rows * 0.1) & ((rv - lv) * sign[j] >= 0)
                gain = np.where(ok, gain, 0)
                c = gain.argmax(axis=1)
                for w in range(width):
                    if gain[w, c[w]] > best[w][0] + 1e-9:
                        best[w] = (gain[w, c[w]], j, int(c[w]), float(lv[w, c[w]] + rv[w, c[w]]) / 2)
            go = np.zeros(n, bool)
            for w, (gain, j, c, mid) in enumerate(best):
                at, (lo, hi) = first + w, bound[first + w]
                left = right = (lo, hi)
                if c >= 0:
                    feature[t, at], threshold[t, at] = j, edges[j][c]
                    mid = min(max(mid, lo), hi)
                    if sign[j] > 0:
                        left, right = (lo, mid), (mid, hi)
                    elif sign[j] < 0:
                        left, right = (mid, hi), (lo, mid)
                    mine = local == w
                    go[mine] = code[mine, j] > c
                bound[2 * at + 1], bound[2 * at + 2] = left, right
            node = 2 * node + 1 + go
        at = node - inner
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        lo = np.array([bound[inner + i][0] for i in range(leaves)])
        hi = np.array([bound[inner + i][1] for i in range(leaves)])
        leaf[t] = rate * np.clip(-gs / (hs + l2), lo, hi)
        score += leaf[t][at]
    return Trees(feature, threshold, leaf, base)
