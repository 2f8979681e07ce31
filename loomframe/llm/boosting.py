"""Histogram gradient boosting for a binary label, and isotonic calibration. Numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: for each tree the features and thresholds of its inner nodes, level by level, and its leaves."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), (self.features.shape[1] + 1).bit_length() - 1 if len(self.features) else 0
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss. Without both labels, a constant."""
    inner = (1 << depth) - 1
    mean = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    empty = Boosted(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return empty
    n, k = x.shape
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins)[1:-1])) for col in x.T]
    # values above the most frequent one deserve edges of their own: most features are zero in most rows
    edges = [np.unique(np.concatenate([e, np.quantile(col[col > 0], np.linspace(0, 1, bins // 2)[:-1]) * 0.999 if (col > 0).any() else []])) for e, col in zip(edges, x.T, strict=True)]
    width = max(len(e) for e in edges) + 1
    codes = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], axis=1)  # code > c: value > edges[c]
    flat = codes + np.arange(k) * width
    raw = np.full(n, base)
    all_f, all_t, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        f_of, t_of = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (k * width) + flat).ravel()
            size = count * k * width
            sums = [np.bincount(at, np.repeat(v, k), size).reshape(count, k, width).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                f, c = divmod(b, width)
                if gain[i, f, c] > 1e-6 and c < len(edges[f]):
                    f_of[first + i], t_of[first + i] = f, edges[f][c]
            node = 2 * node + 1 + (x[np.arange(n), f_of[node]] > t_of[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -rate * gs / (hs + l2)
        raw += value[leaf]
        all_f.append(f_of)
        all_t.append(t_of)
        all_l.append(value)
    return Boosted(base, np.array(all_f), np.array(all_t), np.array(all_l))


@dataclass
class Isotonic:
    """A nondecreasing map from raw scores to probabilities, linear between its points."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal scores are pooled first. Without rows, the logistic function."""
    if not len(raw):
        grid = np.linspace(-8, 8, 65)
        return Isotonic(grid, 1 / (1 + np.exp(-grid)))
    values, where = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []
    for lo, s, n in zip(values, np.bincount(where, y), np.bincount(where), strict=True):
        blocks.append([s, n, lo, lo])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2], hi]
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    return Isotonic(x, np.repeat([b[0] / b[1] for b in blocks], 2))
