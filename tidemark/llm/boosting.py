"""Gradient-boosted trees in numpy: fitted on a bounded sample, scored over flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth. Node i has the children 2i + 1 and 2i + 2; a node that is not
    split sends everything left. Inner nodes have a feature and a threshold, the last level has values."""

    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for the rows of ``x``; all trees step down together."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        inner = self.feature.shape[1]
        for begin in range(0, len(x), 4096):
            part = x[begin : begin + 4096]
            rows = np.arange(len(part))[:, None]
            at = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[rows, self.feature[trees, at]] > self.threshold[trees, at])
            out[begin : begin + 4096] += self.value[trees, at - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 48,
    least: float = 5.0, ridge: float = 1.0, monotone: dict[int, int] | None = None,
) -> Trees:
    """Logistic loss, histogram splits. ``monotone``: feature -> +1 (score may only rise with it) or -1.

    Without rows the score is 0.5; with one class only, it is near that class everywhere.
    """
    n, inner, leaves = len(x), 2**depth - 1, 2**depth
    if n == 0:
        return Trees(depth, np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)), 0.0)
    signs = monotone or {}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    found = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            best = np.full(count, 1e-6)
            pick = [None] * count
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                width = len(cut) + 1
                place = local * width + binned[:, j]
                g = np.bincount(place, grad, count * width).reshape(count, width)
                h = np.bincount(place, hess, count * width).reshape(count, width)
                m = np.bincount(place, minlength=count * width).reshape(count, width)
                gl, hl, ml = (a.cumsum(1)[:, :-1] for a in (g, h, m))
                gr, hr, mr = g.sum(1)[:, None] - gl, h.sum(1)[:, None] - hl, m.sum(1)[:, None] - ml
                bounds = low[first : first + count, None], high[first : first + count, None]
                vl, vr = (np.clip(-a / (b + ridge), *bounds) for a, b in ((gl, hl), (gr, hr)))
                whole = np.clip(-g.sum(1) / (h.sum(1) + ridge), bounds[0][:, 0], bounds[1][:, 0])
                score = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
                gain = score(gl, hl, vl) + score(gr, hr, vr) - score(g.sum(1), h.sum(1), whole)[:, None]
                gain[(ml < least) | (mr < least)] = -np.inf
                if j in signs:
                    gain[(vr - vl) * signs[j] < 0] = -np.inf
                top = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(count), top] > best):
                    k = top[node]
                    best[node] = gain[node, k]
                    pick[node] = (j, cut[k], vl[node, k], vr[node, k])
            for node, chosen in enumerate(pick):
                i = first + node
                low[[2 * i + 1, 2 * i + 2]], high[[2 * i + 1, 2 * i + 2]] = low[i], high[i]
                if chosen is None:
                    continue
                feature[i], threshold[i] = chosen[:2]
                if sign := signs.get(chosen[0], 0):
                    middle = (chosen[2] + chosen[3]) / 2
                    left, right = (high, low) if sign > 0 else (low, high)
                    left[2 * i + 1] = middle
                    right[2 * i + 2] = middle
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = rate * np.clip(-g / (h + ridge), low[inner:], high[inner:])
        value[np.bincount(leaf, minlength=leaves) == 0] = 0
        # an empty leaf must not break the order between its neighbours
        value = np.clip(value, rate * low[inner:], rate * high[inner:])
        found.append((feature, threshold, value))
        margin += value[leaf]
    return Trees(depth, *(np.stack(a) for a in zip(*found)), base)
