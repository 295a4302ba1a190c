"""Gradient-boosted regression trees for a logistic loss, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: ``feature`` and ``cut`` by inner node, ``value`` by leaf; right where x > cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Newton boosting with histograms. No rows, or one label alone: the base rate is all it knows (0.5 without rows)."""
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate_1 / (1 - rate_1)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    d = x.shape[1]
    total = np.full(len(y), base)
    features, thresholds, values = [], [], []
    flat = binned + np.arange(d) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (d * bins) + flat).ravel()
            G, H = (np.bincount(key, np.repeat(v, d), many * d * bins).reshape(many, d, bins).cumsum(2) for v in (g, h))
            GT, HT = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + l2) + (GT - G) ** 2 / (HT - H + l2) - GT**2 / (HT + l2)
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        total += value[leaf]
        features.append(feature)
        thresholds.append(cut)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))
