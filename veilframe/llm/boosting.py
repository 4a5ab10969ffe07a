"""Boosted shallow trees on binned features, for models fitted on a bounded sample; numpy only."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 32


def edges(values: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Inner edges of at most that many bins per column, at quantiles of its distinct values."""
    out = []
    for column in values.T:
        distinct, counts = np.unique(column, return_counts=True)
        if len(distinct) <= bins:
            out.append((distinct[1:] + distinct[:-1]) / 2)
        else:
            at = np.searchsorted(np.cumsum(counts), np.arange(1, bins) * counts.sum() / bins)
            out.append(np.unique(distinct[at]))
    return out


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, one column per feature."""
    if not len(values):
        return np.empty((0, len(cuts)), np.int64)
    return np.stack([np.searchsorted(c, values[:, j], "left") for j, c in enumerate(cuts)], axis=1)


class Tree(NamedTuple):
    """A complete tree: inner node k has the children 2k+1 and 2k+2; bins above the cut go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        for _ in range(int(np.log2(len(self.value)))):
            node = 2 * node + 1 + (codes[rows, self.feature[node]] > self.cut[node])
        return self.value[node - len(self.feature)]


def grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, features, rate: float, bins: int = BINS, least: float = 2.0) -> Tree:
    """One tree by Newton steps; a node is split where the gain is largest and both sides hold some weight."""
    inner = 2**depth - 1
    feature, cut = np.full(inner, features[0]), np.full(inner, bins)
    node = np.zeros(len(codes), np.int64)  # within the level
    rows = np.arange(len(codes))
    for level in range(depth):
        n = 2**level
        best = np.full(n, 1e-6)
        at = n - 1
        for f in features:
            place = node * bins + codes[:, f]
            g = np.bincount(place, grad, n * bins).reshape(n, bins)
            h = np.bincount(place, hess, n * bins).reshape(n, bins)
            gl, hl = np.cumsum(g, 1), np.cumsum(h, 1)
            gt, ht = gl[:, -1:], hl[:, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < least) | (ht - hl < least)] = 0
            k = gain.argmax(1)
            top = gain[np.arange(n), k]
            better = top > best
            best = np.where(better, top, best)
            feature[at : at + n][better] = f
            cut[at : at + n][better] = k[better]
        node = 2 * node + (codes[rows, feature[at + node]] > cut[at + node])
    g, h = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
    return Tree(feature, cut, -rate * g / (h + 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def slopes(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss."""
    p = sigmoid(score)
    return p - label, np.maximum(p * (1 - p), 1e-6)


def prior(label: np.ndarray) -> float:
    """Log odds of the labels, smoothed, so that no labels or labels of one kind give a finite start."""
    return float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
