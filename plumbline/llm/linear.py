"""Small numpy models over sparse binary features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """A sparse binary matrix by rows: row r has the columns index[first[r]:first[r+1]]."""

    def __init__(self, lists: list[np.ndarray], width: int):
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.index = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), np.diff(self.first))
        self.width, self.height = width, len(lists)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], self.height)

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, r[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 300):
    """(weights, weights of the dense columns ``extra``, intercept) of a logistic model, by accelerated gradient steps."""
    d, k = x.width, extra.shape[1]
    total = weight.sum()
    w = np.zeros(d + k + 1)
    p = float(np.clip((weight * y).sum() / max(total, 1e-9), 1e-4, 1 - 1e-4))
    w[-1] = np.log(p / (1 - p))
    # A diagonal bound of the curvature scales each coordinate's step.
    active = np.maximum(np.diff(x.first) + (extra**2).sum(1) + 1, 1)
    curve = np.concatenate([x.tdot(weight * active), ((weight * active)[:, None] * np.abs(extra)).sum(0), [(weight * active).sum()]])
    step = 1 / (0.25 * curve / total + l2)
    at, t = w.copy(), 1.0
    for _ in range(steps):
        r = weight * (sigmoid(x.dot(at[:d]) + extra @ at[d : d + k] + at[-1]) - y)
        g = np.concatenate([x.tdot(r), extra.T @ r, [r.sum()]]) / total
        g[:-1] += l2 * at[:-1]
        new = at - step * g
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:d], w[d : d + k], w[-1]
