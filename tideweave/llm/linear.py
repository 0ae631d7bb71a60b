"""Hashed sparse logistic regression in numpy, with Platt calibration.

Rows are sparse: ``idx`` holds the hashed features of all rows, ``val`` their values, ``first`` where
each row begins.  The table of weights has a fixed size, so a model may be sent to all executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    idx: np.ndarray
    val: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> Rows:
        n = self.first[rows + 1] - self.first[rows]
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.first[rows] - first[:-1], n) + np.arange(first[-1])
        return Rows(self.idx[at], self.val[at], first)


@dataclass
class Linear:
    """Weights, bias, and the slope and intercept that turn a raw score into a probability."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: Rows) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(self.weights[rows.idx] * rows.val, dtype=np.float64)])
        return run[rows.first[1:]] - run[rows.first[:-1]] + self.bias

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * raw + self.shift)


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 200) -> tuple[float, float]:
    """Slope and shift by damped Newton steps, with Platt's smoothed targets and a weak pull to slope 1."""
    pos = y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    weight = np.ones(len(y)) if weight is None else weight
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        e = weight * (p - t)
        g = np.array([(e * raw).sum() + 0.1 * (a - 1), e.sum()])
        w = weight * p * (1 - p)
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        d = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def fit(rows: Rows, y: np.ndarray, size: int, epochs: int = 12, rate: float = 1.0, batch: int = 32, penalty: float = 1e-6, seed: int = 5) -> Linear:
    """Adaptive-gradient training on four fifths of the rows, calibration on the rest.

    With one class only the model gives that class's smoothed share for every row.
    """
    n = len(rows)
    if n < 10 or y.min() == y.max():
        return Linear(np.zeros(size, np.float32), 0.0, 0.0, float(np.log((y.sum() + 1) / (n - y.sum() + 1))))
    order = np.random.default_rng(seed).permutation(n)
    hold, learn = order[: n // 5], order[n // 5 :]
    if y[hold].min() == y[hold].max() or y[learn].min() == y[learn].max():
        hold = learn = order
    m = Linear(np.zeros(size, np.float32))
    seen = np.full(size, 1e-8, np.float32)
    seen_bias = 1e-8
    # both classes count alike while training; calibration brings back their shares
    weight = np.where(y > 0, 0.5 / y[learn].mean(), 0.5 / (1 - y[learn].mean()))
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            pick = learn[at : at + batch]
            x = rows.take(pick)
            error = (sigmoid(m.raw(x)) - y[pick]) * weight[pick]
            idx, back = np.unique(x.idx, return_inverse=True)
            g = np.bincount(back, np.repeat(error, np.diff(x.first)) * x.val, len(idx)) / len(pick)
            g += penalty * m.weights[idx]
            seen[idx] += g * g
            m.weights[idx] -= (rate * g / np.sqrt(seen[idx])).astype(np.float32)
            gb = error.mean()
            seen_bias += gb * gb
            m.bias -= rate * gb / np.sqrt(seen_bias)
    m.slope, m.shift = platt(m.raw(rows.take(hold)), y[hold])
    return m
