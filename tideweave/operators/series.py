"""Kernels for one series or one panel in a task: gaps, breaks, stationarity, influence."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np


def kalman(y: np.ndarray, a=None, h=None, q=None, r: float = 1.0, p=None, x=None):
    """Filter of a two-state model with gaps: filled values, level variances, lower and upper bounds.

    The default moves the level by the slope: rows (1, 1), (0, 1); gaps carry the prediction.
    """
    a = np.array([[1.0, 1.0], [0.0, 1.0]]) if a is None else np.asarray(a, float)
    h = np.array([1.0, 0.0]) if h is None else np.asarray(h, float)
    q = 1e-5 * np.eye(2) if q is None else np.asarray(q, float)
    p = 1e3 * np.eye(2) if p is None else np.asarray(p, float)
    x = np.zeros(2) if x is None else np.asarray(x, float)
    level, variance = np.empty(len(y)), np.empty(len(y))
    for t, v in enumerate(y):
        x, p = a @ x, a @ p @ a.T + q
        if not np.isnan(v):
            k = p @ h / (h @ p @ h + r)
            x, p = x + k * (v - h @ x), p - np.outer(k, h @ p)
        level[t], variance[t] = x[0], p[0, 0]
    filled = np.where(np.isnan(y), level, y)
    half = 1.96 * np.sqrt(variance)
    return filled, variance, level - half, level + half


def smooth(y: np.ndarray, ratios=(0.001, 0.01, 0.05, 0.2, 1.0, 5.0)) -> tuple[np.ndarray, np.ndarray]:
    """Gaps filled by a local-level smoother; the ratio of variances is the likeliest of a grid."""
    seen = y[~np.isnan(y)]
    if len(seen) < 2:
        return np.where(np.isnan(y), seen[0] if len(seen) else np.nan, y), np.full(len(y), np.nan)
    best = None
    for ratio in ratios:
        m, v, ms, vs, loglik, scale, n = seen[0], 1e6, [], [], 0.0, 0.0, 0
        predicted = []
        for value in y:
            v_pred = v + ratio
            predicted.append((m, v_pred))
            if np.isnan(value):
                v = v_pred
            else:
                s = v_pred + 1
                e = value - m
                if n:
                    scale += e * e / s
                    loglik -= 0.5 * np.log(s)
                n += 1
                m, v = m + v_pred / s * e, v_pred / s
            ms.append(m)
            vs.append(v)
        loglik -= 0.5 * (n - 1) * np.log(max(scale / (n - 1), 1e-12))
        if best is None or loglik > best[0]:
            best = (loglik, ms, vs, predicted, max(scale / (n - 1), 1e-12))
    _, ms, vs, predicted, scale = best
    out_m, out_v = np.array(ms), np.array(vs)
    for t in range(len(y) - 2, -1, -1):
        gain = vs[t] / predicted[t + 1][1]
        out_m[t] = ms[t] + gain * (out_m[t + 1] - predicted[t + 1][0])
        out_v[t] = vs[t] + gain**2 * (out_v[t + 1] - predicted[t + 1][1])
    return np.where(np.isnan(y), out_m, y), out_v * scale


def breaks(y: np.ndarray, number: int, least: int, regressors: np.ndarray | None = None) -> tuple[list[int], float]:
    """Exact break points of a regression by dynamic programming on residual sums: (ends, rss).

    Each segment has ``least`` points or more; without regressors it is a mean.
    """
    n = len(y)
    x = np.ones((n, 1)) if regressors is None else np.column_stack([np.ones(n), regressors])
    rss = np.full((n, n + 1), np.inf)
    for i in range(n):
        if regressors is None:
            tail = y[i:]
            m = np.arange(1, len(tail) + 1)
            rss[i, i + 1 :] = np.cumsum(tail**2) - np.cumsum(tail) ** 2 / m
        else:
            for j in range(i + max(least, x.shape[1] + 1), n + 1):
                b = np.linalg.lstsq(x[i:j], y[i:j], rcond=None)[0]
                rss[i, j] = ((y[i:j] - x[i:j] @ b) ** 2).sum()
    for i in range(n):
        rss[i, i : min(i + least, n + 1)] = np.inf
    cost = rss[0].copy()
    back = []
    for _ in range(number):
        total = cost[:n, None] + rss
        back.append(total.argmin(0))
        cost = total.min(0)
    ends, j = [], n
    for b in reversed(back):
        j = int(b[j])
        ends.append(j)
    return ends[::-1], float(cost[n])


def pelt(y: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Change points of the mean: the cheapest segmentation with a penalty for each, pruned exactly."""
    n = len(y)
    penalty = 2 * np.log(n) * max(np.var(np.diff(y)) / 2, 1e-12) if penalty is None else penalty
    s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y**2)])
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i)
    f, last, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    f[0] = -penalty
    for j in range(least, n + 1):
        values = [(f[i] + cost(i, j) + penalty, i) for i in open_ if j - i >= least]
        f[j], last[j] = min(values)
        open_ = [i for i in open_ if j - i < least or f[i] + cost(i, j) <= f[j]] + [j - least + 1]
    out, j = [], n
    while j > 0:
        j = int(last[j])
        if j:
            out.append(j)
    return out[::-1]


def cusum(y: np.ndarray) -> tuple[float, int]:
    """Largest scaled cumulative sum of residuals from the mean, and where it is."""
    e = y - y.mean()
    sd = e.std(ddof=1)
    path = np.abs(np.cumsum(e)) / (sd * np.sqrt(len(y))) if sd > 0 else np.zeros(len(y))
    return float(path.max()), int(path.argmax()) + 1


#: Asymptotic critical values of the unit-root statistic with a constant, by level.
UNIT_ROOT = {0.01: -3.43, 0.05: -2.86, 0.1: -2.57}


def unit_root(y: np.ndarray, lags: int = 1) -> tuple[float, bool]:
    """Augmented unit-root statistic with a constant; is it below the 5 % value (stationary)?"""
    d = np.diff(y)
    rows = range(lags, len(d))
    x = np.array([[1.0, y[t], *(d[t - k] for k in range(1, lags + 1))] for t in rows])
    target = d[lags:]
    if len(target) <= x.shape[1]:
        return float("nan"), False
    b = np.linalg.lstsq(x, target, rcond=None)[0]
    res = target - x @ b
    cov = np.linalg.pinv(x.T @ x) * (res @ res) / (len(target) - x.shape[1])
    t = float(b[1] / np.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan")
    return t, t < UNIT_ROOT[0.05]


def beta_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution, by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-30
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + top / c
                c = c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        return out

    scale = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    return scale * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - scale * fraction(1 - x, b, a) / b


def granger(cause: np.ndarray, effect: np.ndarray, order: int = 1) -> tuple[float, float]:
    """F statistic and p value of adding a cause's lags to a regression on the effect's own lags."""
    n = len(effect) - order
    own = np.column_stack([np.ones(n), *(effect[order - k : len(effect) - k] for k in range(1, order + 1))])
    full = np.column_stack([own, *(cause[order - k : len(cause) - k] for k in range(1, order + 1))])
    y = effect[order:]
    rss = [((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() for x in (own, full)]
    d2 = n - full.shape[1]
    if d2 <= 0 or rss[1] <= 0:
        return float("nan"), float("nan")
    f = (rss[0] - rss[1]) / order / (rss[1] / d2)
    return float(f), beta_tail(f, order, d2)


def autoregression(y: np.ndarray, order: int = 2) -> np.ndarray:
    """Least-squares constant and coefficients of an autoregression."""
    n = len(y) - order
    x = np.column_stack([np.ones(n), *(y[order - k : len(y) - k] for k in range(1, order + 1))])
    return np.linalg.lstsq(x, y[order:], rcond=None)[0]


def lasso(x: np.ndarray, y: np.ndarray, size: float, weights: np.ndarray | None = None, sweeps: int = 500, tol: float = 1e-8) -> np.ndarray:
    """Coefficients of 1/(2n) |y - xb|^2 + size * sum of weights * |b|."""
    n, p = x.shape
    w = np.ones(p) if weights is None else weights
    b, r, scale = np.zeros(p), y.copy(), (x * x).sum(0) / n
    for _ in range(sweeps):
        most = 0.0
        for j in np.flatnonzero(scale > 0):
            old = b[j]
            top = x[:, j] @ r / n + scale[j] * old
            b[j] = np.sign(top) * max(abs(top) - size * w[j], 0) / scale[j]
            if b[j] != old:
                r += x[:, j] * (old - b[j])
                most = max(most, abs(b[j] - old))
        if most < tol:
            break
    return b


def network_granger(panel: np.ndarray, depth: int = 1, alpha: float = 0.1, adaptive: bool = False) -> list[tuple[int, int, int, float]]:
    """(target, source, lag, coefficient) of a lasso per target over all series' lags.

    The penalty bounds the chance of a false edge by ``alpha``; ``adaptive`` refits with weights from
    a first pass.
    """
    t, p = panel.shape
    n = t - depth
    x = np.column_stack([panel[depth - k : t - k] for k in range(1, depth + 1)])
    sd = x.std(0)
    x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    out = []
    base = NormalDist().inv_cdf(1 - alpha / (2 * p * depth * p)) / np.sqrt(n)
    for i in range(p):
        y = panel[depth:, i]
        scale = y.std()
        if scale == 0:
            continue
        y = y - y.mean()
        b = lasso(x, y, base * scale)
        if adaptive:
            b = lasso(x, y, base * scale, np.maximum(1, 1 / np.maximum(np.abs(b / scale), 1e-4)))
        out += [(i, int(j % p), int(j // p) + 1, float(b[j])) for j in np.flatnonzero(b)]
    return out


def density_mode(values: np.ndarray, points: int = 512) -> float:
    """Where the Gaussian kernel density (rule-of-thumb width) is largest."""
    values = values[~np.isnan(values)]
    if len(values) < 2 or values.std() == 0:
        return float(values[0]) if len(values) else float("nan")
    iqr = np.subtract(*np.percentile(values, [75, 25])) / 1.34
    width = 0.9 * min(values.std(ddof=1), iqr or values.std(ddof=1)) * len(values) ** -0.2
    grid = np.linspace(values.min() - 3 * width, values.max() + 3 * width, points)
    return float(grid[np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(1).argmax()])


def vector_autoregression(matrices: list[np.ndarray], lengths: list[int], sd: float, seed: int) -> np.ndarray:
    """Segments of first-order vector autoregressions, each going on from the last value."""
    r = np.random.default_rng(seed)
    rows, now = [], np.zeros(len(matrices[0]))
    for m, n in zip(matrices, lengths):
        for _ in range(n):
            now = m @ now + r.normal(0, sd, len(now))
            rows.append(now)
    return np.array(rows)


def shifted_means(lengths: list[int], means: list[float], sd: float, seed: int) -> np.ndarray:
    """Noise around a mean that shifts from segment to segment."""
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(m, sd, n) for n, m in zip(lengths, means)])
