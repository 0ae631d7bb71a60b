"""Joint affiliation model: overlapping communities found while missing node attributes are filled.

Nodes have outgoing and incoming affiliations F, H in [0, 1]; an edge u -> v has probability
1 - exp(-F_u . H_v).  Binary attributes follow logistic, continuous ones linear regressions on the
affiliations, both with penalties.  One run is one numpy task; a table of runs is fitted in parallel,
each row with its packed graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def soft(x: float, size: float) -> float:
    return np.sign(x) * max(abs(x) - size, 0.0)


@dataclass
class Controls:
    communities: int
    alpha: float = 0.001
    mix: float = 1.0  # weight of the attributes' part of a node's gradient
    lambda_bin: float = 0.001
    lambda_lin: float = 0.001
    penalty: str = "LASSO"  # LASSO, Ridge or ElasticNet (half and half)
    fill: str = "mean"  # mean, or the neighbours' mean, median or mode
    threshold: float = 5e-3  # percent
    rounds: int = 200
    seed: int = 1
    directed: bool = True


@dataclass
class Fit:
    out: np.ndarray
    into: np.ndarray
    binary: np.ndarray
    linear: np.ndarray
    x: np.ndarray
    z: np.ndarray
    trace: list[tuple[float, float, float, float]] = field(default_factory=list)
    failed: bool = False


def graph_loglik(f: np.ndarray, h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> float:
    """Edges' log-probabilities minus non-edges' rates; the latter from column sums, not from pairs."""
    s = (f[src] * h[dst]).sum(1)
    edge = np.log(-np.expm1(-s), out=np.full(len(s), -np.inf), where=s > 0)
    non_edges = f.sum(0) @ h.sum(0) - (f * h).sum() - s.sum()
    return float(edge[np.isfinite(edge)].sum() - non_edges)


def start_values(z: np.ndarray, missing: np.ndarray, near: list[np.ndarray], how: str) -> np.ndarray:
    """Continuous gaps filled by the column's mean or by a neighbours' statistic from a snapshot.

    Nodes without an observed neighbour get the column's mean; a mode is that of rounded values.
    """
    z = z.copy()
    seen = np.where(missing, np.nan, z)
    for j in range(z.shape[1]):
        column = seen[:, j]
        mean = np.nanmean(column) if np.isfinite(column).any() else 0.0
        for u in np.flatnonzero(missing[:, j]):
            around = column[near[u]]
            around = around[~np.isnan(around)]
            if how == "mean" or not len(around):
                z[u, j] = mean
            elif how == "neighbour_mean":
                z[u, j] = around.mean()
            elif how == "neighbour_median":
                z[u, j] = np.median(around)
            else:
                values, n = np.unique(np.round(around), return_counts=True)
                z[u, j] = values[n.argmax()]
    return z


def _shrunk(top: float, scale: float, size: float, penalty: str) -> float:
    if penalty == "Ridge":
        return top / (scale + size)
    if penalty == "ElasticNet":
        return soft(top, size / 2) / (scale + size / 2)
    return soft(top, size) / scale


def fit_binary(x: np.ndarray, y: np.ndarray, b: np.ndarray, size: float, penalty: str, outer: int = 25, inner: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Penalised logistic regression by reweighted coordinate descent; b[0] is not penalised."""
    b = b.copy()
    n = len(y)
    for _ in range(outer):
        eta = b[0] + x @ b[1:]
        p = sigmoid(eta)
        w = np.maximum(p * (1 - p), 1e-5)
        target = np.clip(eta + (y - p) / w, -1e5, 1e5)
        old = b.copy()
        scale = (w[:, None] * x * x).sum(0) / n
        for _ in range(inner):
            last = b.copy()
            b[0] = (w * (target - x @ b[1:])).sum() / w.sum()
            r = target - b[0] - x @ b[1:]
            for j in np.flatnonzero(scale > 0):
                r += x[:, j] * b[j + 1]
                b[j + 1] = _shrunk((w * x[:, j] * r).sum() / n, scale[j], size, penalty)
                r -= x[:, j] * b[j + 1]
            if abs(b - last).max() < tol:
                break
        if abs(b - old).max() < tol:
            break
    return b


def fit_linear(x: np.ndarray, y: np.ndarray, b: np.ndarray, size: float, penalty: str, sweeps: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Penalised least squares by coordinate descent; the intercept is the mean residual."""
    b = b.copy()
    n = len(y)
    scale = (x * x).sum(0) / n
    for _ in range(sweeps):
        last = b.copy()
        b[0] = (y - x @ b[1:]).mean()
        r = y - b[0] - x @ b[1:]
        for j in np.flatnonzero(scale > 0):
            r += x[:, j] * b[j + 1]
            b[j + 1] = _shrunk((x[:, j] * r).sum() / n, scale[j], size, penalty)
            r -= x[:, j] * b[j + 1]
        if abs(b - last).max() < tol:
            break
    return b


def fit(n: int, src: np.ndarray, dst: np.ndarray, x: np.ndarray, z: np.ndarray, c: Controls) -> Fit:
    """Fit one run.  ``x`` (binary) and ``z`` (continuous) are (n, attributes) with NaN gaps."""
    r = np.random.default_rng(c.seed)
    if not c.directed:
        src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    k = c.communities
    followers = [src[dst == u] for u in range(n)]  # v -> u
    followed = [dst[src == u] for u in range(n)]  # u -> v
    near = [np.unique(np.concatenate(p)) for p in zip(followers, followed)]
    gone_x, gone_z = np.isnan(x), np.isnan(z)
    x = np.where(gone_x, r.random(x.shape) < (1 - gone_x.mean(0)), x).astype(float)
    z = start_values(z, gone_z, near, c.fill)
    sd = z.std(0, ddof=1) if n > 1 else np.ones(z.shape[1])
    z = (z - z.mean(0)) / np.where(sd > 0, sd, 1)
    f, h = r.uniform(1e-4, 5e-4, (n, k)), r.uniform(1e-4, 5e-4, (n, k))
    if not c.directed:
        h = f.copy()
    sides = 2 * k if c.directed else k
    share = np.clip(np.array([x[~gone_x[:, j], j].mean() if (~gone_x[:, j]).any() else 0.5 for j in range(x.shape[1])]), 1e-3, 1 - 1e-3)
    wb, wl = np.zeros((x.shape[1], sides + 1)), np.zeros((z.shape[1], sides + 1))
    wb[:, 0], wl[:, 0] = np.log(share / (1 - share)), z.mean(0)
    out = Fit(f, h, wb, wl, x, z)
    old, l_bin, l_lin = -10_000.0, 0.0, 0.0

    def design() -> np.ndarray:
        return np.hstack([f, h]) if c.directed else f

    def push(u: int, mine: np.ndarray, other: np.ndarray, others: np.ndarray, total: np.ndarray, block: slice) -> np.ndarray:
        s = other[others] @ mine[u]
        e = np.exp(-s)
        ratio = np.divide(e, 1 - e, out=np.zeros_like(e), where=e < 1)
        around = other[others]
        g = (ratio[:, None] * around).sum(0) - (total - other[u] - around.sum(0))
        row = np.concatenate([[1.0], f[u], h[u]]) if c.directed else np.concatenate([[1.0], f[u]])
        attributes = (x[u] - sigmoid(wb @ row)) @ wb[:, block] + (z[u] - wl @ row) @ wl[:, block]
        return np.clip(mine[u] + c.alpha * (g + c.mix * attributes), 0, 1)

    for _ in range(c.rounds):
        l_graph = graph_loglik(f, h, src, dst)
        total = l_graph + l_bin + l_lin
        out.trace.append((total, l_graph, l_bin, l_lin))
        if not np.isfinite(total):
            out.failed = True
            break
        if 100 * abs((total - old) / old) < c.threshold:
            break
        old = total
        sum_f, sum_h = f.sum(0), h.sum(0)
        for u in r.permutation(n):
            # the likelihood pairs F with the tail of an edge, so F follows the nodes it points to
            f[u] = push(u, f, h, followed[u], sum_h, slice(1, k + 1))
            if c.directed:
                h[u] = push(u, h, f, followers[u], sum_f, slice(k + 1, 2 * k + 1))
            else:
                h[u] = f[u]
        d = design()
        l_bin = l_lin = 0.0
        for j in range(x.shape[1]):
            ok = ~gone_x[:, j]
            wb[j] = fit_binary(d[ok], x[ok, j], wb[j], c.lambda_bin, c.penalty)
            eta = wb[j, 0] + d @ wb[j, 1:]
            x[~ok, j] = sigmoid(eta[~ok]) > 0.5
            l_bin += float((x[ok, j] * eta[ok] - np.logaddexp(0, eta[ok])).sum())
        for j in range(z.shape[1]):
            ok = ~gone_z[:, j]
            wl[j] = fit_linear(d[ok], z[ok, j], wl[j], c.lambda_lin, c.penalty)
            fitted = wl[j, 0] + d @ wl[j, 1:]
            z[~ok, j] = fitted[~ok]
            res = z[ok, j] - fitted[ok]
            var = max(float((res * res).mean()), 1e-12)
            l_lin += float((-0.5 * np.log(2 * np.pi * var) - res * res / (2 * var)).sum())
    return out


RUNS = "run_id string, n_iter int, failed boolean, loglik double, loglik_graph double, loglik_bin double, loglik_lin double, bic double, icl double, members array<array<int>>, imputed_bin array<array<double>>, imputed_cont array<array<double>>"


def fit_runs(runs: DataFrame) -> DataFrame:
    """One row per run: likelihoods, criteria, each node's communities, and the filled attributes.

    ``runs`` has run_id, the controls (communities, alpha, lambda_bin, lambda_lin, penalty, seed,
    directed) and the packed graph: n, src, dst (arrays from 0), binary and continuous (arrays of
    arrays with null gaps).  A run's graph must fit in one task.
    """
    from .quality import information_criteria, threshold

    def matrix(rows, n: int) -> np.ndarray:
        out = np.array([[np.nan if v is None else v for v in row] for row in rows], float)
        return out if out.size else np.zeros((n, 0))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                src, dst = np.array(row.src, int), np.array(row.dst, int)
                c = Controls(row.communities, row.alpha, 1.0, row.lambda_bin, row.lambda_lin, row.penalty, seed=row.seed, directed=row.directed)
                m = fit(row.n, src, dst, matrix(row.binary, row.n), matrix(row.continuous, row.n), c)
                cut = threshold(row.n)
                member = (m.out > cut) | (m.into > cut)
                last = m.trace[-1]
                scores = information_criteria(last[0], row.communities, row.n, len(src), np.concatenate([m.out.ravel(), m.into.ravel()]))
                out.append((row.run_id, len(m.trace), m.failed, *last, scores["bic"], scores["icl"], [np.flatnonzero(x).tolist() for x in member], m.x.tolist(), m.z.tolist()))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in RUNS.split(", ")])

    return runs.mapInPandas(work, T.StructType.fromDDL(RUNS))


def generate(n: int, shares: list[float], overlap: float, seed: int, epsilon: float = 1e-4, directed_share: float = 0.5, a: float = 4.0, b: float = 1.0):
    """A network with planted overlapping communities: src, dst, members (n, K) of -1, 0, 1, F, H.

    Every node has a main community drawn by ``shares``; a share of nodes joins a second one; a share
    of memberships points outward only (-1).  Affiliations are Beta(a, b); edges are drawn with
    probability 1 - exp(-F_u . H_v) + epsilon.
    """
    r = np.random.default_rng(seed)
    k = len(shares)
    p = np.array(shares) / sum(shares)
    while True:
        main = r.choice(k, n, p=p)
        if len(np.unique(main)) == k or n < k:
            break
    members = np.zeros((n, k), int)
    members[np.arange(n), main] = 1
    second = r.random(n) < overlap
    members[second, (main[second] + 1 + r.integers(0, max(k - 1, 1), second.sum())) % k] = 1
    members[(members == 1) & (r.random((n, k)) < directed_share / 2)] = -1
    f = np.where(members != 0, r.beta(a, b, (n, k)), 0) * np.where(members == 1, 0.4, 1)
    h = np.where(members != 0, r.beta(a, b, (n, k)), 0) * np.where(members == -1, 0.4, 1)
    probability = 1 - np.exp(-f @ h.T) + epsilon
    np.fill_diagonal(probability, 0)
    src, dst = np.nonzero(r.random((n, n)) < probability)
    return src, dst, members, f, h


def attributes(members: np.ndarray, kind: str, parameters: list[tuple], seed: int) -> np.ndarray:
    """One attribute per community: binary (p inside, p outside) or continuous ((mean, sd) inside, outside)."""
    r = np.random.default_rng(seed)
    out = np.zeros((len(members), len(parameters)))
    for j, p in enumerate(parameters):
        inside = members[:, j % members.shape[1]] != 0
        if kind == "binary":
            out[:, j] = r.random(len(members)) < np.where(inside, p[0], p[1])
        else:
            (m1, s1), (m0, s0) = p
            out[:, j] = np.where(inside, r.normal(m1, s1, len(members)), r.normal(m0, s0, len(members)))
    return out


def drop_values(values: np.ndarray, how: str, share: float, seed: int, cut: float = 0.0) -> np.ndarray:
    """NaN in a share of each column: at random, or among values above or below ``cut`` (ones, for binary)."""
    r = np.random.default_rng(seed)
    out = values.astype(float).copy()
    for j in range(out.shape[1]):
        column = out[:, j]
        pool = {"random": np.arange(len(column)), "above": np.flatnonzero(column > cut), "below": np.flatnonzero(column < cut), "ones": np.flatnonzero(column == 1)}[how]
        out[r.permutation(pool)[: int(len(column) * share)], j] = np.nan
    return out
