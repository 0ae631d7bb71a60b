"""Hard partitions of one graph in a task: spectral clustering, block models, attribute filling."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, k: int, starts: int = 10, rounds: int = 100, seed: int = 1) -> np.ndarray:
    """Labels of the best of several starts with spread-out centres."""
    r = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        centers = x[[r.integers(len(x))]]
        while len(centers) < k:
            d = ((x[:, None] - centers) ** 2).sum(-1).min(1)
            centers = np.vstack([centers, x[r.choice(len(x), p=d / d.sum()) if d.sum() > 0 else r.integers(len(x))]])
        for _ in range(rounds):
            own = ((x[:, None] - centers) ** 2).sum(-1).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else centers[j] for j in range(k)])
            if np.allclose(new, centers):
                break
            centers = new
        cost = ((x - centers[own]) ** 2).sum()
        if cost < best - 1e-12:
            best, labels = cost, own
    return labels


def adjacency(n: int, src, dst, weight=None) -> np.ndarray:
    a = np.zeros((n, n))
    w = np.ones(len(src)) if weight is None else np.asarray(weight, float)
    np.add.at(a, (src, dst), w)
    return a + a.T


def laplacian(a: np.ndarray, regularised: bool = True, extra: float = 0.5) -> np.ndarray:
    d = a.sum(1)
    d = d + (d.mean() if regularised else 0) + extra
    return a / np.sqrt(np.outer(d, d))


def _rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def spectral(a: np.ndarray, k: int, regularised: bool = True, seed: int = 1) -> np.ndarray:
    """k-means on unit rows of the leading eigenvectors of the regularised Laplacian."""
    _, v = np.linalg.eigh(laplacian(a, regularised))
    return kmeans(_rows(v[:, -k:]), k, seed=seed)


def covariate_spectral(a: np.ndarray, x: np.ndarray, k: int, kind: str = "assortative", weight: float | None = None, seed: int = 1) -> np.ndarray:
    """Spectral clustering with covariates: assortative (L + w XX'), non-assortative (LL + w XX') or cca (LX)."""
    low, high = x.min(0), x.max(0)
    x = np.where(high > low, (x - low) / np.where(high > low, high - low, 1), x)
    l = laplacian(a, True, 0.0)
    if kind == "cca":
        u, _, _ = np.linalg.svd(l @ x, full_matrices=False)
        return kmeans(_rows(u[:, : min(k, u.shape[1])]), k, seed=seed)
    xx = x @ x.T
    if weight is None:
        weight = np.linalg.eigvalsh(l @ l)[-1] / max(np.linalg.eigvalsh(xx)[-1], 1e-12)
    _, v = np.linalg.eigh((l if kind == "assortative" else l @ l) + weight * xx)
    return kmeans(_rows(v[:, -k:]), k, seed=seed)


def eigengap(a: np.ndarray, most: int = 20) -> tuple[int, np.ndarray]:
    """Number of clusters by the largest step between eigenvalues of D - A, and the eigenvalues."""
    values = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)[: most + 1]
    return int(np.diff(values).argmax()) + 1, values


def block_loglik(a: np.ndarray, labels: np.ndarray, corrected: bool = False) -> float:
    """Sum of m_rs log(m_rs / (c_r c_s)); c are block sizes or degree sums; empty cells add nothing."""
    k = labels.max() + 1
    z = np.eye(k)[labels]
    m = z.T @ a @ z
    c = (z.T @ a.sum(1)) if corrected else z.sum(0)
    scale = np.outer(c, c)
    ok = (m > 0) & (scale > 0)
    return float((m[ok] * np.log(m[ok] / scale[ok])).sum())


def block_search(a: np.ndarray, k: int, corrected: bool = False, rounds: int = 100, tolerance: float = 0.0, seed: int = 1) -> tuple[np.ndarray, list[float]]:
    """Greedy search: each round makes the best move of one node to another block."""
    r = np.random.default_rng(seed)
    n = len(a)
    labels = np.concatenate([np.arange(k), r.integers(0, k, n - k)])[r.permutation(n)]
    now = block_loglik(a, labels, corrected)
    best, top, trace = labels.copy(), now, [now]
    for _ in range(rounds):
        move, value = None, -np.inf
        for u in range(n):
            if (labels == labels[u]).sum() == 1:
                continue
            old = labels[u]
            for g in range(k):
                if g != old:
                    labels[u] = g
                    if (v := block_loglik(a, labels, corrected)) > value:
                        move, value = (u, g), v
            labels[u] = old
        if move is None or value <= now - abs(now) * tolerance and value <= now:
            break
        labels[move[0]] = move[1]
        now = value
        trace.append(now)
        if now > top:
            best, top = labels.copy(), now
    return best, trace


def mode_of(values: np.ndarray) -> float:
    levels, n = np.unique(values, return_counts=True)
    return float(levels[n.argmax()])


def iterative_fill(a: np.ndarray, levels: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Filled category levels and labels: recluster with the levels, then take the mode around each gap.

    The mode is over neighbours in the same community, else over all neighbours, else over all nodes.
    """
    r = np.random.default_rng(seed)
    gone = np.isnan(levels)
    seen = levels[~gone]
    out = levels.copy()
    out[gone] = r.choice(seen, gone.sum())
    labels = np.zeros(len(a), int)
    for _ in range(rounds):
        one_hot = (out[:, None] == np.unique(out)).astype(float)
        labels = covariate_spectral(a, one_hot, k, seed=seed)
        new = out.copy()
        for u in np.flatnonzero(gone):
            around = np.flatnonzero(a[u] > 0)
            same = around[labels[around] == labels[u]]
            pool = same if len(same) else around
            new[u] = mode_of(out[pool]) if len(pool) else mode_of(seen)
        if (new == out).all():
            break
        out = new
    return out, labels


def betweenness(n: int, src, dst) -> tuple[np.ndarray, np.ndarray]:
    """Betweenness and closeness of an undirected graph by breadth-first accumulation."""
    near = [[] for _ in range(n)]
    for u, v in zip(src, dst):
        near[u].append(v)
        near[v].append(u)
    between, close = np.zeros(n), np.zeros(n)
    for s in range(n):
        order, parents = [], [[] for _ in range(n)]
        paths, dist = np.zeros(n), np.full(n, -1)
        paths[s], dist[s] = 1, 0
        queue = [s]
        for u in queue:
            order.append(u)
            for v in near[u]:
                if dist[v] < 0:
                    dist[v] = dist[u] + 1
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
                    parents[v].append(u)
        delta = np.zeros(n)
        for v in reversed(order):
            for u in parents[v]:
                delta[u] += paths[u] / paths[v] * (1 + delta[v])
            if v != s:
                between[v] += delta[v]
        total = dist[dist > 0].sum()
        close[s] = 1 / total if total else 0.0
    return between / 2, close
