"""Kernels for studies of one graph in a task: detectors, null models, stability, shapes of degrees."""

from __future__ import annotations

import heapq
from math import hypot, lgamma

import numpy as np

from . import partition


def modularity(a: np.ndarray, labels: np.ndarray) -> float:
    d, m2 = a.sum(1), a.sum()
    if m2 == 0:
        return 0.0
    same = labels[:, None] == labels[None, :]
    return float(((a - np.outer(d, d) / m2) * same).sum() / m2)


def fast_greedy(a: np.ndarray) -> np.ndarray:
    """Labels of the partition of largest modularity while merging the best pair of groups."""
    n = len(a)
    labels = np.arange(n)
    best, top = labels.copy(), modularity(a, labels)
    m2 = a.sum()
    if m2 == 0:
        return labels
    e, d = a / m2, a.sum(1) / m2
    alive = list(range(n))
    now = top
    while len(alive) > 1:
        gain = 2 * (e[np.ix_(alive, alive)] - np.outer(d[alive], d[alive]))
        np.fill_diagonal(gain, -np.inf)
        linked = e[np.ix_(alive, alive)] > 0
        np.fill_diagonal(linked, False)
        if not linked.any():
            break
        gain[~linked] = -np.inf
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        u, v = alive[i], alive[j]
        now += gain[i, j]
        e[u] += e[v]
        e[:, u] += e[:, v]
        d[u] += d[v]
        labels[labels == v] = u
        alive.remove(v)
        if now > top + 1e-12:
            best, top = labels.copy(), now
    return np.unique(best, return_inverse=True)[1]


def leading_eigenvector(a: np.ndarray) -> np.ndarray:
    """Labels by splitting groups along the leading eigenvector of the modularity matrix."""
    d, m2 = a.sum(1), a.sum()
    labels, queue, last = np.zeros(len(a), int), [0], 0
    b = a - np.outer(d, d) / max(m2, 1e-12)
    while queue:
        g = queue.pop()
        at = np.flatnonzero(labels == g)
        part = b[np.ix_(at, at)]
        part = part - np.diag(part.sum(1))
        w, v = np.linalg.eigh(part)
        s = np.where(v[:, -1] > 0, 1, -1)
        if w[-1] <= 1e-9 or s @ part @ s <= 1e-9 or abs(s.sum()) == len(s):
            continue
        last += 1
        labels[at[s > 0]] = last
        queue += [g, last]
    return np.unique(labels, return_inverse=True)[1]


def edge_betweenness(n: int, src, dst) -> np.ndarray:
    """Labels of the partition of largest modularity while the busiest edge is removed again and again."""
    edges = {(int(u), int(v)) for u, v in zip(src, dst)}
    a = partition.adjacency(n, *zip(*edges)) if edges else np.zeros((n, n))
    best, top = None, -np.inf
    while True:
        near = [[] for _ in range(n)]
        for u, v in edges:
            near[u].append(v)
            near[v].append(u)
        labels = np.full(n, -1)
        for s in range(n):
            if labels[s] < 0:
                stack = [s]
                while stack:
                    u = stack.pop()
                    if labels[u] < 0:
                        labels[u] = s
                        stack += near[u]
        q = modularity(a, labels)
        if q > top + 1e-12:
            best, top = labels.copy(), q
        if not edges:
            return np.unique(best, return_inverse=True)[1]
        load: dict = dict.fromkeys(edges, 0.0)
        for s in range(n):
            order, paths, dist, parents = [s], np.zeros(n), np.full(n, -1), [[] for _ in range(n)]
            paths[s], dist[s] = 1, 0
            for u in order:
                for v in near[u]:
                    if dist[v] < 0:
                        dist[v] = dist[u] + 1
                        order.append(v)
                    if dist[v] == dist[u] + 1:
                        paths[v] += paths[u]
                        parents[v].append(u)
            delta = np.zeros(n)
            for v in reversed(order):
                for u in parents[v]:
                    c = paths[u] / paths[v] * (1 + delta[v])
                    load[(u, v) if (u, v) in load else (v, u)] += c
                    delta[u] += c
        edges.remove(max(sorted(load), key=load.get))


def walk_clusters(a: np.ndarray, k: int, steps: int = 4) -> np.ndarray:
    """k groups of nodes whose short random walks end alike, by complete linkage."""
    d = np.maximum(a.sum(1), 1e-12)
    p = np.linalg.matrix_power(a / d[:, None], steps) / np.sqrt(d)
    return linkage_cut(np.sqrt(np.maximum(((p[:, None] - p) ** 2).sum(-1), 0)), groups=k)


def linkage_cut(distance: np.ndarray, height: float | None = None, groups: int = 1) -> np.ndarray:
    """Complete-linkage groups whose widest distance is up to ``height``, or so many groups."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    labels, alive = np.arange(len(d)), list(range(len(d)))
    while len(alive) > (1 if height is not None else groups):
        part = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(part.argmin(), part.shape)
        if not np.isfinite(part[i, j]) or height is not None and part[i, j] > height:
            break
        u, v = alive[min(i, j)], alive[max(i, j)]
        d[u] = np.maximum(d[u], d[v])
        d[:, u] = d[u]
        d[u, u] = np.inf
        labels[labels == v] = u
        alive.remove(v)
    return np.unique(labels, return_inverse=True)[1]


def linkage_points(points: np.ndarray, height: float) -> np.ndarray:
    """``linkage_cut`` of points of the plane up to a positive ``height``, without the table of distances.

    Complete linkage cut at one width goes on from its cut at a smaller one, so widths are doubled up
    to ``height``.  At each only pairs of groups that are no wider together than the width can be
    joined: they lie in neighbouring squares of a grid, and how wide they are is told by the corners
    of their hulls.  A joined group keeps the neighbours of both its parts, at the larger distance.
    Time grows with the points but for groups whose points are all corners, such as small circles.
    """
    p, first, own = np.unique(np.asarray(points, float) + 0.0, axis=0, return_index=True, return_inverse=True)
    place = np.empty(len(p), int)
    place[np.argsort(first)] = np.arange(len(p))  # copies are one group, named by the first
    p, own = p[np.argsort(first)], place[own.reshape(-1)]
    roots, corner, start = np.arange(len(p)), p, np.arange(len(p))  # each group's first point, and its corners from where on
    label = roots.copy()
    wide = float(height)
    while len(roots) > 1 and _close(corner, start, wide)[-1].sum() > 16 * len(roots) and wide > 1e-300:
        wide /= 2
    while len(roots) > 1:
        joined = _joined(len(roots), *_near_pairs(corner, start, wide))
        label = roots[joined][np.searchsorted(roots, label)]
        if wide >= height:
            break
        order = np.argsort(joined, kind="stable")
        parts = np.split(corner, start[1:])
        cuts = np.flatnonzero(np.diff(joined[order], prepend=-1))
        roots = roots[joined[order][cuts]]
        groups = [_hull(np.concatenate([parts[i] for i in g]), height, 1e-12 * wide) if len(g) > 1 else parts[g[0]] for g in np.split(order, cuts[1:])]
        corner, start = np.concatenate(groups), np.cumsum([0, *map(len, groups[:-1])])
        wide *= 2
        while wide < height and _close(corner, start, 2 * wide)[-1].sum() <= 16 * len(roots):
            wide *= 2
    return np.unique(label, return_inverse=True)[1][own]


def _close(corner: np.ndarray, start: np.ndarray, wide: float) -> tuple:
    """Boxes of groups; their order by squares of the grid; and two ranges of that order with those that follow in the squares around."""
    low, high = np.minimum.reduceat(corner, start), np.maximum.reduceat(corner, start)
    n, side, rank = len(low), 1.01 * wide, []  # the two of a pair begin within a side
    for c in low.T:
        order = np.argsort(c, kind="stable")
        c = c[order]
        cuts = np.flatnonzero(np.diff(c, prepend=-np.inf) > 2 * side)  # squares are counted from the end of each wide gap
        run = np.diff(cuts, append=n)
        number = np.floor((c - np.repeat(c[cuts], run)) / side).astype(int)
        ends = number[np.cumsum(run) - 1] + 2
        at = np.empty(n, int)
        at[order] = number + np.repeat(np.cumsum(ends) - ends, run)
        rank.append(at)
    row = int(rank[1].max()) + 3
    key = rank[0] * row + rank[1] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.concatenate([np.arange(1, n + 1), np.searchsorted(key, key + row - 1, "left")])
    end = np.concatenate([np.searchsorted(key, key + 1, "right"), np.searchsorted(key, key + row + 1, "right")])
    return low, high, order, begin, end - begin


def _spread(counts: np.ndarray, most: int):
    """Slices of ``counts`` that add up to about ``most``."""
    i, total = 0, np.cumsum(counts)
    while i < len(counts):
        j = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")), i + 1)
        yield slice(i, j)
        i = j


def _runs(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: which range each entry is of, and the entry."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - (np.cumsum(counts) - counts)[which] + begin[which]


def _near_pairs(corner: np.ndarray, start: np.ndarray, wide: float, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of groups i < j whose largest distance is up to ``wide``, and that distance."""
    low, high, order, begin, counts = _close(corner, start, wide)
    size, found = np.diff(start, append=len(corner)), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    source = np.concatenate([order, order])
    for part in _spread(counts, most):
        which, at = _runs(begin[part], counts[part])
        a, b = source[part][which], order[at]
        ok = (np.maximum(high[a], high[b]) - np.minimum(low[a], low[b]) <= wide * (1 + 1e-9)).all(axis=1)
        a, b = np.minimum(a, b)[ok], np.maximum(a, b)[ok]
        many = size[a] * size[b] > most
        for i, j in zip(a[many].tolist(), b[many].tolist()):
            x, y = (corner[start[k] : start[k] + size[k]] for k in (i, j))
            step = max(most // len(y), 1)
            d = np.sqrt([max(((x[k : k + step, None] - y) ** 2).sum(-1).max() for k in range(0, len(x), step))])
            found.append((np.array([i])[d <= wide], np.array([j])[d <= wide], d[d <= wide]))
        a, b = a[~many], b[~many]
        for few in _spread(size[a] * size[b], most):
            i, j = a[few], b[few]
            which, at = _runs(np.zeros(len(i), int), size[i] * size[j])
            d = corner[start[i][which] + at // size[j][which]] - corner[start[j][which] + at % size[j][which]]
            d = np.sqrt(np.maximum.reduceat((d**2).sum(-1), np.flatnonzero(at == 0)))
            found.append((i[d <= wide], j[d <= wide], d[d <= wide]))
    i, j, d = (np.concatenate(x) for x in zip(*found))
    return i, j, d


def _joined(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The group that each group ends in, the smallest of its parts; the least (d, i, j) is joined first."""
    order = np.lexsort((j, i, d))
    heap = list(zip(d[order].tolist(), i[order].tolist(), j[order].tolist()))  # sorted, so a heap
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for e, u, v in heap:
        near[u][v] = near[v][u] = e
    into = list(range(n))
    while heap:
        e, u, v = heapq.heappop(heap)
        if near[u].get(v) != e:
            continue  # one of them was joined since
        a, b, both = near[u], near[v], {}
        into[v], near[v] = u, {}
        for w in a:
            if w not in b and w != v:
                del near[w][u]
        for w, f in b.items():
            if w == u:
                continue
            del near[w][v]
            if w in a:
                both[w] = g = max(a[w], f)
                near[w][u] = g
                if g != a[w]:
                    heapq.heappush(heap, (g, min(u, w), max(u, w)))
        near[u] = both
    for v in range(n):  # a group's number only falls
        into[v] = into[into[v]]
    return np.array(into, int)


def _hull(points: np.ndarray, radius: float, slack: float) -> np.ndarray:
    """Points without those that are never the farthest from a place within ``radius`` of all.

    These lie by more than ``slack`` inside the hull, or inside a bulge of that radius over one of its sides.
    """
    if len(points) < 3:
        return points
    rows = sorted(map(tuple, points.tolist()))
    kept = set()
    for sign in (1, -1):
        chain: list[tuple[float, float]] = []
        for x, y in rows:
            while len(chain) > 1:
                (ox, oy), (ax, ay) = chain[-2:]
                side = hypot(x - ox, y - oy)
                if side == 0:
                    break
                out = sign * ((ax - ox) * (y - oy) - (ay - oy) * (x - ox)) / side
                along = ((ax - ox) * (x - ox) + (ay - oy) * (y - oy)) / side
                if out >= max(along * (side - along), 0.0) / (2 * radius) - slack:
                    break
                chain.pop()
            chain.append((x, y))
        kept.update(chain)
    return np.array(sorted(kept))


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index of two labellings."""
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    s, x, y, p = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    low = x * y / p if p else 0.0
    return float((s - low) / ((x + y) / 2 - low)) if (x + y) / 2 != low else 1.0


def leave_one_out(a: np.ndarray, k: int) -> np.ndarray:
    """For each node the agreement of the clustering without it with the one of all nodes."""
    whole = partition.spectral(a, k)
    out = []
    for u in range(len(a)):
        rest = np.delete(np.arange(len(a)), u)
        out.append(rand_index(whole[rest], partition.spectral(a[np.ix_(rest, rest)], k)))
    return np.array(out)


def surprise(nodes: int, edges: int, inner_pairs: int, inner_edges: int) -> float:
    """-log10 of the chance of so many or more edges inside groups, by the hypergeometric distribution."""
    pairs = nodes * (nodes - 1) // 2
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    top = min(edges, inner_pairs)
    logs = [choose(inner_pairs, j) + choose(pairs - inner_pairs, edges - j) - choose(pairs, edges) for j in range(inner_edges, top + 1) if edges - j <= pairs - inner_pairs]
    if not logs:
        return 0.0
    m = max(logs)
    return float(-(m + np.log(sum(np.exp(x - m) for x in logs))) / np.log(10))


def power_law(degrees: np.ndarray, draws: int = 50, seed: int = 1) -> tuple[float, int, float, float]:
    """Exponent, cut, Kolmogorov distance and bootstrap p of a discrete power law above the best cut."""

    def best(d: np.ndarray):
        out = (np.inf, 1, 2.0)
        for cut in np.unique(d)[:-1]:
            tail = d[d >= cut]
            if len(tail) < 5:
                break
            alpha = 1 + len(tail) / np.log(tail / (cut - 0.5)).sum()
            x = np.sort(tail)
            model = 1 - ((x + 0.5) / (cut - 0.5)) ** (1 - alpha)
            gap = abs(np.searchsorted(x, x, "right") / len(x) - model).max()
            out = min(out, (gap, int(cut), float(alpha)))
        return out

    d = degrees[degrees > 0].astype(float)
    if len(np.unique(d)) < 3:
        return float("nan"), 1, float("nan"), float("nan")
    gap, cut, alpha = best(d)
    r = np.random.default_rng(seed)
    body, share = d[d < cut], (d >= cut).mean()
    worse = 0
    for _ in range(draws):
        tail = r.random(len(d)) < share
        drawn = np.floor((cut - 0.5) * (1 - r.random(len(d))) ** (-1 / (alpha - 1)) + 0.5)
        again = np.where(tail, drawn, r.choice(body, len(d)) if len(body) else drawn)
        worse += best(again)[0] >= gap
    return alpha, cut, float(gap), worse / draws


def fuzzy_means(x: np.ndarray, k: int, power: float = 2.0, rounds: int = 100, seed: int = 1) -> np.ndarray:
    """Memberships (rows sum to 1) of fuzzy c-means."""
    r = np.random.default_rng(seed)
    u = r.dirichlet(np.ones(k), len(x))
    for _ in range(rounds):
        w = u**power
        centers = (w.T @ x) / w.sum(0)[:, None]
        d = np.maximum(((x[:, None] - centers) ** 2).sum(-1), 1e-12)
        new = d ** (-1 / (power - 1))
        new /= new.sum(1, keepdims=True)
        if abs(new - u).max() < 1e-7:
            break
        u = new
    return u
