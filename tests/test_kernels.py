import numpy as np

from tideweave.operators import affiliation as A
from tideweave.operators import pareto, partition, series, studies
from tideweave.operators.quality import threshold


def planted():
    src, dst, members, f, h = A.generate(100, [1, 1, 1], 0.1, 1)
    x = A.drop_values(A.attributes(members, "binary", [(0.9, 0.1)] * 3, 2), "random", 0.1, 3)
    z = A.drop_values(A.attributes(members, "continuous", [((5, 1), (0, 1))] * 3, 4), "random", 0.1, 5)
    return src, dst, members, f, h, x, z


def test_likelihood_without_forming_non_edges():
    src, dst, _, f, h, _, _ = planted()
    s = f @ h.T
    edge = np.zeros((100, 100), bool)
    edge[src, dst] = True
    off = ~np.eye(100, dtype=bool)
    with np.errstate(divide="ignore"):
        log = np.log(-np.expm1(-s))
    want = log[edge & np.isfinite(log)].sum() - s[off & ~edge].sum()
    assert abs(A.graph_loglik(f, h, src, dst) - want) < 1e-6


def test_affiliations_recover_planted_communities_and_values():
    src, dst, members, _, _, x, z = planted()
    m = A.fit(100, src, dst, x, z, A.Controls(3, rounds=150))
    assert not m.failed and m.trace[-1][0] > m.trace[0][0]
    found = (m.out > threshold(100)) | (m.into > threshold(100))
    both = (members != 0).T.astype(int) @ found.astype(int)
    assert sorted(both.argmax(1)) == [0, 1, 2] and both.max(1).sum() > 0.85 * (members != 0).sum()
    truth = A.attributes(members, "binary", [(0.9, 0.1)] * 3, 2)
    gone = np.isnan(x)
    assert (m.x[gone] == truth[gone]).mean() > 0.7


def test_penalties_shrink():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(80, 3)), r.normal(size=80)
    y = y + 2 * x[:, 0]
    free, some, much = (A.fit_linear(x, y, np.zeros(4), size, "LASSO") for size in (0.0, 0.3, 10.0))
    assert abs(free[1]) > abs(some[1]) > 0 and (much[1:] == 0).all()
    assert abs(free - np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]).max() < 1e-4
    ridge = A.fit_linear(x, y, np.zeros(4), 0.3, "Ridge")
    assert abs(ridge[1]) < abs(free[1]) and (ridge[1:] != 0).all()
    b = A.fit_binary(x, (x[:, 0] > 0).astype(float), np.zeros(4), 0.05, "LASSO")
    assert b[1] > 0


def test_partitions():
    src, dst, members, *_ = planted()
    a = partition.adjacency(100, src, dst)
    labels = partition.spectral(a, 3)
    table = np.array([[(members[labels == c, k] != 0).sum() for k in range(3)] for c in range(3)])
    assert sorted(table.argmax(1)) == [0, 1, 2]
    assert partition.eigengap(a)[0] == 3
    best, trace = partition.block_search((a[:40, :40] > 0).astype(float), 3, rounds=20)
    assert trace[-1] >= trace[0] and len(set(best)) == 3
    levels = np.abs(members).argmax(1).astype(float)
    truth = levels.copy()
    levels[::7] = np.nan
    filled, _ = partition.iterative_fill((a > 0).astype(float), levels, 3)
    assert (filled[::7] == truth[::7]).mean() > 0.6


def test_betweenness_of_a_path():
    between, close = partition.betweenness(4, [0, 1, 2], [1, 2, 3])
    assert between.tolist() == [0, 2, 2, 0] and close[0] == 1 / 6


def test_breaks_of_the_mean():
    y = series.shifted_means([20, 45, 30, 55], [0, 8, 16, 24], 1.0, 1)
    assert series.breaks(y, 3, 5)[0] == [20, 65, 95]
    assert series.pelt(y, 50.0) == [20, 65, 95]
    assert 60 <= series.cusum(y)[1] <= 70


def test_filling_a_line():
    line = 5 + 2.0 * np.arange(50)
    y = line.copy()
    y[[3, 10, 11, 12, 30, 31, 40]] = np.nan
    filled, variance, low, high = series.kalman(y)
    assert abs(filled - line).max() < 0.1 and (low < line + 1e-6)[5:].all() and (high > line - 1e-6)[5:].all()
    assert abs(series.smooth(y)[0] - line).max() < 0.5


def test_planted_influence_is_found():
    m = np.array([[0.5, 0.4, 0, 0], [0, 0.5, 0, 0], [0, 0, 0.5, 0.4], [0, 0, 0, 0.5]])
    z = series.vector_autoregression([m], [400], 1.0, 3)
    edges = {(t, s) for t, s, _, _ in series.network_granger(z)}
    assert edges == {(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)}
    assert series.granger(z[:, 1], z[:, 0])[1] < 1e-6 < 0.05 < series.granger(z[:, 0], z[:, 1])[1]


def test_distribution_tails():
    assert abs(series.beta_tail(3.9361, 1, 100) - 0.05) < 1e-4
    assert abs(series.beta_tail(1, 5, 5) - 0.5) < 1e-9
    r = np.random.default_rng(1)
    assert series.unit_root(r.normal(size=300))[1] and not series.unit_root(np.cumsum(r.normal(size=300)))[1]


def test_fronts():
    p = np.array([[1, 5], [2, 2], [5, 1], [3, 3], [2, 2], [6, 6]], float)
    assert pareto.front_numbers(p).tolist() == [1, 1, 1, 2, 1, 3]


def test_detectors_find_planted_groups():
    src, dst, members, *_ = planted()
    a = (partition.adjacency(100, src, dst) > 0).astype(float)
    main = np.abs(members).argmax(1)
    u, v = np.nonzero(np.triu(a[:30, :30]))
    for labels in (studies.fast_greedy(a), studies.leading_eigenvector(a), studies.walk_clusters(a, 3)):
        assert studies.rand_index(main, labels) > 0.5
        assert studies.modularity(a, labels) > 0.2
    assert studies.modularity(a[:30, :30], studies.edge_betweenness(30, u, v)) > 0.1


def test_linkage_surprise_and_power_law():
    p = np.array([0.0, 0.1, 0.2, 5.0, 5.1])
    assert studies.linkage_cut(abs(p[:, None] - p), height=1.0).tolist() == [0, 0, 0, 1, 1]
    assert studies.rand_index(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 1.0
    # 3 of 3 edges inside, 2 of 6 pairs inside can't be; by hand: 4 nodes, 2 edges, 2 inner pairs, 2 inside
    assert abs(studies.surprise(4, 2, 2, 2) - np.log10(15)) < 1e-9
    r = np.random.default_rng(0)
    d = np.floor(0.5 + (1 - r.random(3000)) ** (-1 / 1.5) * 0.5 + 0.5)
    assert 2.0 < studies.power_law(d, draws=5)[0] < 3.2


def test_fuzzy_means():
    x = np.concatenate([np.zeros((10, 2)), np.full((10, 2), 5.0)]) + np.random.default_rng(0).normal(0, 0.1, (20, 2))
    u = studies.fuzzy_means(x, 2)
    assert abs(u.sum(1) - 1).max() < 1e-9 and len(set(u[:10].argmax(1))) == 1 and u[0].argmax() != u[-1].argmax()
