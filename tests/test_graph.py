from collections import deque

import numpy as np

from tideweave.operators import graph, paths

EDGES = [(1, 2, 1.0), (1, 3, 2.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 5.0), (6, 7, 1.0)]


def frame(spark, edges=EDGES):
    return spark.createDataFrame(edges, "src int, dst int, weight double")


def test_triangles_and_clustering(spark):
    e = frame(spark)
    assert {tuple(r) for r in graph.triangles(e).collect()} == {(1, 2, 3), (4, 5, 6)}
    local = {r.node: r.clustering for r in graph.local_clustering(e).collect()}
    assert local[1] == 1.0 and abs(local[3] - 1 / 3) < 1e-12 and local[7] is None


def test_hops(spark):
    e = frame(spark)
    got = {(r.source, r.node): r.hops for r in paths.hops(e, spark.createDataFrame([(1,)], "node int")).collect()}
    near = {}
    for a, b, _ in EDGES:
        near.setdefault(a, []).append(b)
    want, queue = {1: 0}, deque([1])
    while queue:
        u = queue.popleft()
        for v in near.get(u, []):
            if v not in want:
                want[v] = want[u] + 1
                queue.append(v)
    assert got == {(1, v): k for v, k in want.items()}


def test_weighted_paths_and_contraction(spark):
    e, targets = frame(spark), spark.createDataFrame([(1,), (4,), (7,)], "node int")
    got = {(r.source, r.node): (r.distance, r.path) for r in paths.distances(e, targets).collect()}
    assert got[1, 7] == (6.0, [1, 2, 3, 4, 5, 6, 7]) or got[1, 7] == (6.0, [1, 3, 4, 5, 6, 7])
    assert got[4, 6][0] == 2.0
    assert {tuple(r) for r in paths.contracted(e, targets).collect()} == {(1, 4, 3.0), (4, 7, 3.0)}


def test_core_numbers(spark):
    got = {r.node: r.core for r in paths.k_core(frame(spark)).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1}


def test_page_rank_sums_to_one_and_matches_numpy(spark):
    got = {r.node: r["rank"] for r in paths.pagerank(frame(spark), rounds=30).collect()}
    n, at = 7, {v: i for i, v in enumerate(range(1, 8))}
    m = np.zeros((n, n))
    for a, b, w in EDGES:
        m[at[b], at[a]] = w
    out = m.sum(0)
    x = np.full(n, 1 / n)
    for _ in range(30):
        x = 0.15 / n + 0.85 * (m @ np.divide(x, out, out=np.zeros(n), where=out > 0) + x[out == 0].sum() / n)
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[v] - x[at[v]]) < 1e-9 for v in got)


def test_consecutive_places_and_bridges(spark):
    rows = [("r", p, m) for p, ms in (("a", [1, 2, 9]), ("b", [5]), ("c", [20])) for m in ms]
    got = graph.consecutive_places(spark.createDataFrame(rows, "road string, place string, milepost int"))
    assert {tuple(r) for r in got.collect()} == {("a", "b"), ("b", "c")}
    star = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (3, 4)], "src int, dst int")
    bridged = graph.bridge_removed(star, spark.createDataFrame([(0,)], "node int"))
    assert {tuple(r) for r in bridged.collect()} == {(1, 2), (1, 3), (2, 3), (3, 4)}


def test_label_propagation_stays_in_parts(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (10, 11), (11, 12), (10, 12)], "src int, dst int")
    got = {r.node: r.label for r in paths.label_propagation(e).collect()}
    assert {got[k] for k in (1, 2, 3)}.isdisjoint({got[k] for k in (10, 11, 12)})


def test_connected_parts(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src int, dst int")
    got = {r.node: r.label for r in paths.connected(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_omega_by_run(spark):
    from tideweave.operators import quality

    truth = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "node int, community string")
    runs = {"same": [(i, "xy"[i % 2]) for i in range(6)], "half": [(i, "xy"[i // 3]) for i in range(6)], "empty": []}
    found = spark.createDataFrame([(k, *x) for k, v in runs.items() for x in v], "run string, node int, community string")
    nodes = spark.createDataFrame([(k, i) for k in runs for i in range(6)], "run string, node int")
    got = {r.run: r for r in quality.omega(truth, found, nodes, ("run",)).collect()}
    assert set(got) == set(runs) and got["same"].omega == 1
    for k in runs:
        one = quality.omega(truth, found.filter(f"run = '{k}'"), truth.select("node")).first()
        assert [round(got[k][c], 9) for c in ("observed", "expected", "omega")] == [round(one[c], 9) for c in ("observed", "expected", "omega")]
