"""Cover agreement and the like, by hand and by brute force."""

import itertools
import random

import pytest

from tideweave.operators import overlap as O


def covers(spark, seed=1):
    r = random.Random(seed)
    rows = lambda: [(n, c) for n in range(20) for c in "abcd" if r.random() < 0.3]
    one, two = rows(), rows()
    df = lambda x: spark.createDataFrame(x, "node int, community string")
    return one, two, df(one), df(two), spark.createDataFrame([(n,) for n in range(22)], "node int")


def of(rows, n):
    return {c for k, c in rows if k == n}


def test_agreement_of_covers(spark):
    one, two, a, b, nodes = covers(spark)
    pairs = [(len(of(one, u) & of(one, v)), len(of(two, u) & of(two, v)), u == v) for u, v in itertools.product(range(22), repeat=2)]
    assert O.match_ratio(a, b, nodes).first().ratio == pytest.approx(sum(j == k for j, k, _ in pairs) / 22**2)
    other = [(j > 0, k > 0) for j, k, same in pairs if not same]
    n, same, p, q = len(other), sum(j == k for j, k in other), sum(j for j, _ in other), sum(k for _, k in other)
    chance = p * q / n**2 + (1 - p / n) * (1 - q / n)
    got = O.binary_omega(a, b, nodes).first()
    assert got.agreement == pytest.approx(same / n) and got.expected == pytest.approx(chance)
    assert got.omega == pytest.approx(max(0, min(1, (same / n - chance) / (1 - chance))))
    assert O.binary_omega(a, a, nodes).first().omega == 1 and O.cosine(a, a).first().cosine == pytest.approx(1)


def test_conductance_and_permanence_by_hand(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    found = spark.createDataFrame([(1, "a"), (2, "a")], "node int, community string")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "node int, community string")
    got = O.weighted_conductance(edges, found, truth).first()
    assert (got.boundary, got.volume) == (1.5, 2 + 2 * 1.5) and got.conductance == pytest.approx(1.5 / min(5, 6 - 5))
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "node int, label string")
    assert {r.node: r.permanence for r in O.permanence(edges, labels).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_ladder_union_labels_and_natural_join(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 1, 12.0), (2, 3, 10.0), (4, 5, 99.0)], "src int, dst int, dist double")
    assert [tuple(r) for r in O.ladder(edges, 5, 20).orderBy("rung").collect()] == [(5, 1, 2), (10, 2, 3), (15, 2, 3), (20, 2, 3)]
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "node int, community string")
    assert sorted(tuple(r) for r in O.disjoint_union(edges.filter("dist <= 10"), members).collect()) == [("a", "1_a", "2_a"), ("b", "2_b", "3_b")]
    for n in (4, 5, 60):
        got = [r.label for r in O.group_labels(spark.range(n).toDF("node"), ["x", "y"]).collect()]
        assert len(got) == n and got.count("x") >= 2 and got.count("y") >= 2
    left, right = spark.createDataFrame([(1, "p", 7), (2, "q", 8)], "k int, name string, v int"), spark.createDataFrame([(1, "p", True)], "k int, name string, w boolean")
    assert sorted(map(tuple, O.natural_left_join(left, right).select("k", "v", "w").collect())) == [(1, 7, True), (2, 8, None)]
    with pytest.raises(ValueError):
        O.natural_left_join(left, right.toDF("a", "b", "c"))
