import signal
from contextlib import contextmanager

import numpy as np
import pytest

from tideweave.operators import pareto


@contextmanager
def within(seconds: float):
    def stop(*_):
        raise TimeoutError(f"took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def peeled(p: np.ndarray) -> list[int]:
    """Fronts by comparing all pairs, again and again."""
    out, k = np.zeros(len(p), int), 0
    worse = (p[:, None] <= p).all(-1) & (p[:, None] < p).any(-1)  # [i, j]: i dominates j
    while (out == 0).any():
        k += 1
        left = out == 0
        out[left & ~worse[left].any(0)] = k
    return out.tolist()


@pytest.mark.parametrize("objectives", [1, 2, 3, 4])
def test_fronts_equal_those_of_all_pairs(objectives):
    r = np.random.default_rng(objectives)
    for n, levels in ((0, 1), (1, 1), (150, 4), (150, 12), (200, 10**6)):
        p = r.integers(0, levels, (n, objectives)).astype(float)
        assert pareto.front_numbers(p).tolist() == peeled(p)


def test_fronts_of_a_large_group_take_a_search_a_point():
    r = np.random.default_rng(1)
    few = np.column_stack([r.integers(0, 1000, 800), r.integers(1, 51, 800)]).astype(float)
    want = peeled(few)
    with within(10):
        assert pareto.front_numbers(np.tile(few, (60, 1))).tolist() == want * 60
        number = pareto.front_numbers(np.column_stack([np.arange(30_000.0), np.zeros(30_000)]))
        assert number.tolist() == list(range(1, 30_001))
        assert pareto.front_numbers(np.column_stack([np.arange(30_000.0), -np.arange(30_000.0)])).max() == 1


@pytest.mark.parametrize("objectives", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_fronts_by_group(spark, objectives):
    r = np.random.default_rng(5)
    values = [None, float("nan"), -0.0, 0.0, 1.0, 2.0, 3.5, float("inf")]
    groups = [None, float("nan"), 1.0, 2.0]
    some = lambda v: v[r.integers(len(v))]
    data = [(i, some(groups), some(values), some(values), some(values)) for i in range(400)]
    rows = spark.createDataFrame(data, "run int, g double, x double, y double, z double").repartition(7)
    out = pareto.fronts(rows, ["g"], objectives)
    assert out.columns == ["run", "g", "x", "y", "z", "front"] and out.schema["front"].dataType.simpleString() == "int"
    got = {x["run"]: x["front"] for x in out.collect()}
    assert len(got) == out.count() == 400
    place = [2 + "xyz".index(c) for c in objectives]
    for g in groups:
        own = [x for x in data if str(x[1]) == str(g)]
        whole = [x for x in own if all(x[c] is not None and x[c] == x[c] for c in place)]
        want = dict(zip((x[0] for x in whole), peeled(np.array([[x[c] for c in place] for x in whole]))))
        assert {x[0]: got[x[0]] for x in own} == {x[0]: want.get(x[0]) for x in own}
