import signal
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest

from tideweave.operators import studies
from tideweave.plans import QUERIES


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


def by_table(p: np.ndarray, height: float) -> np.ndarray:
    return studies.linkage_cut(np.sqrt(((p[:, None] - p) ** 2).sum(-1)), height=height)


def clouds():
    r = np.random.default_rng(3)
    yield "none", np.zeros((0, 2))
    yield "one", np.array([[3.0, -2.0]])
    yield "copies", np.tile([[0.5, 0.25]], (40, 1))
    yield "normal", r.normal(0, 0.125, (400, 2))
    yield "floats", r.normal(0, 0.125, (400, 2)).astype(np.float32).astype(float)
    yield "copies among others", r.normal(0, 0.125, (120, 2))[r.integers(0, 120, 400)]
    yield "grid with ties", r.permutation(np.stack(np.meshgrid(np.arange(18), np.arange(18)), -1).reshape(-1, 2) / 16.0)
    yield "grid with ties and copies", r.integers(-6, 7, (350, 2)) / 16.0
    yield "line", np.column_stack([r.permutation(300) / 64.0, np.zeros(300)])
    yield "scales", np.concatenate([r.normal(0, s, (80, 2)) for s in (1e-9, 1e-5, 1e-2, 1.0, 1e3)])
    yield "far away", np.concatenate([r.normal(1e6, 0.2, (150, 2)), r.normal(-1e6, 0.2, (150, 2))])
    yield "outlier", np.concatenate([r.normal(0, 0.125, (200, 2)), [[1e12, 1e12], [1e12, -3.0], [1e12 + 0.001, 1e12]]])
    yield "slanted line", np.column_stack([x := r.random(300) * 2, x])
    yield "small ring", np.column_stack([np.cos(t := r.random(200) * 7), np.sin(t)]) * 0.1
    yield "ring", np.column_stack([np.cos(t := r.random(300) * 7), np.sin(t)]) * 0.3


@pytest.mark.parametrize("height", [0.03, 0.2, 0.25, 3.0])
def test_points_are_grouped_as_by_the_table_of_distances(height):
    for name, p in clouds():
        want = by_table(p, height) if len(p) else np.zeros(0, int)
        assert studies.linkage_points(p, height).tolist() == want.tolist(), name


def test_many_points_are_grouped_without_the_table():
    p = np.random.default_rng(4).normal(0, 0.125, (8000, 2))
    with within(20):
        labels = studies.linkage_points(p, 0.2)
    q = pd.DataFrame(p).groupby(labels)
    corners = [x.to_numpy() for _, x in q]
    wide = [np.sqrt(((x[:, None] - x) ** 2).sum(-1)).max() for x in corners]
    assert max(wide) <= 0.2
    for i, x in enumerate(corners):  # no two could still be joined
        assert all(np.sqrt(((x[:, None] - y) ** 2).sum(-1)).max() > 0.2 for y in corners[:i])


def test_point_clusters_with_missing_coordinates(spark, tmp_path):
    points = [(4, [0.0, 0.0], 1), (2, [0.1, 0.0], 1), (3, [5.0, 5.0], 1), (9, None, 1), (8, [float("nan"), 1.0], 1), (7, [None, 1.0], 2), (6, [1.0, 1.0], 2), (5, [1.0, 1.0], None)]
    spark.createDataFrame(points, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {x["vec_id"]: (x["label"], x["cluster"], x["cx"], x["cy"]) for x in QUERIES["point_clusters"](spark, str(tmp_path)).collect()}
    assert got == {
        2: (1, 0, 0.05, 0.0), 4: (1, 0, 0.05, 0.0), 3: (1, 1, 5.0, 5.0), 9: (1, None, None, None), 8: (1, None, None, None),
        7: (2, None, None, None), 6: (2, 0, 1.0, 1.0), 5: (None, 0, 1.0, 1.0),
    }
