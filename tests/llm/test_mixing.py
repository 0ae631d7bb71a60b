import duckdb
import pandas as pd
import pytest
from corpus import frame, rows

from tideweave.llm import mixing as M


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            open_.remove(s)
    return out


def corpus(seed=0):
    import random

    r = random.Random(seed)
    sizes = {"a": 4000, "b": 300, "c": 20, "d": 2500, None: 700}
    out, k = [], 0
    for s, n in sizes.items():
        for _ in range(n // 10):
            out.append((k := k + 1, "w " * max(0, int(r.gauss(10, 6))), "en", s, 1, "", 0))
    return out


def test_targets_and_words_taken(spark):
    data = corpus()
    got = M.mix(frame(spark, data)).toPandas()
    sizes = {s: int(g["size"].sum()) for s, g in got.assign(source=got.source.map(lambda s: "~" if s is None else s)).groupby("source")}
    sizes = {None if s == "~" else s: n for s, n in sizes.items()}
    want = water(sizes)
    for s, g in got.groupby(got.source.map(lambda s: "~" if s is None else s)):
        s = None if s == "~" else s
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= 2 * g["size"].max()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()


def test_matches_sql_and_reruns_agree(spark):
    documents = pd.DataFrame(corpus(1) + rows(), columns=["doc_id", "text", "lang", "source", "n_chars", "x", "y"])  # noqa: F841
    want = duckdb.sql(M.oracle_sql()).df()
    runs = [M.mix(frame(spark, corpus(1) + rows()).repartition(k)).select("doc_id", "size", "source_size", "target", "taken").toPandas() for k in (1, 5)]
    for got in runs:
        assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_taking_repeats_rows(spark):
    data = corpus(2)
    copies = {r.doc_id: r.copies for r in M.mix(frame(spark, data)).collect()}
    got = M.take(frame(spark, data)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {i: n for i, n in copies.items() if n}


def test_empty_and_wordless(spark):
    assert M.mix(frame(spark, [])).collect() == []
    got = M.mix(frame(spark, [(1, None, "", "s", 0, "", 0), (None, " ", "", None, 0, "", 0)])).collect()
    assert all(r.taken == 0 and r.size == 0 for r in got) and len(got) == 2
