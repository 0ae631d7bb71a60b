import zlib

import numpy as np
import pyarrow as pa
from corpus import frame, rows

from tideweave.llm import gru as G
from tideweave.llm import textcols as C
from tideweave.llm import toxicity as X


def texts(n, seed):
    r = np.random.default_rng(seed)
    plain = ["river", "stone", "walks", "green", "fields", "under", "morning", "of", "the"]
    out, y = [], (np.arange(n) % 3 == 0).astype(float)
    for k in range(n):
        w = list(r.choice(plain, r.integers(5, 120)))
        for _ in range(2 if y[k] else 0):
            w.insert(r.integers(0, len(w)), r.choice(["idiot", "moron", "Idiots!", "scum,"]))
        out.append(" ".join(w))
    return out, y


def test_gradients_match_differences():
    net = G.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, index, _ = X.prepared(C.column(pa.array(["the idiot walks a b c d " * 7, "x yy zzz"])))
    y = np.arange(len(index)) % 2

    def loss():
        s = net.scores(net.gates(net.inputs(words).astype(float)), index, len(words.slot))
        return float((np.log1p(np.exp(s)) - y * s).sum())

    x = net.inputs(words).astype(float)
    tape = {}
    s = net.scores(net.gates(x), index, len(words.slot), tape)
    g = net.gradients(words, x, index, G.sigmoid(s) - y, tape)
    for k in ("uf", "ub", "wf", "wb", "bf", "bb", "a", "v", "o", "c"):
        at = tuple(d // 2 for d in net.p[k].shape)
        net.p[k][at] += 1e-4
        up = loss()
        net.p[k][at] -= 2e-4
        down = loss()
        net.p[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-4, k


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        index, doc = G.windows(np.arange(n), np.array([0, n]), n)
        assert set(index.ravel().tolist()) - {n} == set(range(n))
        assert len(index) == len(G.window_starts(n)) and (doc == 0).all()


def test_held_out_accuracy():
    some, y = texts(240, 0)
    model = X.fit(pa.array(some), y, epochs=8)
    others, truth = texts(90, 1)
    words, index, doc = X.prepared(C.column(pa.array(others)))
    p = X.sigmoid(model.slope * X.highest(X.window_scores(model.net, words, index), doc, len(others)) + model.shift)
    assert ((p >= 0.5) == (truth > 0)).mean() > 0.93


def test_rows_folds_and_odd_tables(spark):
    some, y = texts(60, 2)
    data = [(i, t, "en", "s", 1, "", 0) for i, t in enumerate(some)] + [(1000 + r[0], *r[1:]) for r in rows()] + [(None, "x", "", "", 0, "", 0)]
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = X.toxicity(frame(spark, data), labels, epochs=3).collect()
    assert len(got) == len(data)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.toxicity(frame(spark, []), empty).collect() == []
    assert len({r.score for r in X.toxicity(frame(spark), empty).collect()}) == 1
