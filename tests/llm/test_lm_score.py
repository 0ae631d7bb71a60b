import math
import re
import zlib
from collections import Counter

import numpy as np
from corpus import frame, rows
from plain_mixer import COMMON, Mixer, parts_of
from pyspark.sql import functions as F

from tideweave.llm import bit_mixer as M
from tideweave.llm import lm_score as L


def tokens(t):
    return [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check(spark, data, **more):
    got = L.scores(frame(spark, data).repartition(3), **more).collect()
    c = Counter()
    for i, t, *_ in data:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or 0, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, *_ in data)
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    return got


def test_counts_and_base_score(spark):
    check(spark, rows() + [rows()[0], (None, "null id", "", "", 0, "", 0)])


def test_many_slices(spark):
    check(spark, rows(), slice_bytes=500)


def test_long_words(spark):
    check(spark, [(1, "a" * 300_000, "", "", 0, "", 0), (2, "a b " + "qx7" * 40_000, "", "", 0, "", 0), (3, "a b", "", "", 0, "", 0)])


def test_odd_tables(spark):
    assert L.scores(frame(spark, [])).collect() == []
    check(spark, [(i, None, "", "", 0, "", 0) for i in range(3)])
    only_held = next(i for i in range(100) if held(i))
    check(spark, [(only_held, "some words", "", "", 0, "", 0)])


TEXTS = [t for _, t, *_ in rows(25) if t is not None and len(t) < 5000] + ["Zürich 42, the RIVER \x00 x", "\n\n"]


def compiled(spark, model, texts):
    f = M.scorer(spark, model)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    return [np.frombuffer(r.p, "<f4") for r in df.select("i", f(F.col("text").cast("binary")).alias("p")).orderBy("i").collect()]


def test_equals_a_plain_mixer(spark):
    plain = Mixer()
    learnt = [plain.code(t, learn=True) for t in TEXTS]
    assert any(x < 0 for t in learnt for x in t)
    model = M.learn(spark.createDataFrame([(t,) for t in TEXTS], "text string").coalesce(1))
    for t, got in zip(TEXTS, compiled(spark, model, TEXTS)):
        want = plain.code(t)
        assert len(want) == len(got) == len(tokens(t))
        assert np.allclose(got, want, rtol=0.01, atol=0.01), t
    # without a word of training
    for t, got in zip(TEXTS[:5], compiled(spark, M.learn(spark.createDataFrame([], "text string")), TEXTS[:5])):
        assert np.allclose(got, Mixer().code(t), rtol=0.01, atol=0.01)


def test_the_score_blends_tokens_of_the_mixer_with_counts(spark):
    data = [(i, t, "", "", 0, "", 0) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r.score for r in L.scores(frame(spark, data).coalesce(1)).collect()}
    plain, c = Mixer(), Counter()
    for i, t in enumerate(TEXTS):
        if not held(i):
            plain.code(t, learn=True)
            c.update(tokens(t))
    n = sum(c.values())
    for i, t in enumerate(TEXTS):
        p = 10 ** np.array(plain.code(t))
        q = np.array([c[w] / n for w in tokens(t)])
        tries = [np.log10(s * q + (1 - s) * p).sum() for s in L.SHARES]
        want = max(tries) + math.log10(np.mean([10 ** (x - max(tries)) for x in tries]))
        assert abs(got[i] - want) < 0.01 * abs(want) + 0.05


def test_order_of_words_counts_and_models_add_up(spark):
    df = frame(spark)
    one, many = M.learn(df.coalesce(1)), M.learn(df.repartition(20, "doc_id"))
    assert many == M.learn(df.repartition(20, "doc_id"))
    text = "the river stone walks of the river and the data of the river stone"
    mixed = " ".join(sorted(text.split(), key=lambda w: w[::-1]))
    for model in (one, many):
        a, b = (x.sum() for x in compiled(spark, model, [text, mixed]))
        assert abs(a - b) > 0.01
    known, strange = (x.sum() for x in compiled(spark, many, ["the river walks of data", "qhe zivxr wjlks kf dqtx"]))
    assert known > strange + 3


def test_a_byte_s_probabilities_sum_to_one():
    plain = Mixer()
    plain.code("the river walks of the data" * 30, learn=True)
    context = [context * 3 for context in range(4)]

    def chance(parts):
        p, w, r, own = 1.0, [x[:] for x in plain.weight], [x[:] for x in plain.refine], {}
        for part in parts:
            p *= plain.part(part, context, w, r, own, False)
        return p

    escaped = lambda c: [(15, 4, 0, 0), (c >> 4, 4, 15, 48), (c & 15, 4, 16 + (c >> 4), 64 + (c & 0xF0))]
    # the long code of a byte that has a short one is never used
    wasted = sum(chance(escaped(c)) for c in COMMON)
    assert abs(sum(chance(parts_of(c)) for c in range(256)) + wasted - 1) < 1e-9


def test_small_integers_round_trip():
    for values in ([], [0], [255], [256, 1], [70000], [1 << 33]):
        assert L.read_int(L.small_int(np.array(values, np.int64))).tolist() == values
