import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tideweave.llm import quality as Q
from tideweave.llm import textcols as C
from tideweave.llm.linear import fit, platt


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(at)
    covered = {i + j for i, x in enumerate(at) if n[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def counted(texts):
    col = C.column(pa.array(texts, pa.string()))
    c = Q.counts(col, C.segments(col))
    return list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|. \x0b ", max_size=60)), max_size=8))
def test_counts_match_brute_force(texts):
    assert counted(texts) == [brute(t) for t in texts]


def test_every_row_and_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    data = rows() + [rows()[0]]
    got = Q.judge(frame(spark, data), labels).collect()
    want = sorted((r[0], *brute(r[1])) for r in data)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert all(not r.kept for r in got if r.base_failed)
    assert Q.judge(frame(spark, []), labels).collect() == []


@pytest.fixture(scope="module")
def classes():
    r = np.random.default_rng(0)
    good = [" ".join(r.choice(["river", "stone", "walk", "green", "field"], 60)) for _ in range(120)]
    bad = [" ".join(r.choice(["BUY", "NOW!!", "$$$", "click", "river"], 60)) for _ in range(120)]
    return good + bad, np.array([1.0] * 120 + [0.0] * 120)


def test_classifier_separates_and_calibrates(classes):
    texts, y = classes
    order = np.random.default_rng(1).permutation(len(texts))
    learn, held = order[:160], order[160:]
    model = fit(Q.features(pa.array([texts[i] for i in learn])), y[learn], 1 << Q.BITS)
    col = C.column(pa.array([texts[i] for i in held]))
    p = model.probability(Q.scores(model, col, C.segments(col)))
    assert ((p >= 0.5) == (y[held] > 0)).mean() > 0.97


def test_training_and_batch_scores_agree(classes):
    texts, y = classes
    model = fit(Q.features(pa.array(texts)), y, 1 << Q.BITS, epochs=2)
    col = C.column(pa.array(texts[:20]))
    assert np.allclose(model.raw(Q.features(pa.array(texts[:20]))), Q.scores(model, col, C.segments(col)), atol=1e-4)


def test_calibration_of_separated_scores_is_finite():
    a, b = platt(np.array([-5.0, -4, 4, 5] * 10), np.array([0.0, 0, 1, 1] * 10))
    assert 0 < a < 10 and abs(b) < 10
