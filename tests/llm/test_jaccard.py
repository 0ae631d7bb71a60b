import random
import re

import pytest
from corpus import frame, rows

from tideweave.llm import components
from tideweave.llm import jaccard as J


def brute(data, width=5, num=75, den=100):
    sets = []
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[root(k)] = min(low.get(root(k), i), i)
    return [(i, len(s), low[root(k)]) for k, (i, s) in enumerate(sets)]


def got(spark, data, **more):
    full = [(i, t, "en", "s", 1, "d", 0) for i, t in data]
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(frame(spark, full).repartition(3), **more).collect())


def noisy(seed, groups=6, copies=8, size=60):
    """Groups of copies with more and more changed words, so links form chains."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, k = [], 0
    common = [r.choice(vocabulary) for _ in range(12)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(size)] + common * r.randint(0, 2)
        for _ in range(copies):
            base = list(base)
            for _ in range(r.randint(0, 2)):
                base[r.randrange(len(base))] = r.choice(vocabulary)
            out.append((k := k + 1, " ".join(base)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    data = noisy(seed)
    assert got(spark, data, fragment_grams=500) == sorted(brute(data))


def test_odd_texts(spark):
    data = [(r[0], r[1]) for r in rows()]
    assert got(spark, data) == sorted(brute(data))


def test_other_width_and_similarity(spark):
    data = noisy(9)
    assert got(spark, data, width=3, similar=(1, 2)) == sorted(brute(data, 3, 1, 2))


def test_nulls_repeats_and_empty_table(spark):
    data = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (10, "")]
    out = J.near_duplicates(frame(spark, [(i, t, "", "", 0, "", 0) for i, t in data])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in out) == [(-1, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9), (10, 0, 10)]
    assert got(spark, []) == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    found = {r.node: r.label for r in components.components(links).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == 100
