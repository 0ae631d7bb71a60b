import hashlib
import re

from corpus import frame, rows

from tideweave.llm import exact_dedup as X


def brute(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {(i, min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def got(spark, data, **more):
    out = X.digest_columns(X.exact_groups(frame(spark, data), **more)).collect()
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    return {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out}


def test_matches_brute_force(spark):
    assert got(spark, rows()) == brute(rows())


def test_many_small_memtables(spark):
    data = rows() + [(1000 + i, "the same text  here", "en", "s", 1, "", 0) for i in range(50)]
    assert got(spark, data, memtable_bytes=200, range_rows=5) == brute(data)


def test_colliding_digests_are_told_apart(spark):
    """Byte verification splits texts whose digests are equal."""
    weak = lambda b: bytes([len(b) % 2]) * 32
    data = [(i, t, "en", "s", 1, "", 0) for i, t in enumerate(["aa", "bb", "aa", "c", "d", "c", "bb"])]
    out = X.exact_groups(frame(spark, data).repartition(3), memtable_bytes=1, digest=weak).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(0, 0, 2), (2, 0, 2), (1, 1, 2), (6, 1, 2), (3, 3, 2), (5, 3, 2), (4, 4, 1)}


def test_repeated_rows_and_null_ids(spark):
    data = [(5, "a b", "", "", 0, "", 0)] * 3 + [(None, "a  b", "", "", 0, "", 0), (None, "z", "", "", 0, "", 0), (7, "z", "", "", 0, "", 0)]
    out = X.exact_groups(frame(spark, data).repartition(4), memtable_bytes=1).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size) for r in out) == [(-1, 5, 4), (-1, 7, 2), (5, 5, 4), (5, 5, 4), (5, 5, 4), (7, 7, 2)]
    assert sum(r.kept for r in out) == 2


def test_empty_table(spark):
    assert got(spark, []) == set()


def test_filter_has_no_false_negatives():
    import numpy as np

    d = np.array([hashlib.sha256(bytes([i])).digest() for i in range(200)], "V32")
    b = X.Bloom.of(d[:100])
    assert b.might_hold(d[:100]).all() and b.might_hold(d[100:]).mean() < 0.2
