import re

from corpus import SCHEMA, frame, rows

import corpus_pipeline
from tideweave.llm import exact_dedup, jaccard, mixing, quality

from test_jaccard import brute as near


def write(spark, folder, data):
    frame(spark, data).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages_against_brute_force(spark, tmp_path):
    """Without labels the classifier keeps all; the rest is recomputed in plain Python."""
    data = rows() + [(500 + i, rows()[3 * i][1], "en", "s2", 1, "d", 2) for i in range(5)]
    folder = write(spark, tmp_path, data)
    docs = frame(spark, data)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        got[name] = docs.collect()
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    left = [r for r in data if len(words(r[1])) >= 50 and repeated(words(r[1])) * 100 <= 50 * len(words(r[1]))]
    assert sorted(r.doc_id for r in got["quality rules"]) == sorted(r[0] for r in left)
    first = {}
    for r in sorted(left):
        first.setdefault(norm(r[1]), r)
    assert sorted(r.doc_id for r in got["exact dedup"]) == sorted(r[0] for r in first.values())
    of = {i: c for i, _, c in near([(r[0], r[1]) for r in first.values()])}
    assert sorted(r.doc_id for r in got["n-gram Jaccard join"]) == sorted(i for i, c in of.items() if i == c)
    stayed = [r for r in got["n-gram Jaccard join"]]
    want = mixing.mix(spark.createDataFrame(stayed, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got["mixing sources to target weights"]) == sorted(r.doc_id for r in want for _ in range(r.copies))
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in got["mixing sources to target weights"])
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in out)


def repeated(w):
    at = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + j for i, x in enumerate(at) if at.count(x) > 1 for j in range(3)})


def test_empty_and_repeated_rows(spark, tmp_path):
    folder = write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).collect() == []
    many = [(1, "a b c " * 30, "en", "s", 1, "x", 0)] * 3 + [(None, "d e f g", None, None, None, None, None)]
    docs = frame(spark, many)
    assert exact_dedup.keep_first(docs).count() == 2
    assert jaccard.keep_one(docs).count() == 4  # rows of one identifier stay together
    assert mixing.take(docs).count() == sum(r.copies for r in mixing.mix(docs).collect())
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 0  # repeated words, or too few


CLASHES = ["_id", "_size", "_own", "_k", "_source", "_digest", "id", "row", "own", "turn", "size", "copies", "rows", "maybe", "word", "bits", "stays", "kept", "component_id", "source_key"]


def test_stages_take_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    data = rows() + [rows()[0], rows()[0], (None, "a null identifier", None, None, None, None, None)]
    plain = frame(spark, data)
    clash = plain.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASHES))
    for stage in (exact_dedup.keep_first, jaccard.keep_one, mixing.take):
        got, want = stage(clash), stage(plain)
        assert got.columns == clash.columns
        got = got.collect()
        assert all(r[c] == f"{c}!" for r in got for c in CLASHES)
        assert sorted(str(r[:7]) for r in got) == sorted(str(tuple(r)) for r in want.collect())


def test_ties_are_settled_by_the_other_columns(spark):
    data = [(1, "a b c", "en", "s", 1, f"d{k}", k) for k in range(6)] + [(2, "a  b c", "en", "s", 1, "x", 0)]
    runs = [[tuple(r) for r in exact_dedup.keep_first(frame(spark, d).repartition(3)).collect()] for d in (data, data[::-1])]
    assert len(runs[0]) == 1 and runs[0] == runs[1]
    taken = [sorted(tuple(r) for r in mixing.take(frame(spark, d).repartition(3)).collect()) for d in (data, data[::-1])]
    assert taken[0] == taken[1]
