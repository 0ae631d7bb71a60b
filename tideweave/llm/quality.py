"""Quality rules: fixed counts and a trained classifier of hashed word and character n-grams.

The classifier is a logistic regression over hashed words, word pairs and four-byte windows, each
kind as shares that sum to one in a text.  It learns from a bounded sample of labelled rows, is
calibrated on rows it has not learnt from, and scores whole texts in Arrow batches.  A text is kept
if no base rule rejects it and its probability of good quality reaches a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as C
from .linear import Linear, Rows, fit
from .shared import bounded_batches, give_back, tidy

BITS = 18
#: Labelled rows that the classifier may learn from: those with the smallest hashes of doc_id.
TRAIN_ROWS = 2500
#: Longer texts are not learnt from; they are judged like all others.
TRAIN_TEXT_BYTES = 1 << 18
#: Least calibrated probability of good quality.
THRESHOLD = 0.5
#: Base rules: fewer words, or a larger share of words in repeated windows, reject.
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LENGTH = 1 << BITS


def counts(col: C.Column, words: C.Segments) -> dict[str, np.ndarray]:
    """Base counts of each text."""
    lead = (col.data & 0xC0) != 0x80  # first bytes of code points
    n_words = np.diff(words.first)
    keys, place = C.windows(words, 3)
    doc = words.doc()
    twice, _ = C.repeated(keys, doc[place])
    covered = np.zeros(len(words) + 2, bool)
    for j in range(3):
        covered[place[twice] + j] = True
    lines = C.segments(col, C.IS_NEWLINE)
    inside = np.concatenate([[0], np.cumsum(~C.IS_SPACE[col.data])])
    worded = np.flatnonzero(inside[lines.end] > inside[lines.start])
    line_doc = lines.doc()[worded]
    _, later = C.repeated(lines.hash[worded], line_doc)
    return {
        "n_words": n_words,
        "word_chars": C.sums(lead & ~C.IS_SPACE[col.data], col.offsets),
        "n_symbols": C.sums(IS_SYMBOL[col.data], col.offsets),
        "n_dup_lines": np.bincount(line_doc[later], minlength=len(col)),
        "n_repeat_words": C.sums(covered[: len(words)], words.first),
    }


def _word_slots(words: C.Segments) -> tuple[np.ndarray, np.ndarray]:
    """Slots of words and of word pairs, and the texts of the pairs."""
    pairs, place = C.windows(words, 2)
    return (words.hash >> np.uint64(64 - BITS)).astype(np.int32), (pairs >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(place, words.first)


def _char_slots(col: C.Column) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all four-byte windows within one text, and where each text's begin."""
    n = len(col.data) - 3
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(len(col) + 1, np.int64)
    b = col.data.astype(np.uint32)
    key = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2] << np.uint32(16) | b[3:] << np.uint32(24)
    slot = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    ok = np.ones(n, bool)
    for j in (1, 2, 3):  # windows that reach into the next text
        at = col.offsets[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    run = np.concatenate([[0], np.cumsum(ok)])
    return slot[ok], run[np.minimum(col.offsets, n)]


def scores(model: Linear, col: C.Column, words: C.Segments) -> np.ndarray:
    """Raw score of each text: mean weight of its words, of its pairs and of its windows."""
    slots, pairs, pair_first = _word_slots(words)
    chars, char_first = _char_slots(col)
    out = np.full(len(col), model.bias)
    for s, first in ((slots, words.first), (pairs, pair_first), (chars, char_first)):
        out += C.sums(model.weights[s].astype(np.float64), first) / np.maximum(np.diff(first), 1)
    return out


def features(texts: pa.Array) -> Rows:
    """The same features as sparse rows, for training."""
    idx, val, n = [], [], []
    col = C.column(texts)
    for i in range(len(col)):
        one = col.part(i, i + 1)
        words = C.segments(one)
        slots, pairs, _ = _word_slots(words)
        chars, _ = _char_slots(one)
        parts = [np.unique(s, return_counts=True) for s in (slots, pairs, chars)]
        idx += [p[0] for p in parts]
        val += [(p[1] / max(p[1].sum(), 1)).astype(np.float32) for p in parts]
        n.append(sum(len(p[0]) for p in parts))
    empty = [np.zeros(0, np.int32)]
    return Rows(np.concatenate(idx or empty), np.concatenate(val or [np.zeros(0, np.float32)]), np.concatenate([[0], np.cumsum(n, dtype=np.int64)]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Linear:
    """Fit on at most ``rows`` labelled documents of at most TRAIN_TEXT_BYTES; labels has doc_id and quality (0 or 1)."""
    some = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    table = docs.join(F.broadcast(some), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    table = table.filter(F.octet_length("text") <= TRAIN_TEXT_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    model = fit(features(table["text"].combine_chunks()), table["quality"].to_numpy().astype(np.float64), _LENGTH)
    del table
    give_back()
    return model


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def verdicts(model: Linear, col: C.Column) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts, whether a base rule rejects, and the probability of good quality of each text."""
    words = C.segments(col)
    c = counts(col, words)
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    return c, failed, model.probability(scores(model, col, words))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, counts, base_failed, probability, kept.

    A null text has no words and fails; repeated rows are judged each; an empty table gives an empty
    table; further columns are left out.  Without labelled rows, or with one class only, every text
    has the same probability.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))  # 1 MB, fixed

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = C.column(batch.column(1))
            for lo, hi in C.slices(whole):
                c, failed, p = verdicts(model.value, whole.part(lo, hi))
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(c[x], pa.int64()) for x in SCHEMA.names[1:6]), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)

    return docs.mapInArrow(tidy(work), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows of ``docs``, all columns, that :func:`judge` keeps; nothing is joined or shuffled."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels, train_rows))
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = C.column(batch.column(at))
            for lo, hi in C.slices(whole):
                _, failed, p = verdicts(model.value, whole.part(lo, hi))
                yield batch.slice(lo, hi - lo).filter(pa.array(~failed & (p >= threshold)))

    return docs.mapInArrow(tidy(work), docs.schema)
