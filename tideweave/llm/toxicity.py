"""Toxicity of texts by a recurrent network over all overlapping windows of words.

The network (gru.py) learns from a bounded sample of labelled rows.  Labels belong to texts, so a
text labelled toxic first teaches all its windows and then the ones that score highest, and any other
text the windows that score highest and some more.  A text's score is its highest window's, turned
into a probability on texts that the network has not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as C
from .gru import Network, Trainer, Words, windows, words_of
from .linear import platt, sigmoid
from .shared import bounded_batches, give_back, tidy

#: Labelled rows (toxic, others) that the network may learn from: those with the smallest hashes.
TRAIN_ROWS = (1500, 2500)
#: Longer texts are not learnt from; they are judged like all others.
TRAIN_TEXT_BYTES = 1 << 18
#: One of so many parts of the rows, by crc32 of the identifier as text, is never learnt from.
FOLDS, HELD_OUT = 5, 0
EPOCHS = 14
CHUNK = 4096
#: Raw score of a text without words.
NOTHING = -12.0


@dataclass
class Model:
    net: Network
    slope: float = 1.0
    shift: float = 0.0


def prepared(col: C.Column) -> tuple[Words, np.ndarray, np.ndarray]:
    """Different words of the texts, windows of word numbers, and the windows' texts."""
    found = C.segments(col, lower=True)
    codes, unique = pd.factorize(found.hash)
    first = np.empty(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    words = words_of(C.LOWER[col.data], found.start[first], found.end[first], unique)
    return words, *windows(codes, found.first, len(unique))


def window_scores(net: Network, words: Words, index: np.ndarray) -> np.ndarray:
    gates = net.gates(net.inputs(words))
    parts = [net.scores(gates, index[at : at + CHUNK], len(words.slot)) for at in range(0, len(index), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def highest(scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NOTHING)
    np.maximum.at(out, doc, scores.astype(np.float64))
    return out


def fit(texts: pa.Array, y: np.ndarray, share: float | None = None, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Train on four fifths of the texts and calibrate on the rest.

    ``share`` is class 1's share among all labelled rows, which probabilities are to follow.
    With fewer than 20 texts or one class only, every text has that class's smoothed share.
    """
    n = len(y)
    if n < 20 or y.min() == y.max():
        return Model(Network(), 0.0, float(np.log((y.sum() + 1) / (n - y.sum() + 1))))
    words, index, doc = prepared(C.column(texts))
    r = np.random.default_rng(seed)
    part = r.permutation(n)
    hold = np.zeros(n, bool)
    hold[part[: n // 5]] = True
    net = Network()
    trainer = Trainer(net)
    learn = ~hold[doc]
    row = np.arange(len(doc))
    for epoch in range(epochs):
        if epoch < 2:  # every window has its text's label; a few of each text
            order = r.permutation(row[learn])
            rank = pd.Series(doc[order]).groupby(doc[order]).cumcount().to_numpy()
            pick = order[rank < 6]
        else:
            s = window_scores(net, words, index)
            order = row[learn][np.lexsort((-s[learn], doc[learn]))]
            rank = pd.Series(doc[order]).groupby(doc[order]).cumcount().to_numpy()
            top = order[rank < np.where(y[doc[order]] > 0, 1, 3)]
            more = r.permutation(row[learn & (y[doc] == 0)])[: n // 2]
            pick = np.unique(np.concatenate([top, more]))
        pick = r.permutation(pick)
        half = np.clip(y[doc[pick]].mean(), 0.01, 0.99)
        weight = np.where(y[doc[pick]] > 0, 0.5 / half, 0.5 / (1 - half))
        for at in range(0, len(pick), 64):
            b = pick[at : at + 64]
            trainer.step(words, index[b], y[doc[b]], weight[at : at + 64])
    raw = highest(window_scores(net, words, index), doc, n)
    own = hold if 0 < y[hold].sum() < hold.sum() else np.ones(n, bool)
    m = y[own].mean()
    share = m if share is None else share
    return Model(net, *platt(raw[own], y[own], np.where(y[own] > 0, share / m, (1 - share) / (1 - m))))


def fold(id_col: Column) -> Column:
    """crc32 of the identifier as text; null counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS, epochs: int = EPOCHS) -> Model:
    """Fit on at most ``rows`` labelled texts (toxic, others) of at most TRAIN_TEXT_BYTES, none of them held out."""
    some = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id")) % FOLDS != HELD_OUT)
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = lambda k, most: some.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = of(1, rows[0]).unionByName(of(0, rows[1]))
    share = some.agg(F.avg("toxic")).first()[0]
    table = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    table = table.filter(F.octet_length("text") <= TRAIN_TEXT_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sum(rows)).toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    model = fit(table["text"].combine_chunks(), table["toxic"].to_numpy().astype(np.float64), share, epochs)
    del table
    give_back()
    return model


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: tuple[int, int] = TRAIN_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    Only the text decides a score.  A null text counts as empty; texts without words have one low
    score; repeated rows are scored each; an empty table gives an empty table; further columns are
    left out.  Null labels and labels without an identifier are not learnt from.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows, epochs))  # 4 MB, fixed

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            whole = C.column(batch.column(2))
            for lo, hi in C.slices(whole, C.WINDOW):
                words, index, doc = prepared(whole.part(lo, hi))
                raw = highest(window_scores(m.net, words, index), doc, hi - lo)
                p = sigmoid(m.slope * raw + m.shift)
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=_OUT.names)

    held = (fold(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(tidy(work), _OUT)
