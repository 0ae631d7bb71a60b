"""Language-model scores of all texts: context mixing over the bits of texts, and word counts.

1. The context mixer (bit_mixer) learns from all texts that are not held out, online.
2. It codes every text, which gives each token a probability behind all that stands before it.
   Each slice of the input becomes a row of the shared folder: its different words with the counts of
   learnt-from texts, and the tokens in order with their probabilities.
3. Words are counted over all slices: one row for each word and slice, dealt by the word.  The table of
   counts grows with the corpus and is never collected or broadcast; each slice gets its words' counts.
4. A token's probability is a blend of the mixer's and the word's share of all training tokens.  A text
   tries several shares of the blend, and its probability is the mean over them, so it settles on the
   share that suits it (SHARES); each is a distribution over texts, and so is the mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bit_mixer
from . import textcols as C
from .shared import bounded_batches, kept, tidy

#: One of so many parts of the rows, by crc32 of the identifier as text, is never learnt from.
FOLDS, HELD_OUT = 7, 2
SLICE_BYTES = 16 << 20
#: Parts of a token's probability that come from the word's count.
SHARES = (0.0, 0.02, 0.1, 0.3, 0.6)
END = b"\n"  # a word that no text has: the end of a text

_BINARY = ("doc_ids", "no_id", "held", "tokens", "bytes", "codes", "far_codes", "logs", "far_logs")
_SLICES = T.StructType(
    [T.StructField("slice", T.LongType()), T.StructField("learnt", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in _BINARY]
    + [T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
)
_SCORES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType())]
    + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_bytes", "n_known", "new_words")]
    + [T.StructField(c, T.DoubleType()) for c in ("log_counts", "score")]
)
#: Codes are two bytes, logarithms steps of 1/250 in two bytes; what is larger stands apart.
_FAR, _UNIT = 0xFFFF, 250.0


def small_int(values: np.ndarray) -> bytes:
    """A leading byte with the width, then unsigned integers as narrow as they fit."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([kind().itemsize]) + values.astype(kind).tobytes()


def read_int(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Values below _FAR, others as _FAR: low bytes, then high bytes, compressed."""
    two = np.minimum(values, _FAR).astype("<u2").view(np.uint8).reshape(-1, 2)
    return pa.compress(np.ascontiguousarray(two.T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, far: np.ndarray) -> np.ndarray:
    """The ``n`` values, with those that stand apart put back."""
    raw = np.frombuffer(pa.decompress(data, decompressed_size=2 * n, codec="zstd", asbytes=True), np.uint8)
    out = np.ascontiguousarray(raw.reshape(2, -1).T).view("<u2").ravel().astype(np.float64)
    out[out == _FAR] = far
    return out


def slice_row(number: int, ids: pa.Array, held: np.ndarray, col: C.Column, logs: np.ndarray) -> tuple:
    """The row of one slice: see _SLICES.  Codes are places among the slice's words, common ones first."""
    words = C.segments(col, lower=True)
    codes, unique = pd.factorize(words.hash)
    first = np.empty(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    n = len(unique)
    doc = words.doc()
    # tokens in order: each text's words, then its end
    size = np.diff(words.first) + 1
    token = np.full(len(words) + len(col), n, np.int64)
    token[np.arange(len(words)) + doc] = codes
    order = np.argsort(-np.bincount(token, minlength=n + 1), kind="stable")
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n + 1)
    token = place[token]
    learnt = np.repeat(~held, size)
    times = np.bincount(token[learnt], minlength=n + 1)
    lower = np.concatenate([C.LOWER[col.data], np.frombuffer(END, np.uint8)])
    begin = np.append(words.start[first], len(col.data))[order]
    long = np.append((words.end - words.start)[first], len(END))[order]
    run = np.concatenate([[0], np.cumsum(long)])
    raw = lower[np.repeat(begin - run[:-1], long) + np.arange(run[-1])]
    names = pa.BinaryArray.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(run.astype(np.int32)), pa.py_buffer(raw)])
    cost = np.rint(-logs.astype(np.float64) * _UNIT)
    return (
        number,
        int(learnt.sum()),
        ids.fill_null(0).to_numpy().astype(np.int64).tobytes(),
        ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
        held.tobytes(),
        small_int(size),
        small_int(C.sums(words.end - words.start + 1, words.first) + len(END)),
        packed(token),
        small_int(token[token >= _FAR]),
        packed(cost),
        cost[cost >= _FAR].astype("<f8").tobytes(),
        names,
        pa.array(times, pa.int32()),
    )


def slices(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """Rows of _SLICES from (doc_id, held, text, logs)."""
    kinds = [pa.int64(), pa.int64(), *(pa.binary() for _ in _BINARY)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            logs = b"".join(table["logs"].to_pylist())
            ids = table["doc_id"].combine_chunks() if table["doc_id"].num_chunks != 1 else table["doc_id"].chunk(0)
            held = table["held"].to_numpy().astype(bool)
            *values, names, times = slice_row(number, ids, held, C.column(table["text"]), np.frombuffer(logs, "<f4"))
            cut = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)] + [cut(names), cut(times)], names=_SLICES.names)

        for batch in batches:
            waiting.append(batch)
            size += batch["text"].nbytes
            if size >= slice_bytes:
                yield row()
                number, waiting, size = number + 1, [], 0
        if sum(b.num_rows for b in waiting):
            yield row()

    return docs.mapInArrow(tidy(work), _SLICES)


def counted(rows: DataFrame) -> DataFrame:
    """(slice, pos, c, new): for each slice's words their counts over all slices.

    ``new`` is 1 on one row of each word that has a count.
    """
    posted = rows.select("slice", F.posexplode(F.arrays_zip("words", "times")).alias("pos", "x")).select("slice", "pos", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    word = Window.partitionBy("word")
    found = posted.select("slice", "pos", F.sum(F.col("n").cast("long")).over(word).alias("c"), F.min("slice").over(word).alias("low"))
    return found.select("slice", "pos", "c", ((F.col("c") > 0) & (F.col("slice") == F.col("low"))).cast("int").alias("new"))


def sums(rows: DataFrame, counts: DataFrame, tokens: int) -> DataFrame:
    """Per document the sums over its tokens; ``new_words`` of a slice stand in its first row."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["pos"].to_numpy()
        times = np.zeros(len(place), np.int64)
        times[place] = right["c"].to_numpy()
        new = int(right["new"].to_numpy().sum())
        log_counts, portion = np.log10(times + 1.0), times / max(tokens, 1)
        out = []
        for r in left.to_pylist():
            first = np.concatenate([[0], np.cumsum(read_int(r["tokens"]))])
            n = int(first[-1])
            code = unpacked(r["codes"], n, read_int(r["far_codes"])).astype(np.int64)
            cost = unpacked(r["logs"], n, np.frombuffer(r["far_logs"], "<f8")) / _UNIT
            mixed, corpus = 10.0**-cost, portion[code]
            tries = [C.sums(-cost, first)]
            for share in SHARES[1:]:
                # a token too unlikely for a float keeps its logarithm
                p = share * corpus + (1 - share) * mixed
                tries.append(C.sums(np.where(p > 1e-290, np.log10(np.maximum(p, 1e-300)), np.log10(1 - share) - cost), first))
            best = np.max(tries, axis=0)
            score = best + np.log10(np.mean([10.0 ** (t - best) for t in tries], axis=0))
            columns = [
                pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=np.frombuffer(r["no_id"], bool)),
                pa.array(np.frombuffer(r["held"], bool)),
                pa.array(read_int(r["tokens"])),
                pa.array(read_int(r["bytes"])),
                pa.array(C.sums((times[code] > 0).astype(np.int64), first)),
                pa.array(np.append(new, np.zeros(len(first) - 2, np.int64))),
                pa.array(C.sums(log_counts[code], first)),
                pa.array(score),
            ]
            out.append(pa.RecordBatch.from_arrays(columns, names=_SCORES.names))
        return pa.Table.from_batches(out)

    columns = [c for c in _SLICES.names if c not in ("words", "times", "learnt")]
    return rows.select(*columns).groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(work, _SCORES)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts are lower-cased (A-Z); tokens are words between ASCII white space, then one end.  Counts
    and the model come from all texts that are not held out.  ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)); ``score`` the model's log10 probability of the words in their order,
    each with a space behind it, and of the end; ``bits_per_byte`` is over the same bytes.  A null text
    counts as empty and has the end only; a null identifier counts as empty text for the fold; repeated
    rows are scored and learnt from each; a text of any length is coded whole, by one task; an empty
    table gives an empty table; further columns are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held_out
    model = bit_mixer.learn(docs.filter(~held))
    log10 = bit_mixer.scorer(spark, model)(F.col("text").cast("binary"))
    rows = kept(slices(docs.select("doc_id", held.alias("held"), "text", log10.alias("logs")), slice_bytes), "slices")
    tokens = rows.agg(F.sum("learnt")).first()[0] or 0
    found = kept(sums(rows, counted(rows), tokens), "scores")
    known = found.agg(F.coalesce(F.sum("new_words"), F.lit(0)).alias("v"))  # one row
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(tokens)) + F.col("v") + F.lit(1.0))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")
    out = found.crossJoin(F.broadcast(known))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
