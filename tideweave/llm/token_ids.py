"""Token ids of documents, written to and read from files of patched blocks.

Texts are cut at ASCII white space, where no token of a word-level model reaches across, and each
worker remembers the ids of the words that it meets most.  Documents are dealt into ranges of ascending
identifiers, and the ids of each range are written as one file by the task that holds it; a file's
name has a part of its own, so a repeated task never meets an unfinished file.  The table of files gives the
number of tokens before each of them.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as C
from .blocks import Reader, Writer
from .shared import bounded_batches, fresh_path, kept, shuffle_width, tidy
from .unit_cache import CACHE_UNITS, UnitCache, encode_each, encode_marked

END = 1
#: Documents for one file, about.
FILE_DOCS = 1 << 14
#: Bytes of text that a worker takes at a time: words that repeat in them are looked up once.
TAKEN = 4 << 20
#: Goes between words that are encoded as one text.
MARK = "\x01"


# The normaliser and the splitting for which letters-only words have a short way.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,!?;:"]] = True


class WordEncoder:
    """Ids of words by a tokenizers file, remembered by the words' hashes.

    Where the file lower-cases and splits as above, A-Z are lower-cased first, a stop after an ASCII
    letter begins a word of its own, and words of letters in composed form skip the normaliser and
    the pattern; all three leave the ids as they are.
    """

    def __init__(self, model: bytes | str, cache_words: int = CACHE_UNITS):
        """``model`` is a tokenizers file or its bytes."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        read = Tokenizer.from_buffer if isinstance(model, bytes) else Tokenizer.from_file
        self.tokenizer = read(model)
        shape = json.loads(self.tokenizer.to_str())
        steps = (shape["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = shape["normalizer"] == _NORMALISER and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[1]["type"] == "ByteLevel"
        if self.known:
            self.short = read(model)
            self.short.normalizer = normalizers.Lowercase()
            self.short.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.cache = UnitCache(self._encode, cache_words)

    def _encode(self, words: list[str]):
        kind = np.full(len(words), 2)
        if self.mark is not None:
            for i, w in enumerate(words):
                if self.known and (w.isascii() and w.isalpha() or w.lower().isalpha() and w.isalpha() and unicodedata.is_normalized("NFC", w)):
                    kind[i] = 0
                elif MARK not in w:
                    kind[i] = 1
        size, start, parts, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for k in range(3):
            at = np.flatnonzero(kind == k)
            if not len(at):
                continue
            some = [words[i] for i in at.tolist()]
            ids, n = encode_marked(self.short if k == 0 else self.tokenizer, some, MARK, self.mark, " ") if k < 2 else encode_each(self.tokenizer, some)
            size[at], start[at] = n, total + np.cumsum(n) - n
            parts.append(ids)
            total += len(ids)
        return np.concatenate(parts), start, size, np.ones(len(words), bool)

    def encode(self, col: C.Column, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin; ``end`` follows every text."""
        breaks = None
        if self.known:
            breaks = np.zeros(len(col.data), bool)
            breaks[1:] = _STOP[col.data[1:]] & _LETTER[col.data[:-1]]
        words = C.segments(col, lower=self.known, breaks=breaks)
        return self.cache.encode(C.LOWER[col.data] if self.known else col.data, words, end)[:2]


_ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.BinaryType())])
_FILES = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])
_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def encoded(docs: DataFrame, model, cuts, end: int | None) -> DataFrame:
    """doc_id, bucket and ids (little-endian; two bytes each where the vocabulary allows).

    ``model`` and ``cuts`` are broadcasts.  Buckets ascend with doc_id; null is in bucket 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordEncoder(model.value)
        wide = max(coder.tokenizer.get_vocab_size(), end or 0) > 0xFFFF
        kind = np.dtype("<u4" if wide else "<u2")
        for batch in batches:
            whole = C.column(batch.column(1))
            own = np.maximum(np.searchsorted(cuts.value, batch.column(0).fill_null(0).to_numpy(), "right"), 1)
            own[batch.column(0).is_null().to_numpy(zero_copy_only=False)] = 0
            bucket = pa.array(own.astype(np.int32))
            for lo, hi in C.slices(whole, TAKEN):
                ids, first = coder.encode(whole.part(lo, hi), end)
                offsets = (first * kind.itemsize).astype(np.int32)
                blobs = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), bucket.slice(lo, hi - lo), blobs], names=_ENCODED.names)

    return docs.mapInArrow(tidy(work), _ENCODED)


#: Cuts between identifiers that are found at a time.
CUTS = 512


def cuts_of(docs: DataFrame, files: int) -> np.ndarray:
    """Identifiers that cut the documents into about ``files`` ranges of equal size.

    Quantiles over all documents; for more than ``CUTS`` files each range is cut by quantiles of its
    own.  The cuts are 8 bytes for each file.
    """
    coarse = min(files, CUTS)
    quantiles = lambda n: F.percentile_approx("doc_id", [k / n for k in range(n)], 10 * n)
    cuts = sorted(set(docs.agg(quantiles(coarse).alias("c")).first().c or [0]))
    if (parts := -(-files // coarse)) > 1:
        edges = F.array(*map(F.lit, cuts)).cast("array<bigint>")
        own = F.size(F.filter(edges, lambda c: c <= F.col("doc_id")))
        finer = docs.filter("doc_id IS NOT NULL").groupBy(own.alias("own")).agg(quantiles(parts).alias("c"))
        cuts = sorted({*cuts, *(x for r in finer.collect() for x in r.c)})  # CUTS rows
    return np.array(cuts, np.int64)


def write_files(docs: DataFrame, path: str, folder: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", file_docs: int = FILE_DOCS) -> DataFrame:
    """Write all documents' ids; one row per file, kept: bucket, path, docs, tokens.

    Texts are encoded where they are read; only ids go to the task of their range.
    """
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        model = f.read()
    wide = max(Tokenizer.from_buffer(model).get_vocab_size(), end or 0) > 0xFFFF
    kind = "<u4" if wide else "<u2"
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = docs.count()
    files = max(shuffle_width(docs.sparkSession), -(-n // file_docs))
    send = docs.sparkSession.sparkContext.broadcast
    rows = encoded(docs, send(model), send(cuts_of(docs, files)), end)  # the model's file; 8 bytes a file
    rows = rows.repartition(files, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(folder)
        fs.create_dir(top, recursive=True)
        now, out, stream, at = None, None, None, ""

        def done():
            out.close()
            stream.close()
            columns = [[now], [at], [len(out.ids)], [out.tokens]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=_FILES.names)

        for batch in batches:
            buckets, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for i, (b, blob) in enumerate(zip(buckets, batch.column(2))):
                if b != now:
                    if out:
                        yield done()
                    now, at = b, f"{folder}/ids-{b:08d}-{uuid.uuid4().hex}.twpf"
                    stream = fs.open_output_stream(at.replace(folder, top, 1))
                    out = Writer(stream)
                out.add(ids[i], np.frombuffer(blob.as_buffer(), kind))
        if out:
            yield done()

    return kept(rows.mapInArrow(tidy(work), _FILES), "files")


def read_files(files: DataFrame) -> DataFrame:
    """Read files back: doc_id, start, n_tokens, ids_crc32 for every document."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    files = files.select("bucket", "path", "base").repartition(shuffle_width(files.sparkSession), "bucket")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fs, at = _open(uri)
                with fs.open_input_file(at) as stream:
                    reader = Reader(stream, stream.size())
                    crc = np.zeros(len(reader.sizes), np.int64)
                    for d, ids in reader.documents():
                        crc[d] = zlib.crc32(ids.astype("<u4").tobytes(), int(crc[d]))
                columns = [pa.array(reader.doc_ids, mask=reader.null), pa.array(reader.first[:-1] + base), pa.array(reader.sizes), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(columns, names=_READ.names)

    return files.mapInArrow(tidy(work), _READ)


def token_ids(docs: DataFrame, path: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", file_docs: int = FILE_DOCS) -> DataFrame:
    """Write the ids of all documents to the shared folder and read them back.

    One row per input row: doc_id, start (tokens of all documents before it), n_tokens (the end id
    included), ids_crc32.  Documents are in ascending order of doc_id, nulls first, repeated
    identifiers by their ids.  A null or empty text has the end id only; an empty table gives an
    empty table; further columns are left out.
    """
    return read_files(write_files(docs, path, fresh_path(docs.sparkSession, "ids"), end, id_col, text_col, file_docs))
