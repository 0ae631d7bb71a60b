"""SentencePiece models run by the tokenizers library.

The model's protobuf is read field by field: pieces with scores and kinds, the kind of the model, and
the normaliser.  From them a tokenizer is rebuilt: normaliser, metaspace marker, unigram scores or
merges, byte fallback.  Batches are encoded and decoded by the library's threads, and the rebuilt
tokenizer and the encoder by units are held against the sentencepiece library on probe texts before they
are used.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as C
from .shared import bounded_batches, tidy
from .unit_cache import UnitCache, encode_each, encode_marked

MARK = "▁"
#: Units that a worker remembers, and bytes of text that it takes at a time.
CACHE_UNITS = 1 << 17
TAKEN = 1 << 20
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message, in order."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return out, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse(data: bytes) -> Model:
    """Read what encoding needs from a serialised model.

    Field numbers are those of the public model format: 1 pieces (1 text, 2 score, 3 kind),
    2 trainer (3 kind of model, 24 spaces as suffix, 35 byte fallback), 3 normaliser (2 compiled map,
    3 dummy prefix, 4 remove extra spaces, 5 escape spaces).
    """
    m = Model()
    for number, value in fields(data):
        if number == 1:
            f = dict(fields(value))
            m.pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
        elif number == 2:
            f = dict(fields(value))
            m.kind, m.whitespace_suffix, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(24, 0)), bool(f.get(35, 0))
        elif number == 3:
            f = dict(fields(value))
            m.charsmap = f.get(2, b"")
            m.dummy_prefix, m.squeeze, m.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return m


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs that join to a piece, best piece first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    out = []
    for p, i in ids.items():
        for k in range(1, len(p)):
            a, b = p[:k], p[k:]
            if a in ids and b in ids:
                out.append((-model.pieces[i][1], ids[a], ids[b], a, b))
    return [x[3:] for x in sorted(out)]


def rebuilt(model: Model):
    """A tokenizer of the tokenizers library that encodes as the model does."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        vocab = [(p, score) for p, score, _ in model.pieces]
        t = Tokenizer(models.Unigram(vocab, model.unknown, model.byte_fallback))
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        t = Tokenizer(models.BPE(vocab, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model kind {model.kind}")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix and not model.whitespace_suffix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces):
        # no piece has the marker behind another character, so none reaches across these cuts
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    users = [AddedToken(p, normalized=True) for p, _, kind in model.pieces if kind == USER]
    if users:
        t.add_tokens(users)
    end = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return t


class PieceEncoder:
    """Encodes and decodes whole texts unit by unit, where the model allows it.

    Two characters that no piece has side by side are never in one piece, so a text may be cut
    between them, and each unit encoded once.  A unit's flag tells whether decoding gives it back.
    That holds for byte fallback (unknown characters don't join) and a normaliser that changes spaces
    only; other models encode each text at once.
    """

    _MARK = "\x01"

    def __init__(self, model_bytes: bytes):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # for one task; each thread has a cache of its own
        from tokenizers import normalizers, pre_tokenizers

        self.model = parse(model_bytes)
        self.whole = rebuilt(self.model)
        m = self.model
        by_unit = m.byte_fallback and m.escape and m.dummy_prefix and not (m.charsmap or m.squeeze or m.whitespace_suffix or any(p[2] == USER for p in m.pieces))
        self.cache = None
        if by_unit:
            pairs = np.zeros((128, 128), bool)  # that some piece has
            for p, _, kind in m.pieces:
                if kind == NORMAL:
                    for a, b in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:]):
                        if ord(a) < 128 and ord(b) < 128:
                            pairs[ord(a), ord(b)] = True
            self.apart = np.zeros((256, 256), bool)
            self.apart[:128, :128] = ~pairs
            self.bare = rebuilt(m)
            self.bare.normalizer = normalizers.Replace(" ", MARK)
            self.bare.pre_tokenizer = pre_tokenizers.Split(self._MARK, "isolated")
            mark = self.bare.encode(self._MARK, add_special_tokens=False).ids
            if len(mark) == 1 and not any(self._MARK in p and len(p) > 1 for p, _, _ in m.pieces):
                self.mark = mark[0]
                self.cache = UnitCache(self._encode, CACHE_UNITS)

    def _encode(self, units: list[str]):
        odd = np.array([self._MARK in u or MARK in u for u in units])
        ids, size, start = [], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        total = 0
        for part, at in ((False, np.flatnonzero(~odd)), (True, np.flatnonzero(odd))):
            if len(at):
                some = [units[i] for i in at.tolist()]
                got, n = encode_each(self.bare, some) if part else encode_marked(self.bare, some, self._MARK, self.mark, "")
                size[at], start[at] = n, total + np.cumsum(n) - n
                ids.append(got)
                total += len(got)
        flat = np.concatenate(ids)
        many = [flat[a : a + n].tolist() for a, n in zip(start.tolist(), size.tolist())]
        back = self.whole.decoder
        names = self.model.pieces
        # the decoder drops one leading space, so a unit is decoded behind one
        good = [back.decode([MARK, *(names[i][0] for i in x)]) == u.replace(MARK, " ") for x, u in zip(many, units)]
        return flat, start, size, np.array(good, bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where each text's begin, and whether decoding gives each normalised text back."""
        if self.cache is None:
            some = texts.fill_null("").to_pylist()
            ids = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
            back = self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
            first = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            return np.concatenate(ids or [np.zeros(0, np.uint32)]), first, np.array([b == _plain(self.whole, self.model, s) for b, s in zip(back, some)], bool)
        col = C.column(texts)
        n = np.diff(col.offsets)
        shift = np.cumsum(n > 0)  # the dummy prefix: a space before each text that has one character
        data = np.insert(col.data, col.offsets[:-1][n > 0], 0x20)
        padded = C.Column(data, col.offsets + np.concatenate([[0], shift]), col.null)
        breaks = np.zeros(len(data), bool)
        breaks[1:] = self.apart[data[:-1], data[1:]]
        units = C.segments(padded, np.zeros(256, bool), breaks=breaks)
        return self.cache.encode(data, units)


PROBES = (
    "", " ", "a", "  two  spaces ", "line\nbreak\ttab", "größe señal été", "你好 \U0001f600", "aaaaaaaa bbbb", "x" * 300,
    "It's 3.14, isn't it? (no)", "Thnt eringing onheed, with erenenst thaner.",
)


def differing(tokenizer, model_bytes: bytes, texts: list[str]) -> list[int]:
    """Places of texts that the sentencepiece library encodes or decodes differently."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    want = sp.encode(list(texts), num_threads=1)
    got = [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]
    back = tokenizer.decode_batch(want, skip_special_tokens=False)
    return [i for i, (w, g, b) in enumerate(zip(want, got, back)) if w != g or sp.decode(w) != b]


def differing_units(coder: PieceEncoder, model_bytes: bytes, texts: list[str]) -> list[int]:
    """Places of texts whose ids or round trip PieceEncoder, which makes the output, tells differently."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    want = sp.encode(list(texts), num_threads=1)
    good = [sp.decode(w) == _plain(coder.whole, coder.model, t) for w, t in zip(want, texts)]
    bad = set()
    for _ in range(2):  # encoded, then read from the cache
        ids, first, same = coder.encode(pa.array(texts, pa.string()))
        bad |= {i for i, w in enumerate(want) if ids[first[i] : first[i + 1]].tolist() != w or bool(same[i]) != good[i]}
    return sorted(bad)


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("decoded", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def encode_decode(docs: DataFrame, model_bytes: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids, ids_crc32, decoded, round_trip.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers; ``round_trip`` tells whether
    decoding all ids of the text gives the normalised text back.  A null text counts as empty; repeated rows are encoded
    each; an empty table gives an empty table; further columns are left out.  ``with_ids`` and
    ``with_text`` leave out the wide columns.
    """
    bounded_batches(docs.sparkSession)
    if bad := differing(rebuilt(parse(model_bytes)), model_bytes, list(PROBES)):
        raise ValueError(f"the rebuilt tokenizer differs from sentencepiece on probes {bad}")
    if bad := differing_units(PieceEncoder(model_bytes), model_bytes, list(PROBES)):
        raise ValueError(f"encoding by units differs from sentencepiece on probes {bad}")
    model = docs.sparkSession.sparkContext.broadcast(model_bytes)  # one model file, half a MB
    out = T.StructType([f for f in _OUT if (with_ids or f.name != "ids") and (with_text or f.name != "decoded")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceEncoder(model.value)
        for batch in batches:
            for lo, hi in C.slices(C.column(batch.column(1)), TAKEN):
                texts = batch.column(1).slice(lo, hi - lo)
                flat, first, _ = coder.encode(texts)
                raw = flat.astype("<i4")
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(raw))
                decoded = coder.whole.decode_batch([x.tolist() for x in np.split(raw, first[1:-1])] if len(texts) else [], skip_special_tokens=False)
                same = [d == _plain(coder.whole, coder.model, t or "") for d, t in zip(decoded, texts.to_pylist())]
                columns = {
                    "doc_id": batch.column(0).slice(lo, hi - lo),
                    "n_pieces": pa.array(np.diff(first)),
                    "ids": lists,
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(first[:-1], first[1:])], pa.int64()),
                    "decoded": pa.array(decoded, pa.string()),
                    "round_trip": pa.array(same, pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([columns[c] for c in out.names], names=out.names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(work), out)


def _plain(tokenizer, model: Model, text: str) -> str:
    """What decoding must give: the text as the normaliser leaves it, with spaces for the marker."""
    if not model.charsmap and not model.squeeze:
        return text.replace(MARK, " ")
    out = tokenizer.normalizer.normalize_str(text).replace(MARK, " ")
    return out[1:] if model.dummy_prefix and out.startswith(" ") else out
