import struct
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from corpus import frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tideweave.llm import pieces as P
from tideweave.llm.queries import piece_model

MODEL = piece_model()
SP = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
CODER = P.PieceEncoder(MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=list("abeThing  \n\t.,!é你▁\x01\x00\U0001f600'"), max_size=40), min_size=1, max_size=6))
def test_parity_with_sentencepiece(texts):
    ids, first, same = CODER.encode(pa.array(texts))
    for i, t in enumerate(texts):
        want = SP.encode(t)
        assert ids[first[i] : first[i + 1]].tolist() == want
        assert same[i] == (SP.decode(want) == t.replace("▁", " "))


def test_whole_texts_and_units_agree(spark):
    out = P.encode_decode(frame(spark), MODEL).collect()
    by = {r.doc_id: r for r in out}
    for i, t, *_ in rows():
        want = SP.encode(t or "")
        assert by[i].ids == want and by[i].n_pieces == len(want)
        assert by[i].ids_crc32 == zlib.crc32(np.array(want, "<i4").tobytes())
        assert by[i].decoded == (t or "") and by[i].round_trip
    assert P.encode_decode(frame(spark, []), MODEL).collect() == []


def _varint(n):
    out = b""
    while True:
        n, b = n >> 7, n & 0x7F
        if not n:
            return out + bytes([b])
        out += bytes([b | 0x80])


def _field(number, kind, payload):
    return _varint(number << 3 | kind) + payload


def _message(number, data):
    return _field(number, 2, _varint(len(data)) + data)


def unigram_model():
    """A small model with unigram scores and byte fallback, put together by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -2.0, 1), ("▁the", -3.0, 1), ("▁th", -4.5, 1), ("e", -3.5, 1), ("r", -3.6, 1), ("iver", -5.0, 1), ("i", -4.0, 1), ("v", -4.1, 1), ("▁river", -6.0, 1), ("t", -4.0, 1), ("h", -4.0, 1)]
    out = b"".join(_message(1, _message(1, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, _varint(k))) for p, s, k in pieces)
    trainer = _field(3, 0, _varint(1)) + _field(35, 0, _varint(1))
    normaliser = _message(1, b"identity") + _field(3, 0, _varint(1)) + _field(4, 0, _varint(1)) + _field(5, 0, _varint(1))
    return out + _message(2, trainer) + _message(3, normaliser)


def test_unigram_scores():
    data = unigram_model()
    model = P.parse(data)
    assert (model.kind, model.byte_fallback, model.squeeze) == (P.UNIGRAM, True, True)
    texts = ["the river", "  the   river ", "three", "ether the", "river river", "vr"]
    assert P.differing(P.rebuilt(model), data, texts) == []
    coder = P.PieceEncoder(data)
    assert coder.cache is None
    ids, first, _ = coder.encode(pa.array(texts))
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [sp.encode(t) for t in texts]


def test_units_are_held_against_the_library(spark, monkeypatch):
    import pytest

    assert P.differing_units(P.PieceEncoder(MODEL), MODEL, list(P.PROBES)) == []
    real = P.PieceEncoder.__init__

    def cut_everywhere(self, data):
        real(self, data)
        self.apart[:128, :128] = True

    monkeypatch.setattr(P.PieceEncoder, "__init__", cut_everywhere)
    with pytest.raises(ValueError, match="by units"):
        P.encode_decode(frame(spark), MODEL)
