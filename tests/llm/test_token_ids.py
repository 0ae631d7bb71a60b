import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tideweave.llm import blocks as B
from tideweave.llm import textcols as C
from tideweave.llm import token_ids as K
from tideweave.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.sampled_from([1, 2, 17, 300, 49408, 2**32 - 1]), st.integers(0, 9))
def test_blocks_round_trip(n, top, seed):
    r = np.random.default_rng(seed)
    ids = r.integers(0, top, n, dtype=np.uint32) if n else np.zeros(0, np.uint32)
    ids[:: 31 + seed] = top - 1
    assert (B.decode([memoryview(b) for b in B.encode(ids)]) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(B.BLOCK, 5, np.uint32)
    ids[7] = 4_000_000_000
    assert len(B.encode(ids)[0]) < 30


def test_files_and_random_access():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 49408, n).astype(np.uint32) for n in (0, 1, 5000, 3, 300_000, 0, 77)]
    out = io.BytesIO()
    w = B.Writer(out)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    w.close()
    reader = B.Reader(out, len(out.getvalue()))
    every = np.concatenate(docs)
    for start, n in ((0, 10), (1020, 9), (4999, 200_000), (len(every) - 3, 3), (5, 0)):
        assert (reader.read(start, n) == every[start : start + n]).all()
    got = [np.zeros(0, np.uint32)] * len(docs)
    for d, ids in reader.documents(1 << 14):
        got[d] = np.concatenate([got[d], ids])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, docs))
    assert reader.null.tolist() == [True] + [False] * 6


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=list("aBÉé́'st  \n.,!≠İΣß19\x01 你-_|<>\x00ﬁ"), max_size=30), min_size=1, max_size=6))
def test_words_have_the_ids_of_whole_texts(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH) if not hasattr(test_words_have_the_ids_of_whole_texts, "t") else test_words_have_the_ids_of_whole_texts.t
    test_words_have_the_ids_of_whole_texts.t = whole
    coder = getattr(test_words_have_the_ids_of_whole_texts, "c", None) or K.WordEncoder(PATH, 50)
    test_words_have_the_ids_of_whole_texts.c = coder
    ids, first = coder.encode(C.column(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids + [1]


def test_written_and_read_back(spark, tokenizer):
    data = rows() + [rows()[3], (None, "no id here", "", "", 0, "", 0)]
    got = K.token_ids(frame(spark, data), PATH, file_docs=9).collect()
    want = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t, *_ in data]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    at, said = 0, []
    for i, ids in want:
        said.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(said, key=key)


def test_empty_table(spark):
    assert K.token_ids(frame(spark, []), PATH).collect() == []


def test_more_files_than_cuts_found_at_a_time(spark, monkeypatch):
    """Skewed identifiers over the whole range of longs: files stay of about equal size."""
    monkeypatch.setattr(K, "CUTS", 4)
    ids = [*range(100), *(1000 + 7 * i for i in range(100)), -(1 << 63), (1 << 63) - 1, None]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    cuts = K.cuts_of(docs, 20)
    assert len(cuts) >= 16
    sizes = np.diff(np.searchsorted(np.sort(np.array([i for i in ids if i is not None])), np.append(cuts, (1 << 63) - 1)))
    assert sizes.max() <= 30
    got = sorted(((r.start, r.doc_id) for r in K.token_ids(docs, PATH, file_docs=10).collect()))
    assert [i for _, i in got] == [None, *sorted(i for i in ids if i is not None)]
