"""Patched frame-of-reference blocks of token ids, and files of them.

A block holds ``BLOCK`` ids.  Its minimum is subtracted; the rest is packed with as many bits as a
fixed percentile of the block needs; ids that need more keep their low bits there and have their
place and high bits in an exception list.  A file is: magic, blocks, documents (id, whether it is
null, number of tokens), where each block starts, a trailer with the counts.  With the block index
any stretch of tokens is read without decoding what lies before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 1024
PERCENTILE = 0.9
MAGIC = b"TWPF\x01\x00\x00\x00"
_HEAD = struct.Struct("<IBxHH")  # minimum, bits, ids, exceptions
_TAIL = struct.Struct("<QQQ")  # blocks, documents, tokens


def bit_lengths(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.int64)


def pack(v: np.ndarray, bits: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below ``1 << bits`` as rows of 64-bit words."""
    rows = len(v)
    lanes = np.ascontiguousarray(v.reshape(-1, 64).T).astype(np.uint64)
    out = np.zeros((bits, lanes.shape[1]), np.uint64)
    for i in range(64 if bits else 0):
        word, shift = divmod(i * bits, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(rows, -1)


def unpack(words: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of :func:`pack`."""
    rows = len(words)
    if not bits:
        return np.zeros((rows, BLOCK), np.uint32)
    lanes = np.ascontiguousarray(words.reshape(-1, bits).T)
    out = np.empty((64, lanes.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        x = lanes[word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | lanes[word + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return np.ascontiguousarray(out.T).reshape(rows, BLOCK)


def encode(ids: np.ndarray) -> list[bytes]:
    """Blocks of an array of unsigned 32-bit ids."""
    n = len(ids)
    if not n:
        return []
    rows = -(-n // BLOCK)
    full = np.empty(rows * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[n - 1]
    full = full.reshape(rows, BLOCK)
    low = full.min(axis=1)
    v = full - low[:, None]
    k = int(BLOCK * PERCENTILE) - 1
    width = bit_lengths(np.partition(v, k, axis=1)[:, k])
    over = v > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    row, col = np.nonzero(over)
    high = (v[row, col].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
    first = np.searchsorted(row, np.arange(rows + 1))
    col = col.astype("<u2")
    packed: list = [b""] * rows
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for i, words in zip(at, pack(v[at] & np.uint32((1 << int(w)) - 1), int(w))):
            packed[i] = words.tobytes()
    out = []
    for i in range(rows):
        a, b = first[i], first[i + 1]
        count = min(BLOCK, n - i * BLOCK)
        out.append(_HEAD.pack(low[i], width[i], count, b - a) + packed[i] + col[a:b].tobytes() + high[a:b].tobytes())
    return out


def decode(blocks: list[memoryview]) -> np.ndarray:
    """Ids of consecutive blocks."""
    if not blocks:
        return np.zeros(0, np.uint32)
    heads = [_HEAD.unpack_from(b) for b in blocks]
    width = np.array([h[1] for h in heads])
    out = np.empty((len(blocks), BLOCK), np.uint32)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        size = int(w) * BLOCK // 8
        words = np.frombuffer(b"".join(blocks[i][_HEAD.size : _HEAD.size + size] for i in at), np.uint64).reshape(len(at), -1)
        out[at] = unpack(words, int(w))
    for i, (low, w, _, n) in enumerate(heads):
        if n:
            at = _HEAD.size + w * BLOCK // 8
            col = np.frombuffer(blocks[i], "<u2", n, at)
            out[i, col] += (np.frombuffer(blocks[i], "<u4", n, at + 2 * n).astype(np.uint64) << np.uint64(w)).astype(np.uint32)
        out[i] += np.uint32(low)
    counts = [h[2] for h in heads]
    if all(c == BLOCK for c in counts):
        return out.ravel()
    return np.concatenate([out[i, :c] for i, c in enumerate(counts)])


class Writer:
    """Writes documents to a binary stream, holding back less than a chunk of ids."""

    CHUNK = BLOCK * 256

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.starts: list[int] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.rest: list[np.ndarray] = []
        self.held = self.tokens = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.tokens += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.CHUNK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        for block in encode(ids[:n].astype(np.uint32)):
            self.starts.append(self.at)
            self.at += len(block)
            self.stream.write(block)
        self.rest, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        self.stream.write(np.array([i or 0 for i in self.ids], "<i8").tobytes())
        self.stream.write(np.array([i is None for i in self.ids], "u1").tobytes())
        self.stream.write(np.array(self.sizes, "<i8").tobytes())
        self.stream.write(np.array([*self.starts, self.at], "<u8").tobytes())
        self.stream.write(_TAIL.pack(len(self.starts), len(self.ids), self.tokens))


class Reader:
    """Reads a file of blocks through a random-access stream (read, seek, size)."""

    def __init__(self, stream, size: int):
        self.stream = stream
        blocks, docs, self.tokens = _TAIL.unpack(self._bytes(size - _TAIL.size, _TAIL.size))
        at = size - _TAIL.size - 8 * (blocks + 1)
        self.starts = np.frombuffer(self._bytes(at, 8 * (blocks + 1)), "<u8").astype(np.int64)
        table = self._bytes(at - 17 * docs, 17 * docs)
        self.doc_ids = np.frombuffer(table, "<i8", docs)
        self.null = np.frombuffer(table, "u1", docs, 8 * docs).astype(bool)
        self.sizes = np.frombuffer(table[9 * docs :], "<i8")
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        if self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token blocks")

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def blocks(self, lo: int, hi: int) -> np.ndarray:
        data = memoryview(self._bytes(int(self.starts[lo]), int(self.starts[hi] - self.starts[lo])))
        cut = self.starts[lo : hi + 1] - self.starts[lo]
        return decode([data[a:b] for a, b in zip(cut[:-1], cut[1:])])

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from token ``start`` on, decoding only the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        lo, hi = start // BLOCK, (start + n - 1) // BLOCK + 1
        return self.blocks(lo, hi)[start - lo * BLOCK : start - lo * BLOCK + n]

    def documents(self, chunk: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the document, ids) in order; a long document comes in several parts."""
        d, total = 0, int(self.first[-1])
        for at in range(0, total, chunk):
            end = min(at + chunk, total)
            ids = self.read(at, end - at)
            while d < len(self.sizes) and self.first[d] < end:
                a, b = max(self.first[d], at), min(self.first[d + 1], end)
                if b > a:
                    yield d, ids[a - at : b - at]
                if self.first[d + 1] > end:
                    break
                d += 1
