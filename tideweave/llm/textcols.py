"""Words and lines of Arrow text columns as numpy arrays, without Python objects for them.

A text column is one buffer of UTF-8 with offsets.  Separators are ASCII bytes, so words are byte
ranges; a word's hash is a polynomial over its bytes, modulo 2**64 with an odd base, read off a
running sum and then mixed.  Equal byte strings have equal hashes; two different ones collide with a
chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time: bounds the temporary arrays.
WINDOW = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_NEWLINE = np.zeros(256, bool)
IS_NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place, one to one."""
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, _U)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@dataclass
class Column:
    """Bytes and offsets of ``n`` texts (null is empty), and which were null."""

    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def part(self, lo: int, hi: int) -> Column:
        o = self.offsets[lo : hi + 1]
        return Column(self.data[o[0] : o[-1]], o - o[0], self.null[lo:hi])


def column(array: pa.Array) -> Column:
    """A string column of Arrow without copying the text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    null = array.is_null().to_numpy(zero_copy_only=False)
    if null.any():
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(array) + 1, array.offset * kind().itemsize).astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(array) else np.zeros(0, np.uint8)
    return Column(data, offsets - offsets[0], null)


def slices(col: Column, most_bytes: int = 2 * WINDOW) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` of text each; a longer text is a range of its own."""
    lo, n = 0, len(col)
    while lo < n:
        hi = int(np.searchsorted(col.offsets, col.offsets[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Segments:
    """Byte ranges between separators: start, end, hash; ``first[d] : first[d + 1]`` are text d's."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def segments(col: Column, separator: np.ndarray = IS_SPACE, lower: bool = False, breaks: np.ndarray | None = None) -> Segments:
    """Non-empty ranges without a separator byte, of every text whole.

    ``breaks`` tells of each byte whether a new range begins there in any case.
    """
    data, offsets = col.data, col.offsets
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] |= inside[heads]
    if breaks is not None:
        begins |= breaks & inside
    ends = inside
    ends[:-1] &= ~inside[1:] | begins[1:]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    out = np.empty(len(start), _U)
    lo = 0
    while lo < len(start):  # windows of whole segments
        at = start[lo]
        hi = max(int(np.searchsorted(end, at + WINDOW, "right")), lo + 1)
        size = int(end[hi - 1] - at)
        cap = WINDOW if size <= WINDOW else 1 << (size - 1).bit_length()
        power, inverse = _powers(cap + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(size + 1, _U)
            np.cumsum((data[at : at + size].astype(_U) + _U(1)) * power[:size], out=run[1:])
            s = start[lo:hi] - at
            out[lo:hi] = (run[end[lo:hi] - at] - run[s]) * inverse[s]
        lo = hi
    return Segments(start, end, mix(out), np.searchsorted(start, offsets))


def windows(words: Segments, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows that lie in one text, and their first words' places."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, _U)
        for j in range(width):
            h = h * _U(0xD6E8FEB86659FD93) + words.hash[j : j + n]
    doc = words.doc()
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return mix(h[whole]), whole


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values, given where they begin."""
    run = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys with their texts: has an equal in the same text; has an earlier equal there."""
    n = len(keys)
    some, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return some, later
    with np.errstate(over="ignore"):
        own = mix(keys + mix(doc.astype(_U) + _U(0x51ED270B)) * _U(3))
    order = np.argsort(own, kind="stable")
    own = own[order]
    same = own[1:] == own[:-1]
    later[order[1:][same]] = True
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    return some, later
