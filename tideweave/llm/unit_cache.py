"""Ids of text units that a worker remembers, by the units' hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd

from . import textcols as C

#: Different units that a worker remembers at a time.
CACHE_UNITS = 1 << 19


class UnitCache:
    """Encodes texts unit by unit; ``encode_units`` gets the units that are not remembered.

    It returns the ids of all of them, where each unit's begin, how many it has, and a flag for each.
    When the cache is full the units that were used least are forgotten.
    """

    def __init__(self, encode_units, most: int = CACHE_UNITS):
        self.encode_units, self.most = encode_units, most
        self.slot: dict[int, int] = {}
        self.flat, self.flag = np.zeros(0, np.uint32), np.zeros(0, bool)
        self.start, self.size, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep the half of the units that were used most, and halve their counts."""
        order = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        hashes = np.empty(len(self.slot), np.uint64)
        hashes[np.fromiter(self.slot.values(), np.int64, len(self.slot))] = np.fromiter(self.slot, np.uint64, len(self.slot))
        size = self.size[order]
        first = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.start[order] - first, size) + np.arange(size.sum())]
        self.start, self.size, self.uses, self.flag = first, size, self.uses[order] // 2, self.flag[order]
        self.slot = dict(zip(hashes[order].tolist(), range(len(order))))

    def _learn(self, hashes: list[int], units: list[str]) -> None:
        ids, start, size, flag = self.encode_units(units)
        n = len(self.slot)
        self.start = np.concatenate([self.start, len(self.flat) + start])
        self.flat, self.size, self.flag = np.concatenate([self.flat, ids]), np.concatenate([self.size, size]), np.concatenate([self.flag, flag])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
        self.slot.update(zip(hashes, range(n, n + len(size))))

    def encode(self, data: np.ndarray, units: C.Segments, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, where each text's begin, and whether all its units have the flag.

        ``data`` are the bytes that ``units`` point into; ``end`` follows every text.
        """
        codes, uniques = pd.factorize(units.hash)
        if len(self.slot) > self.most:
            self._forget()
        keys = uniques.tolist()
        unknown = [i for i, h in enumerate(keys) if h not in self.slot]
        if unknown:
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[unknown]
            raw = data.tobytes()
            self._learn([keys[i] for i in unknown], [raw[a:b].decode("utf-8", "replace") for a, b in zip(units.start[at].tolist(), units.end[at].tolist())])
        slots = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))
        self.uses[slots] += np.bincount(codes, minlength=len(keys))
        good = C.sums(~self.flag[slots][codes], units.first) == 0
        start, size = self.start[slots][codes], self.size[slots][codes]
        first, flat = units.first, self.flat
        if end is not None:  # one more unit after each text
            flat = np.append(flat, np.uint32(end))
            start, size = np.insert(start, first[1:], len(self.flat)), np.insert(size, first[1:], 1)
            first = first + np.arange(len(first))
        run = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(start - run[:-1], size) + np.arange(run[-1])], run[first], good


def encode_marked(tokenizer, units: list[str], mark: str, mark_id: int, between: str, together: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units and how many each has; many units are one text, with a mark after each."""
    ending = f"{between}{mark}"
    texts = [f"{ending}{between}".join(units[i : i + together]) + ending for i in range(0, len(units), together)]
    ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
    cut = np.flatnonzero(ids == mark_id)
    return np.delete(ids, cut), np.diff(cut, prepend=-1) - 1


def encode_each(tokenizer, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
    return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
