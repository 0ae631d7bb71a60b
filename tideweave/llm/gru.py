"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a hashed word vector and the scaled sum of hashed vectors of its character
3- to 5-grams.  Two recurrent passes run over a window of words; attention weighs their states and a
linear unit gives the window's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD_BITS, CHAR_BITS = 14, 16
DIM, HIDDEN, ATTENTION = 12, 8, 8
LENGTH, STRIDE = 32, 16
GRAMS = (3, 4, 5)
#: Words whose n-grams are looked up at a time.
PART = 1 << 13


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Words:
    """Different words: slot of each, slots of all their character n-grams, where each word's begin."""

    slot: np.ndarray
    grams: np.ndarray
    first: np.ndarray

    def take(self, rows: np.ndarray) -> Words:
        n = self.first[rows + 1] - self.first[rows]
        first = np.concatenate([[0], np.cumsum(n)])
        return Words(self.slot[rows], self.grams[np.repeat(self.first[rows] - first[:-1], n) + np.arange(first[-1])], first)


def words_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> Words:
    """Features of words given as byte ranges; n-grams run over the word between two marks."""
    slot = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    grams, many = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo in range(0, len(start), PART):
        g, n = _grams(data, start[lo : lo + PART], end[lo : lo + PART])
        grams.append(g)
        many.append(n)
    return Words(slot, np.concatenate(grams), np.concatenate([[0], np.cumsum(np.concatenate(many))]))


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words' n-grams, word by word, and how many each word has."""
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - 1 - first[:-1], size) + np.arange(first[-1])
    flat = data[np.clip(at, 0, len(data) - 1)].astype(np.uint32)
    flat[first[:-1]], flat[first[1:] - 1] = 1, 2
    owner = np.repeat(np.arange(len(size)), size)
    slots, owners = [], []
    h = flat * np.uint32(0x9E3779B1)
    for k in range(1, max(GRAMS)):
        if len(flat) <= k:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + flat[k:] * np.uint32(0x9E3779B1)
        if k + 1 in GRAMS:
            ok = owner[: len(flat) - k] == owner[k:]
            slots.append((h[ok] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - CHAR_BITS))
            owners.append(owner[k:][ok])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    return slots[np.argsort(owners, kind="stable")].astype(np.int32), np.bincount(owners, minlength=len(size))


def window_starts(n: int) -> np.ndarray:
    """First words of all overlapping windows of a text of n words; the last one reaches its end."""
    return np.arange(max(1, -(-(n - LENGTH) // STRIDE) + 1)) * STRIDE if n else np.zeros(0, np.int64)


def windows(code: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of LENGTH word numbers, padded behind, and the text of each row."""
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(1, -(-(n - LENGTH) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n)), many)
    begin = first[doc] + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    at = begin[:, None] + np.arange(LENGTH)
    inside = at < first[doc + 1][:, None]
    padded = np.append(code, pad)
    return padded[np.where(inside, at, len(code))].astype(np.int32), doc


def row_sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different indices and the sums of their rows of values."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    heads = np.flatnonzero(np.append(True, index[1:] != index[:-1])[: len(index)])
    return index[heads], np.add.reduceat(values[order], heads, axis=0) if len(heads) else values[:0]


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"ew": np.zeros((1 << WORD_BITS, DIM), np.float32), "ec": draw(1 << CHAR_BITS, DIM, scale=0.1)}
        for d in "fb":
            self.p |= {f"w{d}": draw(DIM, 3 * HIDDEN, scale=0.5), f"u{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": draw(2 * HIDDEN, ATTENTION, scale=0.5), "v": draw(ATTENTION, scale=0.5), "o": draw(2 * HIDDEN, scale=0.5), "c": np.zeros(1, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors of words, and a row of zeros for padding."""
        n = np.diff(words.first)
        out = np.zeros((len(n) + 1, DIM), np.float32)
        for lo in range(0, len(n), PART):  # the rows of all n-grams at once would take much memory
            hi = min(lo + PART, len(n))
            some = np.flatnonzero(n[lo:hi] > 0) + lo
            if len(some):
                first = words.first[lo]
                grams = words.grams[first : words.first[hi]]
                out[some] = np.add.reduceat(self.p["ec"][grams], words.first[some] - first, axis=0) / np.sqrt(n[some, None]).astype(np.float32)
        out[:-1] += self.p["ew"][words.slot]
        return out

    def _pass(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, d: str, tape: list | None) -> list[np.ndarray]:
        u, b = self.p[f"u{d}"], self.p[f"b{d}"]
        h = np.zeros((len(index), HIDDEN), np.float32)
        states = [h] * index.shape[1]
        steps = range(index.shape[1]) if d == "f" else range(index.shape[1] - 1, -1, -1)
        k = 2 * HIDDEN
        for t in steps:
            x = gates[index[:, t]]
            hu = h @ u
            zr = sigmoid(x[:, :k] + hu[:, :k] + b[:k])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, k:] + b[k:] + r * hu[:, k:])
            new = n + z * (h - n)
            m = mask[:, t, None]
            if tape is not None:
                tape.append((t, h, z, r, n, hu[:, k:]))
            h = new if m.all() else np.where(m, new, h)
            states[t] = h
        return states

    def scores(self, gates: tuple[np.ndarray, np.ndarray], index: np.ndarray, pad: int, tape: dict | None = None) -> np.ndarray:
        """Score of each window; ``gates`` are all words' inputs times the input weights, both ways."""
        mask = index != pad
        tf, tb = ([], []) if tape is not None else (None, None)
        s = np.stack([np.concatenate(x, axis=1) for x in zip(self._pass(gates[0], index, mask, "f", tf), self._pass(gates[1], index, mask, "b", tb))], axis=1)
        e = np.tanh(s @ self.p["a"])
        w = np.where(mask, e @ self.p["v"], np.float32(-1e9))
        w = np.exp(w - w.max(axis=1, keepdims=True)) * mask
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        pooled = (w[..., None] * s).sum(axis=1)
        if tape is not None:
            tape.update(f=tf, b=tb, s=s, e=e, w=w, pooled=pooled, mask=mask)
        return pooled @ self.p["o"] + self.p["c"]

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"], x @ self.p["wb"]

    def gradients(self, words: Words, x: np.ndarray, index: np.ndarray, delta: np.ndarray, tape: dict) -> dict[str, np.ndarray]:
        """Gradients of all parameters given the loss's derivative by each window's score."""
        p, g = self.p, {}
        s, e, w = tape["s"], tape["e"], tape["w"]
        g["o"], g["c"] = tape["pooled"].T @ delta, delta.sum(keepdims=True)
        dp = delta[:, None] * p["o"]
        ds = w[..., None] * dp[:, None]
        dw = (s * dp[:, None]).sum(-1)
        dl = w * (dw - (w * dw).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,ntk->k", dl, e)
        de = dl[..., None] * p["v"] * (1 - e * e)
        g["a"] = np.einsum("nth,ntk->hk", s, de)
        ds += de @ p["a"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            dh = np.zeros((len(index), HIDDEN), np.float32)
            places, parts = [], []
            g[f"u{d}"], g[f"b{d}"] = np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32)
            for t, h, z, r, n, hun in reversed(tape[d]):
                dh = dh + ds[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                m = tape["mask"][:, t, None]
                dn = dh * (1 - z) * (1 - n * n) * m
                dz = dh * (h - n) * z * (1 - z) * m
                dr = dn * hun * r * (1 - r)
                pre = np.concatenate([dz, dr, dn], axis=1)
                by_h = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"u{d}"] += h.T @ by_h
                g[f"b{d}"] += pre.sum(0)
                places.append(index[:, t])
                parts.append(pre)
                dh = np.where(m, dh * z + by_h @ u.T, dh)
            dgates = np.zeros((len(x), 3 * HIDDEN), x.dtype)
            at, total = row_sums(np.concatenate(places), np.concatenate(parts))
            dgates[at] = total
            dgates[-1] = 0  # padding
            g[f"w{d}"] = x.T @ dgates
            dx += dgates @ p[f"w{d}"].T
        dx = dx[:-1]
        g["ew"] = (words.slot, dx)
        n = np.diff(words.first)
        g["ec"] = (words.grams, np.repeat(dx / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0))
        return g


class Trainer:
    """Adam for the dense parameters, adaptive steps for the rows of the tables."""

    def __init__(self, net: Network, rate: float = 0.01, table_rate: float = 0.05):
        self.net, self.rate, self.table_rate, self.t = net, rate, table_rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("ew", "ec")}
        self.v = {k: np.zeros_like(v) if k in self.m else np.full(len(v), 1e-8, np.float32) for k, v in net.p.items()}

    def step(self, words: Words, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        used, local = np.unique(index, return_inverse=True)
        pad = len(words.slot)
        real = used[used != pad]
        local = np.searchsorted(real, index)
        local[index == pad] = len(real)
        some = words.take(real)
        x = self.net.inputs(some)
        tape: dict = {}
        s = self.net.scores(self.net.gates(x), local, len(real), tape)
        delta = ((sigmoid(s) - y) * weight / len(y)).astype(np.float32)
        g = self.net.gradients(some, x, local, delta, tape)
        self.t += 1
        for k, m in self.m.items():
            grad = np.clip(g[k], -1, 1)
            m += 0.1 * (grad - m)
            self.v[k] += 0.001 * (grad * grad - self.v[k])
            self.net.p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
        for k in ("ew", "ec"):
            rows, grad = g[k]
            at, total = row_sums(rows, grad)
            if not len(at):
                continue
            self.v[k][at] += (total * total).mean(1)
            self.net.p[k][at] -= self.table_rate * total / np.sqrt(self.v[k][at])[:, None]
