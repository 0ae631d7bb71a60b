"""The context mixer in plain Python, bit by bit: what the compiled one is held against."""

import math
import re

M64 = (1 << 64) - 1
COMMON = b" etaoinsrhdluc\xc3mfpgwybvk.,-!'\n\xa9"
BUCKET_BITS, LOCAL_BITS, GATES, PLACES, STEPS = 15, 12, 24, 320, 32
PRIOR, RATE, REFINE = 0.4, 0.015, 0.02
LOCAL = (1, 3)


def parts_of(c):
    """(value, bits, salt, place) of a byte's parts."""
    place = COMMON.find(c)
    if place < 0:
        return [(15, 4, 0, 0), (c >> 4, 4, 15, 48), (c & 15, 4, 16 + (c >> 4), 64 + (c & 0xF0))]
    if place < 2:
        return [(place, 3, 0, 0)]
    if place < 11:
        return [(place + 2, 4, 0, 0)]
    if place < 15:
        return [(13, 4, 0, 0), (place - 11, 2, 13, 16)]
    return [(14, 4, 0, 0), (place - 15, 4, 14, 32)]


def squash(s):
    return 1 / (1 + math.exp(-(int((s + 12) * 4095 / 24 + 0.5) * 24 / 4095 - 12)))


def odds(n0, n1):
    return math.log((n1 + PRIOR) / (n0 + PRIOR)) if n0 + n1 else 0.0


def known_odds(n0, n1, learn):
    """A finished model keeps its predictions in steps of 1/1024."""
    return odds(n0, n1) if learn else math.floor(odds(n0, n1) * 1024 + 0.5) / 1024


class Mixer:
    def __init__(self):
        self.tags, self.mass, self.nodes, self.texts = {}, {}, {}, 0
        self.weight = [[0.25] * 6 for _ in range(GATES)]
        self.refine = [[squash((i * 128 + 64) * 24 / 4095 - 12) for i in range(STEPS)] for _ in range(PLACES)]

    def bucket(self, k, h, learn):
        at, tag = (k, h >> (64 - BUCKET_BITS)), (h >> 20 | 1) & 0xFFFF
        if self.tags.get(at) == tag:
            if learn:
                self.mass[at] += 1
            return self.nodes[at]
        if not learn:
            return None
        if self.mass.get(at, 0) > 1:
            self.mass[at] -= 1
            return None
        self.tags[at], self.mass[at], self.nodes[at] = tag, 1, {}
        return self.nodes[at]

    def code(self, text, learn=False):
        """log10 probabilities of the tokens; a model that learns keeps what it learnt."""
        weight = self.weight if learn else [w[:] for w in self.weight]
        refine = self.refine if learn else [r[:] for r in self.refine]
        local = {}
        self.texts += 1
        spaces = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
        words = [text.encode()[a:b] for a, b in spaces]
        spaces.append((len(text.encode()), len(text.encode())))
        stream = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" " for w in words] + [b"\n"]
        out, last, before = [], 0, 0
        at = 0  # bytes read so far
        for token in stream:
            total, word = 0.0, 0
            if token == b"\n":
                at = len(text.encode())
            for k, c in enumerate(token):
                context = [last & 0xFFFF, last & 0xFFFFFF, word, (word + (before + 1) * 0x9E3779B97F4A7C15) & M64]
                if k < len(token) - 1:
                    at = spaces[len(out)][0] + k + 1
                mixing = not learn or (at >> 8) + self.texts & 7 == 0
                for part in parts_of(c):
                    if mixing:
                        total += math.log10(self.part(part, context, weight, refine, local, learn))
                    else:
                        self.count(part, context)
                last = (last << 8 | c) & M64
                word = (word + c + 1) * 0xD6E8FEB86659FD93 & M64
                word ^= word >> 32
            out.append(total)
            # the space is not part of the word
            before = 0
            for c in token[:-1]:
                before = (before + c + 1) * 0xD6E8FEB86659FD93 & M64
                before ^= before >> 32
        return out

    def hashes(self, context, salt):
        hashes = []
        for x in context:
            h = (x + salt * 0x9E3779B97F4A7C15 + 1) * 0xA0761D6478BD642F & M64
            hashes.append((h ^ h >> 32) * 0xE7037ED1A0B428DB & M64)
        return hashes

    def count(self, part, context):
        value, bits, salt, _ = part
        for k, h in enumerate(self.hashes(context, salt)):
            n, node = self.bucket(k, h, True), 1
            for b in reversed(range(bits)):
                bit = value >> b & 1
                if n is not None:
                    n0, n1 = n.get(node, (0, 0))
                    n[node] = (n0 + 1 - bit, n1 + bit)
                node = node << 1 | bit

    def part(self, part, context, weight, refine, local, learn):
        value, bits, salt, place0 = part
        hashes = self.hashes(context, salt)
        known = [self.bucket(k, h, learn) for k, h in enumerate(hashes)]
        hits = sum(n is not None for n in known[1:])
        own = []
        for j, k in enumerate(LOCAL):
            at, tag = (j, hashes[k] >> (64 - LOCAL_BITS)), hashes[k] >> 20 & 255
            if at not in local or local[at][0] != tag:
                local[at] = (tag, {})
            own.append(local[at][1])
        gate = (hits * 3 + sum(bool(n) for n in own)) * 2 + (salt > 0)
        w, all_of, node = weight[gate], 1.0, 1
        for b in reversed(range(bits)):
            bit = value >> b & 1
            x = [known_odds(*n.get(node, (0, 0)), learn) if n is not None else 0.0 for n in known] + [odds(*n.get(node, (0, 0))) for n in own]
            s = max(-11.99, min(11.99, sum(a * c for a, c in zip(x, w))))
            p = squash(s)
            low, r = int((s + 12) * 4095 / 24 + 0.5) >> 7, refine[place0 + node]
            q = max(2**-16, min(1 - 2**-16, (p + r[low]) / 2))
            all_of *= q if bit else 1 - q
            if abs(bit - p) > 1 / 40:
                for i in range(6):
                    w[i] += (bit - p) * RATE * x[i]
            r[low] += (bit - r[low]) * REFINE
            for n in own:
                up, down = n.get(node, (0, 0))[:: -1 if bit else 1]
                up, down = min(15, up + 1), down // 2 + 1 if down > 2 else down
                n[node] = (down, up) if bit else (up, down)
            if learn:
                for n in known:
                    if n is not None:
                        n0, n1 = n.get(node, (0, 0))
                        n[node] = (n0 + 1 - bit, n1 + bit)
            node = node << 1 | bit
        return all_of
