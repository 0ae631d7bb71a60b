"""Licence scans: a trained classifier of paragraphs, confirmed by templates.

A paragraph is a line of text; lines without a blank line between them are a block, and a statement that
is wrapped over lines of a block is found over all of them.  A multinomial logistic regression over hashed word 1- to 3-grams
names its licence family, no licence, or ``unknown``: a licence statement of no known family.  It is
trained on labelled paragraphs made from the families' templates and from statements and prose that
name no known licence; probabilities are calibrated by a temperature on paragraphs that training has
not seen.  A family stands only if the paragraph holds enough of one of its templates' words in
order; a licence statement that no template confirms is unknown.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as C
from .shared import bounded_batches, tidy

# Statements by which texts name their licence.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0 january 2004", "apache 2 0 license"),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "mit license"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl v3 license"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl v2 license"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license version 3", "gnu lesser general public license version 2 1"),
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    "bsd": ("licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "bsd 3 clause license", "bsd 2 clause license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license"),
    "cc-by": ("licensed under cc by 4 0", "licensed under the creative commons attribution 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "licensed under the creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    "cc0": ("licensed under cc0 1 0", "dedicated to the public domain under the cc0 1 0 universal license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense"),
}
UNNAMED = (
    "all rights reserved no part may be copied without permission of the owner", "licensed under the terms of the vendor agreement",
    "released under our own license see the file for terms", "use of this work is governed by the site license",
    "this content is licensed to subscribers only", "licensed under the open widget license version 4", "proprietary license do not distribute",
    "all rights reserved", "licensed under the widget public license", "released under the widget license", "distributed under the terms of the widget license",
)
PROSE = (
    "the driver lost his license after the accident", "apache helicopters flew over the general public", "version 2 0 of the report was released in january",
    "he was granted permission to copy the key free of charge", "students at mit attribute their success to public lectures", "a creative commons room in the village",
    "the software was modified and distributed to every person in the office", "she took a licence to practise medicine", "the source of the river and its forms",
)
FILLER = "the of and a to in is on for with this that work file project text page software code document material it are by from which may see terms be as at or an no not our own he she they was were been has have had but all one two "
FILLER = (FILLER + "der die das und von mit en la le les des un une que el los las para por con su se").split()

NONE, UNKNOWN = "none", "unknown"
CLASSES = (NONE, UNKNOWN, *TEMPLATES)
BITS = 16
#: Training paragraphs that an n-gram must be in to count.
LEAST_PARAGRAPHS = 3
GRAMS = (1, 2, 3)
#: Least calibrated probability that a paragraph states a licence.
THRESHOLD = 0.5
#: Words that a template of more than twelve words may lack in a paragraph, as a share; shorter ones none.
LACKING = 0.1
#: Words before and behind a wrapped statement that are judged with it, as many as the samples have at most.
BEFORE, BEHIND = 8, 12
#: Words on each side of a line end that are judged together: the longest statement has as many.
AROUND = 20

#: Everything but ASCII letters and digits and bytes of other characters separates words.
SEPARATOR = np.ones(256, bool)
SEPARATOR[0x30:0x3A] = SEPARATOR[0x41:0x5B] = SEPARATOR[0x61:0x7B] = SEPARATOR[0x80:] = False


@dataclass
class Model:
    weights: np.ndarray  # (slots, classes)
    bias: np.ndarray
    used: np.ndarray  # slots that count
    templates: list[tuple[int, np.ndarray]]  # class, word hashes in order
    temperature: float = 1.0


def _words(texts: list[str]) -> C.Segments:
    return C.segments(C.column(pa.array(texts, pa.string())), SEPARATOR, lower=True)


_COMMON = np.unique(_words([" ".join(FILLER)]).hash)


def _slots(words: C.Segments) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of n-grams and their first words, for each n; n-grams of common words only are left out."""
    shift = np.uint64(64 - BITS)
    telling = np.concatenate([[0], np.cumsum(~np.isin(words.hash, _COMMON))])
    out = []
    for n in GRAMS:
        hashes, at = C.windows(words, n)
        some = telling[at + n] > telling[at]
        out.append(((hashes[some] >> shift).astype(np.int32), at[some]))
    return out


def samples(seed: int = 1, each: int = 60) -> tuple[list[str], np.ndarray]:
    """Labelled paragraphs: templates with words before and behind, others' statements, prose."""
    r = random.Random(seed)
    pad = lambda n: " ".join(r.choice(FILLER) for _ in range(r.randint(0, n)))
    texts, y = [], []
    for k, (_, lines) in enumerate(TEMPLATES.items()):
        for i in range(each):
            texts.append(f"{pad(8)} {lines[i % len(lines)]} {pad(12)}")
            y.append(2 + k)
    for label, lines in ((UNKNOWN, UNNAMED), (NONE, PROSE)):
        for i in range(3 * each):
            line = lines[i % len(lines)].split()
            cut = r.randint(0, 2) if label == NONE else 0
            line = ["".join(r.choice("aeioubdfglmnrst") for _ in range(r.randint(3, 9))) if w == "widget" else w for w in line]
            texts.append(f"{pad(8)} {' '.join(line[cut:])} {pad(12)}")
            y.append(CLASSES.index(label))
    for _ in range(20 * each):  # common words among words that no statement has
        words = [r.choice(FILLER) if r.random() < 0.5 else "".join(r.choice("aeiourstnl") for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 30))]
        texts.append(" ".join(words))
        y.append(0)
    for _ in range(12 * each):  # prose, and words of statements out of order
        words = [r.choice(FILLER) if r.random() < 0.8 else r.choice(r.choice(r.choice(list(TEMPLATES.values()))).split()) for _ in range(r.randint(1, 30))]
        texts.append(" ".join(words))
        y.append(0)
    return texts, np.array(y)


def scores(model: Model, words: C.Segments) -> np.ndarray:
    """Log-odds of the classes for each text of ``words``: (texts, classes)."""
    out = np.tile(model.bias.astype(np.float64), (len(words.first) - 1, 1))
    doc = words.doc()
    for slots, at in _slots(words):
        pick = model.used[slots]
        np.add.at(out, doc[at[pick]], model.weights[slots[pick]])
    return out / model.temperature


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(seed: int = 1, epochs: int = 40, rate: float = 0.5, penalty: float = 1e-4) -> Model:
    """Fit on four fifths of the labelled paragraphs; the temperature on the rest."""
    texts, y = samples(seed)
    order = np.random.default_rng(seed).permutation(len(texts))
    hold, learn = order[: len(order) // 5], order[len(order) // 5 :]
    model = Model(np.zeros((1 << BITS, len(CLASSES)), np.float32), np.zeros(len(CLASSES)), np.zeros(1 << BITS, bool), [])
    words = _words([texts[i] for i in learn])
    doc = words.doc()
    rows = [(slots, doc[at]) for slots, at in _slots(words)]
    slot, of = np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows])
    # n-grams of a paragraph or two say nothing about others
    pair = np.unique(slot.astype(np.int64) * len(learn) + of)
    model.used = np.bincount(pair // len(learn), minlength=1 << BITS) >= LEAST_PARAGRAPHS
    stay = model.used[slot]
    slot, of = slot[stay], of[stay]
    seen = np.full(model.weights.shape, 1e-6, np.float32)
    target = np.eye(len(CLASSES))[y[learn]]
    for _ in range(epochs):
        e = (softmax(scores(model, words)) - target) / len(learn) * 50
        g = np.zeros_like(model.weights)
        np.add.at(g, slot, e[of].astype(np.float32))
        g += penalty * model.weights
        seen += g * g
        model.weights -= rate * g / np.sqrt(seen) * 0.2
        model.bias -= 0.02 * e.sum(0)
    held = scores(model, _words([texts[i] for i in hold]))
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(held / t)[np.arange(len(hold)), y[hold]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    model.templates = [(2 + k, _words([line]).hash) for k, lines in enumerate(TEMPLATES.values()) for line in lines]
    return model


def subsequence(template: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Longest common subsequences of a template with the words' beginnings, by their lengths."""
    run = np.zeros(len(words) + 1, np.int64)  # row by row
    for t in template:
        new = np.maximum(run[1:], run[:-1] + (words == t))
        run = np.concatenate([[0], np.maximum.accumulate(new)])
    return run


def in_order(template: np.ndarray, words: np.ndarray) -> float:
    """Share of a template's words that a paragraph has in the same order, close together."""
    best = 0
    for begin in np.flatnonzero(words == template[0]):
        best = max(best, int(subsequence(template, words[begin : begin + 2 * len(template) + 4])[-1]))
    return best / len(template)


def least_share(template: np.ndarray) -> float:
    return 1 - LACKING if len(template) > 12 else 1


def classify(model: Model, words: C.Segments, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and probability of the given lines."""
    return classify_ranges(model, words, words.first[line], words.first[line + 1])


def classify_ranges(model: Model, words: C.Segments, begin: np.ndarray, end: np.ndarray, core: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class and probability of the given ranges of words; templates are looked for in their cores."""
    core = (begin, end) if core is None else core
    n = end - begin
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(begin - first[:-1], n) + np.arange(first[-1])
    some = C.Segments(words.start[at], words.end[at], words.hash[at], first)
    p = softmax(scores(model, some))
    stated = 1 - p[:, 0]
    kind = np.where(stated >= THRESHOLD, 1 + np.argmax(p[:, 1:], axis=1), 0)
    for i in np.flatnonzero(kind > 0):
        own = words.hash[core[0][i] : core[1][i]]
        # the named family first; then any, the longest template first
        fits = [(share, len(t), k) for k, t in model.templates if (share := in_order(t, own)) >= least_share(t)]
        named = [f for f in fits if f[2] == kind[i]]
        if named and max(named) >= max(fits):
            continue
        kind[i] = max(fits)[2] if fits else 1
    return kind, stated


def blocks(col: C.Column, lines: C.Segments) -> np.ndarray:
    """Number of each line's block; empty lines and lines of white space only end a block."""
    if not len(lines):
        return np.zeros(0, np.int64)
    ink = np.concatenate([[0], np.cumsum(~C.IS_SPACE[col.data])])
    blank = ink[lines.end] == ink[lines.start]
    doc = lines.doc()
    new = (doc[1:] != doc[:-1]) | (lines.start[1:] - lines.end[:-1] > 1) | blank[1:] | blank[:-1]
    return np.concatenate([[0], np.cumsum(new)])


def wrapped(model: Model, words: C.Segments, line: np.ndarray, block: np.ndarray, long: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words over several lines of a block, or in a ``long`` line, that hold enough of a template; overlapping ones are one."""
    end = np.searchsorted(block, block, "right")
    more = (line[end - 1] > line) | long[line]  # or further lines of the block follow
    found = []
    for _, t in model.templates:
        begin = np.flatnonzero(more & (words.hash == t[0]))
        if not len(begin):
            continue
        at = begin[:, None] + np.arange(2 * len(t) + 4)
        inside = np.isin(words.hash[np.minimum(at, len(words) - 1)], t) & (at < end[begin][:, None])
        for i in begin[inside.sum(1) >= least_share(t) * len(t)].tolist():
            run = subsequence(t, words.hash[i : min(i + 2 * len(t) + 4, end[i])])
            j = i + int(np.argmax(run))
            if run[-1] / len(t) >= least_share(t) and (line[j - 1] > line[i] or long[line[i]]):
                found.append((i, j))
    out: list[tuple[int, int]] = []
    for i, j in sorted(found):
        if out and i < out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def statements(model: Model, col: C.Column, lines: C.Segments, words: C.Segments, telling: np.ndarray) -> list[tuple[int, int, int, float]]:
    """First line, last line, class and probability of all statements, in order.

    Lines are asked one by one; then templates that are wrapped or in long lines, which stand for what
    their lines alone said of the same family or of none known; then, for statements of no known family,
    the words around each line end within a block and overlapping windows of long lines, where no
    statement is yet.
    """
    line = np.searchsorted(lines.start, words.start, "right") - 1
    block = blocks(col, lines)[line]
    slots, at = _slots(words)[0]
    tell = np.zeros(len(words), bool)
    tell[at] = telling[slots]
    by_line = C.Segments(words.start, words.end, words.hash, np.searchsorted(line, np.arange(len(lines) + 1)))
    ask = np.flatnonzero(np.bincount(line[tell], minlength=len(lines)) >= 2)
    found = {}
    if len(ask):
        kind, p = classify(model, by_line, ask)
        found = {(i, i): (k, q) for i, k, q in zip(ask.tolist(), kind.tolist(), p.tolist()) if k}
    long = np.diff(by_line.first) > 2 * AROUND
    if not long.any() and (not len(words) or block[-1] == line[-1]):  # every line is a block
        return [(*x, *y) for x, y in sorted(found.items())]
    first, last = np.searchsorted(block, block, "left"), np.searchsorted(block, block, "right")
    taken = np.zeros(len(lines), bool)
    taken[[i for i, _ in found]] = True
    if ranges := wrapped(model, words, line, block, long):
        i, j = np.array(ranges).T
        kind, p = classify_ranges(model, words, np.maximum(i - BEFORE, first[i]), np.minimum(j + BEHIND, last[i]), (i, j))
        for a, b, k, q in zip(line[i].tolist(), line[j - 1].tolist(), kind.tolist(), p.tolist()):
            if k > 1:
                for c in range(a, b + 1):
                    if found.get((c, c), (0,))[0] in (1, k):
                        del found[c, c]
                found[a, b] = (k, q)
                taken[a : b + 1] = True
    place = np.arange(len(words)) - by_line.first[line]
    ends = np.append(False, (line[1:] != line[:-1]) & (block[1:] == block[:-1]))
    cut = np.flatnonzero(ends | long[line] & (place > 0) & (place % AROUND == 0))
    i, j = np.maximum(cut - AROUND, first[cut]), np.minimum(cut + AROUND, last[cut])
    many = np.concatenate([[0], np.cumsum(tell)])
    used = np.concatenate([[0], np.cumsum(taken[line])])
    both = (many[cut] > many[i]) & (many[j] > many[cut])  # else one short line has all, and was asked
    some = (both | (long[line[cut]] | long[line[cut - 1]]) & (many[j] >= many[i] + 2)) & (used[j] == used[i])
    i, j = i[some], j[some]
    if len(i):
        own = np.flatnonzero(tell)
        a, b = own[many[i]], own[many[j] - 1]
        kind, p = classify_ranges(model, words, np.maximum(a - BEFORE, i), np.minimum(b + 1 + BEHIND, j))
        for x in np.flatnonzero(kind == 1):
            c, d = int(line[a[x]]), int(line[b[x]])
            different = np.unique(words.hash[a[x] : b[x] + 1][tell[a[x] : b[x] + 1]])  # not one word again and again
            if len(different) > 1 and not taken[c : d + 1].any():
                found[c, d] = (1, float(p[x]))
                taken[c : d + 1] = True
    return [(*x, *y) for x, y in sorted(found.items())]


_FOUND = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType())])
_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_paragraphs", T.LongType()), T.StructField("licences", T.ArrayType(_FOUND))])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_paragraphs, licences (start, end, family, probability).

    Paragraphs are the non-empty lines of the whole text; start and end are bytes of UTF-8, of a statement
    that is wrapped over several lines from the first one's start to the last one's end.  What has fewer
    than two words that statements have and common prose has not is no statement.  A null text has no
    paragraphs; repeated rows are scanned each; an empty table gives an empty table; further columns
    are left out.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train())  # 4 MB, fixed
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        telling = np.zeros(1 << BITS, bool)
        telling[_slots(_words([" ".join((*UNNAMED, *(x for lines in TEMPLATES.values() for x in lines)))]))[0][0]] = True
        for batch in batches:
            whole = C.column(batch.column(1))
            for lo, hi in C.slices(whole):
                col = whole.part(lo, hi)
                lines = C.segments(col, C.IS_NEWLINE)
                # words of lines: cut at all separators, line ends among them
                words = C.segments(col, SEPARATOR, lower=True)
                doc = lines.doc()
                found: list[list] = [[] for _ in range(hi - lo)]
                for a, b, k, q in statements(m, col, lines, words, telling):
                    base = int(col.offsets[doc[a]])
                    found[doc[a]].append({"start": int(lines.start[a]) - base, "end": int(lines.end[b]) - base, "family": CLASSES[k], "probability": q})
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(lines.first)), pa.array(found, kinds)], names=_OUT.names)

    return docs.mapInArrow(tidy(work), _OUT)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    spans = F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join(families, ",").alias("families"), F.array_join(spans, ",").alias("spans"))
