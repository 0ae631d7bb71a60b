"""N-gram Jaccard self-join by vertical partitioning.

All word n-grams have one global order, by hash.  The order is cut into fragments, so every document
is cut into pieces, one for each fragment that it has n-grams in.

1. Equal sets form a class; only one document of a class, its representative, goes on.
2. Fragments.  A task gets the pieces of one fragment and tells which n-grams more than one class
   has.  An n-gram that several classes of one input slice share is known to be shared there: its
   occurrences skip the fragment and one marker goes in their place, so a fragment gets one entry
   for each n-gram and slice at most, however common the n-gram is.
3. A class with so many n-grams of its own that no partner can reach the similarity is done.  The
   others keep the n-grams they share; no other n-gram can be in an overlap.
4. Candidates share an n-gram of their prefixes, the rarest n-grams of a set that any partner must
   share one of.  First each class is compared with a few leaders, which merges large groups; then
   all candidates of different components are compared.  So a group of thousands of near copies is
   not expanded into pairs and no link between components is missed.
5. A pair's overlap is counted in each vertical piece on its own, summed, and held against the
   sizes.

An n-gram is the number of its fragment and the last 48 bits of its hash.  Two given n-grams of one
fragment collide with a chance of 2**-48: that can make a class a candidate for nothing, but changes
an overlap only where it happens within one pair of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcols as C
from .components import components
from .shared import bounded_batches, filter_of, kept, may_hold, shuffle_width, tidy, with_row

WIDTH = 5
#: Similarity as a fraction.
SIMILAR = (75, 100)
#: N-grams for one fragment, about.
FRAGMENT_GRAMS = 1 << 21
#: Vertical pieces that overlaps are counted in, a power of two.
PIECES = 4
#: Leaders that a class is compared with first.
LEADERS = 2
_NO_ID = (1 << 63) - 1
_MANY = -1  # place of the marker among a row's documents


def gram_sets(col: C.Column, width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one n-gram."""
    words = C.segments(col, lower=True)
    keys, place = C.windows(words, width)
    cut = np.searchsorted(place, words.first)
    out = []
    for d in range(len(col)):
        if cut[d + 1] > cut[d]:
            out.append(np.unique(keys[cut[d] : cut[d + 1]]))
            continue
        n = words.first[d + 1] - words.first[d]
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        else:
            own = words.hash[words.first[d] : words.first[d + 1]].tobytes() + bytes([int(n)])
            out.append(np.frombuffer(hashlib.blake2b(own, digest_size=8).digest(), np.uint64))
    return out


def class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType())])


def sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, size of the set, and its class (null if empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = C.column(batch.column(1))
            for lo, hi in C.slices(whole):
                grams = gram_sets(whole.part(lo, hi), width)
                cls = [class_of(g) if len(g) else None for g in grams]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(g) for g in grams], pa.int64()), pa.array(cls, pa.int64())], names=_SETS.names)

    return docs.mapInArrow(tidy(work), _SETS)


_PACKED = T.StructType(
    [T.StructField("fragment", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("doc_ids", "classes", "sizes", "lengths", "grams")]
)


def _packed_grams(grams: np.ndarray) -> bytes:
    """Six bytes each; the fragment stands for the rest."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked_grams(data: bytes, fragment: int) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64(fragment & 0xFFFF) << np.uint64(48)


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)


def packed(docs: DataFrame, width: int, fragments: int) -> DataFrame:
    """For each slice of the input and fragment one row with the pieces of its documents.

    Fragment ``-1 - k`` holds what skips fragment k: n-grams that several classes of the slice share.
    """

    def row(number: int, ids, cls, size, doc: np.ndarray, grams: np.ndarray, marks: np.ndarray) -> tuple:
        who, lengths = np.unique(doc, return_counts=True)  # doc is ascending
        pick = lambda x: np.append(x[who], np.full(int(len(marks) > 0), _MANY, np.int64)).tobytes()
        lengths = np.append(lengths, np.full(int(len(marks) > 0), len(marks), np.int64)).astype(np.int32)
        return number, pick(ids), pick(cls), pick(size), lengths.tobytes(), _packed_grams(np.concatenate([grams, marks]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = C.column(batch.column(1))
            all_ids = batch.column(0).fill_null(_NO_ID).to_numpy()
            for lo, hi in C.slices(whole):
                found = gram_sets(whole.part(lo, hi), width)
                first: dict[int, int] = {}
                for d, g in enumerate(found):
                    if len(g) and ((c := class_of(g)) not in first or all_ids[lo + d] < all_ids[lo + first[c]]):
                        first[c] = d
                if not first:
                    continue
                cls, rows = np.array(list(first), np.int64), list(first.values())
                ids, size = all_ids[lo + np.array(rows)], np.array([len(found[d]) for d in rows])
                grams, doc = np.concatenate([found[d] for d in rows]), np.repeat(np.arange(len(rows)), size)
                order = np.argsort(grams, kind="stable")
                grams, doc = grams[order], doc[order]
                same = grams[1:] == grams[:-1]
                many = np.append(same, False) | np.append(False, same)
                marks = grams[many & ~np.append(False, same)]
                f, f_marks = _fragment(grams, fragments), _fragment(marks, fragments)
                out = []
                present, at = np.unique(f, return_index=True)  # a mark is one of the n-grams
                for k, lo_k, hi_k in zip(present.tolist(), at, [*at[1:], len(f)]):
                    here = slice(lo_k, hi_k)
                    m = marks[np.searchsorted(f_marks, k) : np.searchsorted(f_marks, k, "right")]
                    for number, pick, seen in ((k, ~many[here], m), (-1 - k, many[here], m[:0])):
                        g, d = grams[here][pick], doc[here][pick]
                        if len(g) or len(seen):
                            by = np.argsort(d, kind="stable")
                            out.append(row(number, ids, cls, size, d[by], g[by], seen))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=_PACKED.names)

    return docs.mapInArrow(tidy(work), _PACKED)


_SHARED = T.StructType([T.StructField("bucket", T.IntegerType()), *_PACKED.fields[1:]])


def _entries(table: pa.Table, unpack) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners' ids, classes and sizes; the place of each n-gram's owner; the n-grams."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
    ids, cls, size = (read(c, np.int64) for c in ("doc_ids", "classes", "sizes"))
    grams = np.concatenate([unpack(x) for x in table["grams"].to_pylist()])
    return ids, cls, size, np.repeat(np.arange(len(ids)), read("lengths", np.int32)), grams


def _shared_rows(grams: np.ndarray, owner: np.ndarray, cls: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of n-grams that more than one class has, or that have a marker."""
    order = np.argsort(grams)
    g = grams[order]
    same = g[1:] == g[:-1]
    mark = size[owner[order]] == _MANY
    order = order[np.append(same, False) | np.append(False, same)] if len(g) else order
    if not len(order):
        return order
    order = order[np.lexsort((cls[owner[order]], grams[order]))]
    g, of, mark = grams[order], cls[owner[order]], size[owner[order]] == _MANY
    head = np.append(True, g[1:] != g[:-1])
    group = np.cumsum(head) - 1
    is_shared = np.zeros(group[-1] + 1, bool)
    is_shared[group[np.append(False, ~head[1:] & (of[1:] != of[:-1])) | mark]] = True
    return order[is_shared[group] & ~mark]


def shared_grams(packs: DataFrame, buckets: int) -> DataFrame:
    """The n-grams that another class has too, packed for buckets of classes.

    Of equal classes the document with the smallest identifier goes on.
    """

    def work(table: pa.Table) -> pa.Table:
        number = table["fragment"][0].as_py()
        k = number if number >= 0 else -1 - number
        ids, cls, size, owner, grams = _entries(table, lambda x: _unpacked_grams(x, k))
        if number >= 0:
            stay = _shared_rows(grams, owner, cls, size)
            grams, owner = grams[stay], owner[stay]
        # one entry for each n-gram and class, the smallest document's
        order = np.lexsort((ids[owner], cls[owner], grams))
        grams, owner = grams[order], owner[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (cls[owner][1:] != cls[owner][:-1]))[: len(grams)]
        grams, owner = grams[new], owner[new]
        bucket = (cls % buckets).astype(np.int32)
        order = np.lexsort((owner, bucket[owner]))
        grams, owner = grams[order], owner[order]
        out = []
        at = np.flatnonzero(np.append(True, bucket[owner][1:] != bucket[owner][:-1])) if len(owner) else []
        for lo, hi in zip(at, [*at[1:], len(owner)]):
            who, lengths = np.unique(owner[lo:hi], return_counts=True)
            out.append((int(bucket[who[0]]), ids[who].tobytes(), cls[who].tobytes(), size[who].tobytes(), lengths.astype(np.int32).tobytes(), grams[lo:hi].tobytes()))
        columns = list(zip(*out)) if out else [[] for _ in _SHARED]
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=_SHARED.names)

    return packs.groupBy("fragment").applyInArrow(work, _SHARED)


_ALIVE = T.StructType([T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])


def living(found: DataFrame, reps: DataFrame, buckets: int, similar: tuple[int, int]) -> DataFrame:
    """Representatives that a partner can reach, with the n-grams that they share."""
    num, den = similar

    def work(table: pa.Table, chosen: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()))], names=_ALIVE.names)
        ids, cls, size, owner, grams = _entries(table, lambda x: np.frombuffer(x, np.uint64))
        c, d = chosen["cls"].to_numpy(), chosen["doc_id"].to_numpy()
        by = np.argsort(c)
        c, d = c[by], d[by]
        at = np.minimum(np.searchsorted(c, cls), len(c) - 1)
        good = (c[at] == cls) & (d[at] == ids)
        stay = good[owner]
        owner, grams = owner[stay], grams[stay]
        order = np.lexsort((grams, cls[owner]))
        owner, grams = owner[order], grams[order]
        of = cls[owner]
        new = np.append(True, (of[1:] != of[:-1]) | (grams[1:] != grams[:-1]))[: len(of)]
        owner, grams, of = owner[new], grams[new], of[new]
        who, first, many = np.unique(of, return_index=True, return_counts=True)
        n = size[owner[first]] if len(first) else first
        alive = n - many < n - (n * num + den - 1) // den + 1
        keep = np.repeat(alive, many)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[alive])]).astype(np.int32)), pa.array(grams[keep].view(np.int64)))
        return pa.table([pa.array(who[alive]), pa.array(n[alive]), lists], names=_ALIVE.names)

    reps = reps.select(F.pmod("cls", F.lit(buckets)).cast("int").alias("bucket"), "cls", "doc_id")
    return found.groupBy("bucket").cogroup(reps.groupBy("bucket")).applyInArrow(work, _ALIVE)


def prefix_room(n: Column, similar: tuple[int, int]) -> Column:
    """Length of the prefix of a set of n: any partner shares one of its n-grams."""
    num, den = similar
    return (n - F.ceil(n * num / F.lit(den)) + 1).cast("long")


def close_sizes(a: Column, b: Column, similar: tuple[int, int]) -> Column:
    num, den = similar
    return (a * num <= b * den) & (b * num <= a * den)


def overlapping(pairs: DataFrame, alive: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of classes whose similarity suffices.

    Each vertical piece is counted on its own; the partial counts are summed per pair.
    """
    num, den = similar
    piece = lambda k: F.filter("grams", lambda g: g.bitwiseAND(F.lit(PIECES - 1)) == k)
    cut = alive.select("cls", "n", F.posexplode(F.array(*(piece(k) for k in range(PIECES)))).alias("piece", "grams")).filter(F.size("grams") > 0)
    left = cut.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), "piece", F.col("grams").alias("g_a"))
    right = cut.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), "piece", F.col("grams").alias("g_b"))
    part = pairs.join(left, "a").join(right, ["b", "piece"])
    part = part.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).cast("long").alias("part"))
    total = part.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("i"))
    return total.filter(F.col("i") * den >= (F.col("n_a") + F.col("n_b") - F.col("i")) * num).select("a", "b")


def links(docs: DataFrame, per_doc: DataFrame, width: int, similar: tuple[int, int], fragment_grams: int) -> DataFrame:
    """Links (a, b) between classes: not all of them, but as many as connect all that are linked.

    ``docs`` has doc_id and text, ``per_doc`` is sets(docs), kept.
    """
    spark = docs.sparkSession
    reps = per_doc.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("doc_id"), F.first("n").alias("n"))
    total = reps.agg(F.sum("n")).first()[0] or 0
    fragments = max(shuffle_width(spark), -(-total // fragment_grams))
    found = shared_grams(packed(docs, width, fragments), fragments)
    room = prefix_room(F.col("n"), similar)
    alive = kept(living(found, reps, fragments, similar), "alive")
    # 4. prefixes in the order of how many living classes have an n-gram
    posts = alive.select("cls", F.explode("grams").alias("gram"))
    often = posts.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = posts.join(often, "gram").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("ranked"))
    own = (F.col("n") - F.size("ranked")).alias("own")  # n-grams without a partner come first in the order
    prefix = alive.select("cls", "n").join(ranked, "cls").select("cls", "n", own, "ranked").filter(room > F.col("own"))
    first_ones = F.slice("ranked", F.lit(1), (room - F.col("own")).cast("int"))
    # reach: n-grams from this one on, the most that an overlap starting here can have
    listing = F.transform(first_ones, lambda x, i: F.struct(x["gram"].alias("gram"), (F.col("n") - F.col("own") - i).alias("reach")))
    prefix = kept(prefix.select("cls", "n", "own", listing.alias("prefix")), "prefix")
    listed = prefix.select("cls", "n", "own", F.inline("prefix"))
    num, den = similar
    possible = lambda reach, a, b: reach * (num + den) >= (a + b) * num
    # a leader has few n-grams of its own, so it is near the middle of its group
    leaders = listed.groupBy("gram").agg(F.min(F.struct("own", "cls", "n", "reach")).alias("lead"))
    some = listed.join(leaders, "gram").filter((F.col("cls") != F.col("lead.cls")) & close_sizes(F.col("n"), F.col("lead.n"), similar))
    some = some.filter(possible(F.least("reach", "lead.reach"), F.col("n"), F.col("lead.n")))
    star = some.groupBy(F.col("cls").alias("b")).agg(F.slice(F.array_sort(F.collect_set(F.struct("lead.own", "lead.cls"))), 1, LEADERS).alias("leads"))
    star = star.select(F.explode("leads.cls").alias("a"), "b")
    first = kept(overlapping(star, alive, similar), "first")
    merged = components(first, rounds=2).select(F.col("node").alias("cls"), "label")
    # candidates of different components
    listed = listed.join(merged, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    by = listed.groupBy("gram", "label").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("far"))
    x, y = (by.select("gram", F.col("label").alias(f"l{k}"), F.col("low").alias(f"low{k}"), F.col("high").alias(f"high{k}"), F.col("far").alias(f"far{k}")) for k in (1, 2))
    near = (F.col("low1") * num <= F.col("high2") * den) & (F.col("low2") * num <= F.col("high1") * den)
    near &= possible(F.least("far1", "far2"), F.col("low1"), F.col("low2"))
    apart = x.join(y, (x.gram == y.gram) & (F.col("l1") < F.col("l2")) & near).select(x.gram, "l1", "l2", "low2", "high2", "far2")
    member = lambda k, name: listed.select(F.col("gram").alias(f"g{k}"), F.col("label").alias(f"m{k}"), F.col("cls").alias(name), F.col("n").alias(f"n{k}"), F.col("reach").alias(f"r{k}"))
    # only members that someone of the other component can be close to
    useful = (F.col("n1") * num <= F.col("high2") * den) & (F.col("low2") * num <= F.col("n1") * den) & possible(F.least("r1", "far2"), F.col("n1"), F.col("low2"))
    left = apart.join(member(1, "a"), (F.col("gram") == F.col("g1")) & (F.col("l1") == F.col("m1")) & useful)
    right = member(2, "b")
    fits = close_sizes(F.col("n1"), F.col("n2"), similar) & possible(F.least("r1", "r2"), F.col("n1"), F.col("n2"))
    rest = left.join(right, (F.col("gram") == F.col("g2")) & (F.col("l2") == F.col("m2")) & fits).select("a", "b").distinct()
    second = overlapping(rest, alive, similar)
    return kept(reduce(DataFrame.unionByName, [first, second]), "links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    similar: tuple[int, int] = SIMILAR,
    fragment_grams: int = FRAGMENT_GRAMS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text's set holds its
    distinct ``width``-word n-grams, or the whole sequence if it has fewer words.  Two documents link
    when Jaccard similarity is ``similar`` or more; component_id is the smallest identifier reachable
    by links.  A null text or one without words has an empty set and its own identifier.  Null
    identifiers count as larger than all others and are null as a component's.  Repeated rows are
    one class; an empty table gives an empty table; further columns are left out.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    per_doc = kept(sets(docs, width), "sets")
    found = links(docs, per_doc, width, similar, fragment_grams)
    labels = components(found).select(F.col("node").alias("cls"), "label")
    classes = per_doc.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("low"))
    classes = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = classes.join(names, "label").select("cls", "component_id")
    out = per_doc.join(classes, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Rows of ``docs``, all columns, whose identifier is its component's smallest.

    Rows that share an identifier stay or go together.  Nulls and empty tables as for
    :func:`near_duplicates`; columns may have any names.  Rows whose identifier no dropped row has, by
    a filter of fixed size, stay where they are; only the others are joined.
    """
    found = kept(near_duplicates(docs, id_col, text_col, width, similar).select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")), "verdicts")
    rows = may_hold(with_row(docs, id=F.col(id_col).cast("long")), "id", filter_of(found.filter("NOT stays"), "doc_id"))
    asked = rows.filter("maybe").join(found.filter("stays"), F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    return rows.filter("NOT maybe").select("row").unionByName(asked.select("row")).select("row.*")


def oracle_sql(width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> str:
    """The same in DuckDB, from all pairs of documents that share an n-gram."""
    num, den = similar
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + {width - 1}], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {width - 1}, 1))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE i * {den} >= (p.n + q.n - i) * {num}),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
    c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """
