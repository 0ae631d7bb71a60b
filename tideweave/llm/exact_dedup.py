"""Exact duplicates by a log-structured merge index over digests of normalised texts.

1. Memtables.  Each task normalises texts, hashes them and holds the distinct texts of a bounded
   number of bytes.  A text whose digest is already there is compared byte by byte.  A full memtable
   is flushed as a run: entries sorted by digest, cut by digest range, with a Bloom filter for each
   range.  Of a text that a run holds many times only one entry, the leader, goes on.
2. Compaction.  The runs of one digest range are merged level by level.  A run's digests are first
   held against the levels' filters; only those that pass are looked up.  Compaction keeps the
   smallest identifier of a digest and reports hits: digests that more than one run holds.
3. Verification.  The leaders of hits fetch their texts; equal digests are compared byte by byte and
   every text gets the smallest identifier of its bytes.

Only digests of leaders are shuffled for all documents, and whole texts only for hits.  A group of
copies that holds a third of all rows has one leader per memtable.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, filter_of, kept, may_hold, shuffle_width, tidy, with_row

_RUN = re.compile(rb"[\x20\x09-\x0D]+")
SPACES = r"[\x20\x09-\x0D]+"
#: Text bytes that a memtable holds.
MEMTABLE_BYTES = 8 << 20
#: Documents for one digest range, about.
RANGE_ROWS = 1 << 17
#: Runs of a level that are merged into one of the next level.
FAN_IN = 8

RUNS = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("run", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("leader_id", T.LongType()),
        T.StructField("in_run", T.LongType()),  # copies of the text in the run
        T.StructField("n", T.LongType()),  # the same on the leader's row, else 0
        T.StructField("filter", T.BinaryType()),  # on the first entry of a range
    ]
)
_HITS = T.StructType([RUNS["digest"], RUNS["run"], RUNS["leader_id"], RUNS["n"]])


def normalised(text: bytes) -> bytes:
    return _RUN.sub(b" ", text)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _id_key(i: int | None) -> tuple[bool, int]:
    """Nulls are larger than all other identifiers."""
    return i is None, i or 0


class Bloom:
    """A Bloom filter over digests: four probes, eight bits or more for each digest."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, digests: np.ndarray) -> Bloom:
        self = cls(np.zeros(1 << max(0, (8 * len(digests) - 1).bit_length() - 6), np.uint64))
        p = self.probes(digests).ravel()
        np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        return self

    def probes(self, digests: np.ndarray) -> np.ndarray:
        parts = np.frombuffer(digests.tobytes(), "<u8").reshape(len(digests), -1)[:, :4]
        return parts >> np.uint64(64 - (64 * len(self.words) - 1).bit_length())

    def might_hold(self, digests: np.ndarray) -> np.ndarray:
        p = self.probes(digests)
        return ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Memtable:
    """Distinct texts and all identifiers of a bounded number of bytes, by digest."""

    def __init__(self, digest):
        self.digest, self.held, self.bytes = digest, {}, 0

    def put(self, doc_id: int | None, text: bytes) -> None:
        d = self.digest(text)
        self.bytes += 40  # an identifier
        for same, ids in self.held.setdefault(d, []):
            if same == text:  # byte verification
                ids.append(doc_id)
                return
        self.held[d].append((text, [doc_id]))
        self.bytes += len(text) + 64

    def flush(self, run: str, ranges: int) -> pa.RecordBatch:
        rows = []
        for d in sorted(self.held):
            bucket = int.from_bytes(d[:4], "big") * ranges >> 32
            for k, (_, ids) in enumerate(self.held[d]):
                ids.sort(key=_id_key)
                # a second text of the same digest is a run of its own
                own = run if not k else f"{run}+{k}"
                rows += [(bucket, d, own, i, ids[0], len(ids), 0 if j else len(ids), None) for j, i in enumerate(ids)]
        at = 0
        while at < len(rows):  # rows are in digest order, so in range order
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            f = Bloom.of(np.array([x[1].ljust(32, b"\0") for x in rows[at:to] if x[6]], "V32"))
            rows[at] = (*rows[at][:7], f.words.tobytes())
            at = to
        self.held, self.bytes = {}, 0
        columns = zip(*rows) if rows else [[] for _ in RUNS]
        types = [pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=RUNS.names)


def flushed_runs(docs: DataFrame, ranges: int, memtable_bytes: int = MEMTABLE_BYTES, digest=sha256) -> DataFrame:
    """Runs of all documents (doc_id, text): see RUNS."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, table = TaskContext.get().partitionId(), 0, Memtable(digest)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            text = batch.column(1).cast(pa.binary())
            for i, t in zip(ids, text):
                table.put(i, normalised(t.as_py() or b""))
                if table.bytes >= memtable_bytes:
                    yield table.flush(f"{part}.{k}", ranges)
                    k += 1
        if table.held:
            yield table.flush(f"{part}.{k}", ranges)

    return docs.mapInArrow(tidy(work), RUNS)


class Level:
    """Sorted digests with the rows that hold the smallest identifier, and their filter."""

    def __init__(self, digests: np.ndarray, rows: np.ndarray, bloom: Bloom):
        self.digests, self.rows, self.bloom = digests, rows, bloom


def compact(digests: np.ndarray, ids: np.ndarray, runs: list[np.ndarray], filters: list[Bloom]) -> np.ndarray:
    """Rows whose digest more than one run holds.

    ``runs`` are the rows of each run in digest order; ids decide which row a level keeps.
    """
    hit = np.zeros(len(digests), bool)
    levels: list[list[Level]] = [[]]
    for rows, bloom in zip(runs, filters):
        new = np.ones(len(rows), bool)
        own = digests[rows]
        for level in (x for tier in levels for x in tier):
            ask = np.flatnonzero(new & level.bloom.might_hold(own))
            at = np.searchsorted(level.digests, own[ask])
            at[at == len(level.digests)] = 0
            found = level.digests[at] == own[ask]
            ask, at = ask[found], at[found]
            hit[rows[ask]] = hit[level.rows[at]] = True
            less = ids[rows[ask]] < ids[level.rows[at]]
            level.rows[at[less]] = rows[ask[less]]
            new[ask] = False
        if new.any():
            levels[0].append(Level(own[new], rows[new], bloom))
        for t, tier in enumerate(levels):
            if len(tier) >= FAN_IN:
                both = np.concatenate([x.rows for x in tier])
                order = both[np.argsort(digests[both], kind="stable")]
                if t + 1 == len(levels):
                    levels.append([])
                levels[t + 1].append(Level(digests[order], order, Bloom.of(digests[order])))
                tier.clear()
    return np.flatnonzero(hit)


def hits(runs: DataFrame) -> DataFrame:
    """Leaders (digest, run, leader_id, n) of digests that more than one run holds."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("digest", "ascending")]).combine_chunks()
        digests = np.array([x.ljust(32, b"\0") for x in table["digest"].to_pylist()], "S32")
        ids = table["leader_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        names = np.array(table["run"].to_pylist())
        cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
        rows = np.split(np.arange(len(names)), cuts[1:])
        blooms = []
        held = table["filter"].to_pylist()
        for r in rows:
            kept_ = [held[i] for i in r if held[i] is not None]
            # a run of second texts shares its range's filter with the first
            bloom = Bloom(np.frombuffer(kept_[0], np.uint64)) if kept_ else Bloom.of(digests[r])
            blooms.append(bloom)
        found = compact(digests, ids, rows, blooms)
        return table.select(_HITS.names).take(pa.array(found))

    leaders = runs.filter("n > 0").select("bucket", "digest", "run", "leader_id", "n", "filter")
    return leaders.groupBy("bucket").applyInArrow(work, _HITS)


def wanted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` that may be leaders of hits, by a filter of fixed size that is sent to all tasks.

    The fuller it is the more rows pass; the join that follows is exact in any case.
    """
    return may_hold(docs, "doc_id", filter_of(found, "leader_id")).filter("maybe").drop("maybe")


def verified(docs: DataFrame, found: DataFrame, digest=sha256) -> DataFrame:
    """Leaders of hits (run, leader_id) with keep_id, keep_run and group_size after comparing bytes."""
    schema = T.StructType([RUNS["run"], RUNS["leader_id"], RUNS["n"], T.StructField("keep_id", T.LongType()), T.StructField("keep_run", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, last = None, [], None  # the digest, its different texts with their keepers
        for batch in batches:
            out = []
            d, run, lead, n = (batch.column(k).to_pylist() for k in range(4))
            for j, t in enumerate(batch.column(4).cast(pa.binary())):
                text = normalised(t.as_py() or b"")
                if digest(text) != d[j] or last == (d[j], run[j], lead[j]):
                    continue  # another row of the same identifier
                if d[j] != now:
                    now, texts = d[j], []
                for same, i, r in texts:
                    if same == text:
                        break
                else:
                    i, r = lead[j], run[j]
                    texts.append((text, i, r))
                out.append((run[j], lead[j], n[j], i, r))
                last = (d[j], run[j], lead[j])
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    texts = wanted(docs, found).select(F.col("doc_id").alias("_id"), "text").join(found, F.col("_id").eqNullSafe(F.col("leader_id")))
    texts = texts.select("digest", "run", "leader_id", "n", "text")
    order = ["digest", F.col("leader_id").asc_nulls_last(), "run"]
    rows = texts.repartition("digest").sortWithinPartitions(*order).mapInArrow(tidy(work), schema)
    group = Window.partitionBy("keep_run", "keep_id")
    return rows.select("run", "leader_id", "keep_id", "keep_run", F.sum("n").over(group).alias("group_size"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    memtable_bytes: int = MEMTABLE_BYTES,
    range_rows: int = RANGE_ROWS,
    digest=sha256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_digest.

    Texts are equal when their bytes are after replacing each run of ASCII white space by a space.
    Of equal texts the smallest identifier stays; null identifiers come last.  A null text counts as
    empty; rows of equal text and identifier are one group, and one of them is ``kept``.  An empty
    table gives an empty table; further columns are left out.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = max(shuffle_width(docs.sparkSession), -(-docs.count() // range_rows))
    runs = kept(flushed_runs(docs, ranges, memtable_bytes, digest), "runs")
    found = kept(hits(runs), "hits")
    final = verified(docs, found, digest).select(
        F.col("run").alias("_run"), F.col("leader_id").alias("_lead"), "keep_id", "keep_run", "group_size"
    )
    same = (F.col("run") == F.col("_run")) & F.col("leader_id").eqNullSafe(F.col("_lead"))
    rows = runs.select("digest", "run", "doc_id", "leader_id", "in_run", "n").join(final, same, "left")
    across = F.col("keep_run").isNotNull()
    return rows.select(
        "doc_id",
        F.when(across, F.col("keep_id")).otherwise(F.col("leader_id")).alias("keep_id"),
        F.coalesce("group_size", "in_run").alias("group_size"),
        ((F.col("n") > 0) & (~across | (F.col("keep_run") == F.col("run")) & F.col("keep_id").eqNullSafe(F.col("leader_id")))).alias("kept"),
        F.col("digest").alias("text_digest"),
    )


def digest_columns(groups: DataFrame) -> DataFrame:
    """The columns of the query."""
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns: of equal texts the one with the smallest identifier, once.

    A null text counts as empty, a null identifier as larger than all others.  Of rows with equal text
    and identifier the one with the smallest digest of all its columns stays.  An empty table gives an
    empty table; columns may have any names.  Rows whose identifier no dropped row has, by a filter of
    fixed size, stay where they are; only the others are joined.
    """
    groups = kept(exact_groups(docs, id_col, text_col).select("doc_id", "kept", "text_digest"), "groups")
    rows = with_row(docs, id=F.col(id_col).cast("long"), text=F.col(text_col))
    rows = may_hold(rows, "id", filter_of(groups.filter("NOT kept"), "doc_id"))
    stay = groups.filter("kept").select("doc_id", F.lower(F.hex("text_digest")).alias("digest"))
    own = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "), 256)
    asked = rows.filter("maybe").select("id", own.alias("own"), "row")
    found = asked.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("id", "own").orderBy(F.sha2(F.to_json("row"), 256)))
    once = found.withColumn("turn", turn).filter("turn = 1")
    return rows.filter("NOT maybe").select("row").unionByName(once.select("row")).select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
