"""Mixing sources to target weights by systematic sampling.

Each document of a source with target ``t`` and size ``s`` has ``t / s`` expected copies.  A prefix
sum of expected copies runs through the source in a fixed order, one random offset is added, and a
document is emitted once for each integer boundary that its stretch crosses.  The order puts sizes
of one bit length together, so that each stretch of sizes is sampled at the same rate and the words
taken stay near the target.

Nothing is sorted in one place: a source is cut into blocks (bit length of the size, id modulo the
number of blocks), blocks are counted, the few block counts are summed up in order, and ranks within
a block are added.  A source that holds a third of all rows has as many blocks as its rows need.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, with_row

#: Targets stop at so many times the size of their source.
MOST_COPIES = 3
#: Rows that a block of one source holds on average, at most.
BLOCK_ROWS = 1 << 12
#: Blocks of a range: prefix sums of a range are one task.
RANGE_BITS = 12
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def offset_of(seed: int) -> float:
    """The random offset in [0, 1) that belongs to a seed."""
    return random.Random(seed).random()


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sized`` has source and size.  Sources in code point order, null last, weigh ``weights`` in
    turn and share the sum of all sizes; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight until none is above.  A source of size 0 has target 0.

    The fixed point needs no loop: sources reach their cap in the order of cap / weight, so a
    running sum in that order tells where the sharing level lies.  The windows run over one row per
    source, after the aggregation.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    wt = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", wt.cast("long")).withColumn("cap", F.col("source_size") * F.lit(most))
    full = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_from", F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)))
    )
    # capped when the level reached with all earlier caps spent is above this source's own cap
    capped = F.col("cap") * F.col("w_from") <= (F.col("total") - F.col("cap_before")) * F.col("w")
    per = per.withColumn("capped", capped)
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    open_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    share = ((F.col("total") - spent) * F.col("w")).cast("double") / open_w.cast("double")
    return per.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    weights=WEIGHTS,
    most: int = MOST_COPIES,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` tells how often the mix holds the document, ``taken = copies * size`` its words.
    Nulls: a null text has size 0; a null source is a source of its own, the last; a null id sorts
    first.  Documents of size 0 are counted like others and take 0 words.  Repeated rows are rows of
    their own.  An empty table gives an empty table.  Equal input gives equal output.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = kept(sized, "sized")  # texts are read once; ids, sources and sizes are small
    return systematic(sized, source_targets(sized, weights, most), seed)


def systematic(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Systematic sampling of ``sized`` (doc_id, source, size) to ``targets``."""
    n_blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / F.lit(BLOCK_ROWS)))
    counted = sized.agg(n_blocks.alias("n_blocks"))
    bits = F.length(F.bin(F.col("size")))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.col("size").cast("string")))
    block = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") % F.col("n_blocks")
    # source_key: null sources group and join like others
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = (
        sized.crossJoin(F.broadcast(counted))  # one row
        .select("doc_id", "source", "size", key.alias("source_key"), bits.alias("bits"), block.alias("block"))
    )
    blocks = rows.groupBy("source_key", "bits", "block").agg(F.count("*").alias("n"))
    # prefix sums over ranges of blocks, then within each range
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("range", F.shiftright("block", RANGE_BITS))
    ranges = blocks.groupBy("source_key", "bits", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("source_key", "bits", "range", upto(Window.partitionBy("source_key").orderBy("bits", "range")).alias("lower"))
    blocks = blocks.withColumn("inside", upto(Window.partitionBy("source_key", "bits", "range").orderBy("block"))).join(ranges, ["source_key", "bits", "range"])
    blocks = blocks.select("source_key", "bits", "block", (F.col("lower") + F.col("inside")).alias("before"))
    targets = targets.select(key.alias("source_key"), "source_size", "target")
    blocks = blocks.join(targets, "source_key")
    within = Window.partitionBy("source_key", "bits", "block").orderBy("size", "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(within)).join(blocks, ["source_key", "bits", "block"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = F.col("before") + F.col("rank")
    u = F.lit(offset_of(seed))
    copies = (F.floor(rate * k + u) - F.floor(rate * (k - 1) + u)).cast("long")
    return rows.withColumn("copies", copies).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Rows of ``docs``, all columns, each as often as the mix holds it.

    Rows equal in identifier, source and size share their copies, the earlier texts first, then the
    smaller digests of all columns.  Nulls and empty tables as for :func:`mix`; columns may have any names.
    """
    mixed = mix(docs, id_col, text_col, source_col, seed, weights, most)
    mixed = mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    rows = with_row(docs, id=F.col(id_col).cast("long"), own_source=F.col(source_col), own_size=word_count(F.col(text_col)))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size"))
    rows = rows.join(mixed, same)
    # only rows that share all three are sorted by text
    turn = F.row_number().over(Window.partitionBy("id", "own_source", "own_size").orderBy(F.col("row").getField(text_col), F.when(F.col("rows") > 1, F.sha2(F.to_json("row"), 256))))
    own = F.floor(F.col("copies") / F.col("rows")) + (turn <= F.col("copies") % F.col("rows")).cast("long")
    rows = rows.withColumn("own", own.cast("int")).filter("own > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "own"))).select("row.*")


def oracle_sql(seed: int = 17, weights=WEIGHTS, most: int = MOST_COPIES) -> str:
    """The same in DuckDB, ranks taken over each whole source."""
    return f"""
    WITH sized AS (
      SELECT doc_id, source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
      FROM documents),
    n AS (SELECT greatest(1, CAST(ceil(count(*) / {BLOCK_ROWS}.0) AS BIGINT)) AS n_blocks FROM sized),
    per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (
      SELECT *, source_size * {most} AS cap,
             (list_value({', '.join(map(str, weights))}))[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} + 1] AS w
      FROM per),
    ordered AS (
      SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
      FROM weighed),
    capped AS (SELECT *, cap * w_from <= (total - cap_before) * w AS full_ FROM ordered),
    targets AS (
      SELECT source, source_size,
             CASE WHEN full_ THEN CAST(cap AS DOUBLE)
                  ELSE CAST((total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) * w AS DOUBLE)
                       / CAST(sum(CASE WHEN NOT full_ THEN w END) OVER () AS DOUBLE) END AS target
      FROM capped),
    ranked AS (
      SELECT s.doc_id, s.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY s.source ORDER BY length(bin(s.size)),
               CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), 'n' || s.size)), 1, 8) AS BIGINT) % n_blocks,
               s.size, s.doc_id NULLS FIRST) AS k
      FROM sized s CROSS JOIN n JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(floor(rate * k + {offset_of(seed)!r}) - floor(rate * (k - 1) + {offset_of(seed)!r}) AS BIGINT) * size AS taken
    FROM ranked
    """
