"""Random edges, labels and gaps as DataFrame plans; a seed gives the same rows for the same input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys' values and the seed alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")


def remove_share(rows: DataFrame, by: list[str], keys: list[str], share: float, seed: int, up: bool = False) -> DataFrame:
    """Without a random share of each group's rows; the number removed is rounded down (or up)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, *keys), *keys))
    total = F.count("*").over(Window.partitionBy(*by))
    number = (F.ceil if up else F.floor)(total * share)
    return rows.withColumn("_place", place).withColumn("_gone", number).filter("_place > _gone").drop("_place", "_gone")


def blank_share(rows: DataFrame, by: list[str], keys: list[str], value: str, share: float, seed: int, among: Column | None = None) -> DataFrame:
    """A random share of each group's values set to null, among the rows that ``among`` holds for."""
    among = F.lit(True) if among is None else among
    marked = rows.withColumn("_among", F.coalesce(among, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*by, "_among").orderBy(draw(seed, *keys), *keys))
    number = F.floor(F.count("*").over(Window.partitionBy(*by)) * share)
    gone = F.col("_among") & (place <= number)
    return marked.withColumn("is_missing", gone).withColumn(value, F.when(~F.col("is_missing"), F.col(value))).drop("_among")


def categories(nodes: DataFrame, cluster: str, key: str, shares: dict, seed: int) -> DataFrame:
    """Adds level, drawn by the shares of the node's cluster: {cluster: {level: share}}."""
    x = draw(seed, key)
    level = None
    for c, own in shares.items():
        inner = F.lit(None).cast("string")
        edge = 0.0
        for name, p in own.items():
            inner = F.when(inner.isNull() & (x < F.lit(edge + p)), name).otherwise(inner)
            edge += p
        inner = F.coalesce(inner, F.lit(list(own)[-1]))
        level = F.when(F.col(cluster) == c, inner) if level is None else level.when(F.col(cluster) == c, inner)
    return nodes.withColumn("level", level)


def block_edges(nodes: DataFrame, block: str, inside: float, between: float, seed: int) -> DataFrame:
    """Undirected edges of a block model: a pair is drawn with its blocks' probability.

    Every pair is looked at, so this is for generated networks of some thousands of nodes.
    """
    a = nodes.select(F.col("node").alias("src"), F.col(block).alias("r"))
    b = nodes.select(F.col("node").alias("dst"), F.col(block).alias("s"))
    p = F.when(F.col("r") == F.col("s"), F.lit(inside)).otherwise(F.lit(between))
    return a.join(b, F.col("src") < F.col("dst")).filter(draw(seed, "src", "dst") < p).select("src", "dst")


def category_pairs(levels: DataFrame, same: float, group: float, other: float) -> DataFrame:
    """a >= b of all levels with a probability: the same level, the same group of levels, or neither.

    ``levels`` has level, group.
    """
    a = levels.select(F.col("level").alias("a"), F.col("group").alias("ga"))
    b = levels.select(F.col("level").alias("b"), F.col("group").alias("gb"))
    p = F.when(F.col("a") == F.col("b"), same).when(F.col("ga") == F.col("gb"), group).otherwise(other)
    return a.join(b, F.col("a") >= F.col("b")).select("a", "b", p.alias("probability"))


def run_gaps(rows: DataFrame, key: str, order: list[str], value: str, length: int) -> DataFrame:
    """For every start the series with ``length`` values from there missing: start, and value null in the gap.

    One copy of a series for each start: for series of some hundreds of points.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(key))
    rows = rows.withColumn("place", place).withColumn("_n", n)
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_n") - length + 1, F.lit(1)).cast("int"))))
    gone = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + length)
    return rows.withColumn("masked", F.when(~gone, F.col(value))).drop("_n")
