"""Agreement of covers, and graphs that are put together from communities.

Covers are memberships (node, community), each pair once.  Undirected edges (src, dst) are given once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways


def _kinds(one: DataFrame, two: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, n: how many nodes have the communities ``a`` in the first cover and ``b`` in the second."""
    side = lambda m, name: m.groupBy("node").agg(F.array_sort(F.collect_set(F.col("community").cast("string"))).alias(name))
    none = F.array().cast("array<string>")
    rows = nodes.select("node").distinct().join(side(one, "a"), "node", "left").join(side(two, "b"), "node", "left")
    return rows.groupBy(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b")).agg(F.count("*").cast("double").alias("n"))


def _ordered_pairs(kinds: DataFrame) -> DataFrame:
    """j, k, n, own: ordered pairs of nodes by common communities in both covers, and pairs of a node with itself.

    Pairs are formed between kinds of nodes that share a community, never between nodes; all others
    are one row, by subtraction.
    """
    x = kinds.withColumn("key", F.to_json(F.struct("a", "b")))
    y = x.select(F.col("key").alias("key2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    marked = lambda c: F.transform(c, lambda v: F.concat(F.lit(f"{c}:"), v))
    post = x.select("key", F.explode(F.concat(marked("a"), marked("b"))).alias("c"))
    pairs = post.join(post.withColumnRenamed("key", "key2"), "c").select("key", "key2").distinct().join(x, "key").join(y, "key2")
    common = lambda p, q: F.size(F.array_intersect(p, q))
    own = F.when(F.col("key") == F.col("key2"), F.col("n")).otherwise(0.0)
    met = pairs.select(common("a", "a2").alias("j"), common("b", "b2").alias("k"), (F.col("n") * F.col("n2")).alias("n"), own.alias("own"))
    met = met.groupBy("j", "k").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    alone = F.sum(F.when(F.size("a") + F.size("b") == 0, F.col("n")).otherwise(0.0))
    rest = kinds.agg(F.sum("n").alias("all"), alone.alias("own")).crossJoin(met.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("met")))  # one row each
    return met.unionByName(rest.select(F.lit(0).alias("j"), F.lit(0).alias("k"), (F.col("all") * F.col("all") - F.col("met")).alias("n"), "own"))


def binary_omega(one: DataFrame, two: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: agreement on whether two nodes have any common community, beyond chance, between 0 and 1."""
    pairs = _ordered_pairs(_kinds(one, two, nodes)).withColumn("m", F.col("n") - F.col("own"))
    part = lambda c: F.sum(F.when(c, F.col("m")).otherwise(0.0))
    j, k = F.col("j") > 0, F.col("k") > 0
    sums = pairs.agg(F.sum("m").alias("all"), part(j == k).alias("same"), part(j).alias("one"), part(k).alias("two"))
    p, q, agree = F.try_divide("one", "all"), F.try_divide("two", "all"), F.try_divide("same", "all")
    chance = p * q + (1 - p) * (1 - q)
    value = F.when(F.abs(1 - chance) < 1e-10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(agree - chance, 1 - chance))))
    return sums.select(agree.alias("agreement"), chance.alias("expected"), value.alias("omega"))


def match_ratio(one: DataFrame, two: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: share of ordered pairs, a node with itself included, that have equally many common communities."""
    pairs = _ordered_pairs(_kinds(one, two, nodes))
    return pairs.agg(F.try_divide(F.sum(F.when(F.col("j") == F.col("k"), F.col("n")).otherwise(0.0)), F.sum("n")).alias("ratio"))


def cosine(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: cosine of the two covers' tables of common members of two communities."""

    def table(m: DataFrame, name: str) -> DataFrame:
        m = m.select("node", F.col("community").cast("string").alias("c"))
        return m.join(m.withColumnRenamed("c", "d"), "node").groupBy("c", "d").agg(F.count("*").cast("double").alias(name))

    both = table(one, "x").join(table(two, "y"), ["c", "d"], "full").fillna(0.0, ["x", "y"])
    norm = lambda c: F.sum(F.col(c) * F.col(c))
    return both.agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(norm("x") * norm("y"))).alias("cosine"))


def weighted_conductance(edges: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """community, boundary, volume, conductance of each found community.

    A node weighs 1, and 1 / r more in a community that it has in ``truth``, where r is its number of
    communities there; it weighs 0 if it has none.
    """
    links = both_ways(edges)
    degree = links.groupBy("node").agg(F.count("*").alias("degree"))
    many = truth.groupBy("node").agg(F.count("*").alias("r"))
    inside = found.select("node", "community").join(truth.select("node", "community", F.lit(1).alias("t")), ["node", "community"], "left").join(many, "node", "left")
    weight = F.when(F.col("r") > 0, 1 + F.coalesce("t", F.lit(0)) / F.col("r")).otherwise(0.0)
    inside = inside.select("node", "community", weight.alias("w"))
    volume = inside.join(degree, "node").groupBy("community").agg(F.sum(F.col("degree") * F.col("w")).alias("volume"))
    # a neighbour outside weighs like a node of the truth in a community, whether it has it there or not
    ends = found.select(F.col("node").alias("other"), "community")
    out = inside.join(links, "node").join(ends, ["other", "community"], "left_anti")
    there = truth.select(F.col("node").alias("other"), "community", F.lit(1).alias("t2"))
    out = out.join(there, ["other", "community"], "left").join(many.select(F.col("node").alias("other"), F.col("r").alias("r2")), "other", "left")
    far = F.when(F.col("r2") > 0, 1 + F.coalesce("t2", F.lit(0)) / F.col("r2")).otherwise(0.0)
    boundary = out.groupBy("community").agg(F.sum(F.col("w") * far).alias("boundary"))
    total = degree.agg(F.sum("degree").alias("total"))
    rows = volume.join(boundary, "community", "left").fillna(0.0, ["boundary"]).crossJoin(F.broadcast(total))  # one row
    return rows.select("community", "boundary", "volume", F.try_divide("boundary", F.least(F.col("volume"), F.col("total") - F.col("volume"))).alias("conductance"))


def permanence(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, degree, permanence: share of neighbours with its label, less the largest share of another label.

    ``labels`` is (node, label), a row for each node; neighbours without one count in the degree only.
    """
    links = both_ways(edges)
    near = links.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other", "left")
    n = near.groupBy("node", "near").agg(F.count("*").alias("n")).join(labels, "node")
    own = F.col("near") == F.col("label")
    sums = n.groupBy("node").agg(F.sum("n").alias("degree"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own"), F.max(F.when(~own, F.col("n"))).alias("far"))
    return sums.select("node", "degree", ((F.col("own") - F.coalesce("far", F.lit(0))) / F.col("degree")).alias("permanence"))


def ladder(edges: DataFrame, step: int, most: int) -> DataFrame:
    """rung, edges, nodes: of edges (src, dst, dist), how many and how many ends lie within each distance."""
    rung = lambda d: (F.ceil(F.greatest(d, F.lit(1)) / step) * step).cast("long")
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    least = edges.filter(F.col("dist") <= most).groupBy(*pair).agg(F.min("dist").alias("dist"))
    ends = least.select(F.explode(F.array("src", "dst")).alias("node"), "dist").groupBy("node").agg(F.min("dist").alias("dist"))
    rungs = edges.sparkSession.range(step, most + 1, step).select(F.col("id").alias("rung"))
    counts = rungs.join(F.broadcast(least.groupBy(rung(F.col("dist")).alias("rung")).agg(F.count("*").alias("e"))), "rung", "left")  # most / step rows
    counts = counts.join(F.broadcast(ends.groupBy(rung(F.col("dist")).alias("rung")).agg(F.count("*").alias("v"))), "rung", "left")
    upto = Window.orderBy("rung")  # most / step rows
    return counts.select("rung", F.sum(F.coalesce("e", F.lit(0))).over(upto).alias("edges"), F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("nodes"))


def disjoint_union(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community, src, dst: each community's induced subgraph, its nodes named node_community."""
    named = lambda end: F.concat_ws("_", F.col(end).cast("string"), F.col("community").cast("string")).alias(end)
    of = members.select("node", "community")
    inside = edges.join(of.withColumnRenamed("node", "src"), "src").join(of.withColumnRenamed("node", "dst"), ["dst", "community"])
    return inside.select("community", named("src"), named("dst"))


def group_labels(nodes: DataFrame, groups: list[str]) -> DataFrame:
    """node, label: labels by hash, where every group has two nodes at least (if there are enough).

    The nodes with the smallest hashes get each group twice; equal input gives equal labels.
    """
    digits = lambda a, n: F.conv(F.substring(F.md5(F.col("node").cast("string")), a, n), 16, 10).cast("long")
    names = F.array(*map(F.lit, groups))
    order = [F.md5(F.col("node").cast("string")), F.col("node")]
    first = nodes.select("node").orderBy(*order).limit(2 * len(groups))  # two for each group
    first = first.withColumn("k", F.row_number().over(Window.orderBy(*order)))
    first = first.select("node", F.element_at(names, ((F.col("k") - 1) % len(groups) + 1).cast("int")).alias("fixed"))
    rows = nodes.select("node").join(F.broadcast(first), "node", "left")
    return rows.select("node", F.coalesce("fixed", F.element_at(names, (digits(9, 7) % len(groups) + 1).cast("int"))).alias("label"))


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all columns that both have; null keys match nothing."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no column is in both tables")
    return left.join(right, shared, "left")
