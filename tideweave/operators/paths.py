"""Distances and rankings that need rounds of joins; each round is written where all can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import both_ways


def settled(df: DataFrame) -> DataFrame:
    """Write a round's table to the shared folder that spark.checkpoint.dir names and read it back."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tideweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hops(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """source, node, hops by breadth-first search from ``sources`` (node) along directed edges."""
    step = edges.select("src", "dst").distinct()
    known = settled(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")))
    front, k = known, 0
    while most is None or k < most:
        k += 1
        reached = front.join(step, front.node == step.src).select("source", F.col("dst").alias("node")).distinct()
        front = settled(reached.join(known, ["source", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if front.limit(1).count() == 0:
            break
        known = settled(known.unionByName(front))
    return known


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, distance, path: shortest weighted paths by relaxation (weights above 0).

    Of equally short paths the one that is smallest as a list of nodes.
    """
    step = both_ways(edges, "weight")
    best = settled(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"), F.array("node").alias("path")))
    front = best
    while front.limit(1).count():
        moved = front.withColumnRenamed("node", "at").join(step, F.col("at") == F.col("node")).select(
            "source", F.col("other").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.concat("path", F.array("other")).alias("path")
        )
        every = best.unionByName(moved).groupBy("source", "node").agg(F.min(F.struct("distance", "path")).alias("b"))
        new = settled(every.select("source", "node", "b.distance", "b.path"))
        front = settled(new.join(best.select("source", "node", F.col("distance").alias("old"), F.col("path").alias("old_path")), ["source", "node"], "left").filter("old IS NULL OR distance != old OR path != old_path").drop("old", "old_path"))
        best = new
    return best


def contracted(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """src, dst, weight between targets that follow one another on shortest paths among targets."""
    found = distances(edges, targets).join(targets, "node", "left_semi").filter("source != node")
    chain = settled(found.select("source", "node", F.posexplode("path").alias("i", "stop")).join(targets.select(F.col("node").alias("stop")), "stop", "left_semi"))
    from pyspark.sql import Window

    then = F.lead("stop").over(Window.partitionBy("source", "node").orderBy("i"))
    hop = chain.select(F.col("stop").alias("a"), then.alias("b")).filter("b IS NOT NULL").distinct()
    length = found.select(F.col("source").alias("a"), F.col("node").alias("b"), "distance")
    hop = hop.join(length, ["a", "b"])
    return hop.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("distance").alias("weight"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """node, rank (sum 1) by weight; nodes without out-edges give to all alike."""
    from .graph import nodes

    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = settled(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    every = settled(nodes(edges))
    n = every.count()
    rank = settled(every.withColumn("rank", F.lit(1.0 / n)))
    for _ in range(rounds):
        got = rank.join(share, rank.node == share.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        lost = rank.join(share.select(F.col("src").alias("node")).distinct(), "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = every.join(got, "node", "left").crossJoin(F.broadcast(lost))
        rank = settled(new.select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
    return rank


def hubs_authorities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, hub, authority, each scaled to a sum of 1."""
    from .graph import nodes

    every = settled(nodes(edges))
    hub = settled(every.withColumn("hub", F.lit(1.0)))
    for _ in range(rounds):
        a = hub.join(edges, hub.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("hub") * F.col("weight")).alias("a"))
        a = settled(a.crossJoin(F.broadcast(a.agg(F.sum("a").alias("t")))).select("node", (F.col("a") / F.col("t")).alias("authority")))
        h = a.join(edges, a.node == edges.dst).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("authority") * F.col("weight")).alias("h"))
        hub = settled(h.crossJoin(F.broadcast(h.agg(F.sum("h").alias("t")))).select("node", (F.col("h") / F.col("t")).alias("hub")))
    return every.join(hub, "node", "left").join(a, "node", "left").fillna(0.0, ["hub", "authority"])


def k_core(edges: DataFrame) -> DataFrame:
    """node, core: the largest k such that the node is in a subgraph with degrees of k or more."""
    both = settled(both_ways(edges).distinct())
    left, k, parts = both, 1, []
    while left.limit(1).count():
        while True:
            weak = settled(left.groupBy("node").agg(F.count("*").alias("d")).filter(F.col("d") < k).select("node"))
            if not weak.limit(1).count():
                break
            parts.append(weak.withColumn("core", F.lit(k - 1)))
            before = left
            left = settled(before.join(weak, "node", "left_anti").join(weak.select(F.col("node").alias("other")), "other", "left_anti").select("node", "other"))
            # nodes whose last neighbours went with them
            lone = before.select("node").distinct().join(weak, "node", "left_anti").join(left.select("node").distinct(), "node", "left_anti")
            parts.append(lone.withColumn("core", F.lit(k - 1)))
        k += 1
    out = parts[0] if parts else both.select("node").withColumn("core", F.lit(0))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, label: each round all nodes take their neighbours' most frequent label, the smallest of ties."""
    both = settled(both_ways(edges).distinct())
    labels = settled(both.select("node").distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
        labels = settled(votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("node", "b.label"))
    return labels


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable in either direction; labels halve their way each round."""
    both = settled(both_ways(edges).distinct())
    labels = settled(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("least"))
        far = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        new = settled(least.join(far, "least").select("node", F.least("least", "far").alias("label")))
        if not new.join(labels.withColumnRenamed("label", "old"), "node").filter("label != old").limit(1).count():
            return new
        labels = new
