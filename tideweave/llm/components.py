"""Connected components of a table of links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept


def step(both: DataFrame, labels: DataFrame) -> DataFrame:
    """One round: the smallest label among neighbours, then the label of that label."""
    near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
    least = labels.join(near, labels.node == near.a, "left").select("node", F.least("label", F.coalesce("near", "label")).alias("least"))
    jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
    return least.join(jump, "least").select("node", F.least("least", "far").alias("label"))


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) for all nodes of ``links`` (a, b): the smallest node reachable.

    Label propagation with pointer jumping; each round is kept in the shared folder.  With
    ``rounds`` it stops after so many: equal labels are then connected, but not the other way round.
    """
    links = links.select("a", "b")
    both = kept(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    done = 0
    while rounds is None or done < rounds:
        new = kept(step(both, labels), "labels")
        done += 1
        if rounds is None:
            changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label != old").limit(1).count()
            if not changed:
                return new
        labels = new
    return labels
