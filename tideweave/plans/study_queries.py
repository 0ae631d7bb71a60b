"""Studies: detectors, stability, null models, decomposition, node importance by segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import affiliation, graph, partition, studies
from ..operators import quality as q
from ..sources import tables
from .model_queries import _lasso_edges, _per_graph, filled_panel, packed_network
from .registry import query


def r6(c):
    return F.round(c, 6)


def _simple(n, src, dst):
    return (partition.adjacency(n, src, dst) > 0).astype(float)


@query()
def detector_labels(spark, folder):
    """Labels of several detectors, their modularity, and agreement with the spectral method."""

    def work(n, src, dst, row):
        a = _simple(n, src, dst)
        u, v = np.nonzero(np.triu(a))
        base = partition.spectral(a, 3)
        found = {"spectral": base, "fast greedy": studies.fast_greedy(a), "leading eigenvector": studies.leading_eigenvector(a), "edge betweenness": studies.edge_betweenness(n, u, v), "walks": studies.walk_clusters(a, 3)}
        return pd.concat([pd.DataFrame({"detector": k, "node": np.arange(n), "label": x, "modularity": round(studies.modularity(a, x), 6), "agreement": round(studies.rand_index(base, x), 6)}) for k, x in found.items()])

    return _per_graph(spark, folder, work, "detector string, node int, label int, modularity double, agreement double")


@query()
def leave_one_out(spark, folder):
    def work(n, src, dst, row):
        return pd.DataFrame({"node": np.arange(n), "agreement": studies.leave_one_out(_simple(n, src, dst), 3).round(6)})

    return _per_graph(spark, folder, work, "node int, agreement double")


@query()
def degree_law(spark, folder):
    def work(n, src, dst, row):
        alpha, cut, gap, p = studies.power_law(_simple(n, src, dst).sum(1))
        return pd.DataFrame({"alpha": [alpha], "cut": [cut], "distance": [gap], "p": [p]}).round(6)

    return _per_graph(spark, folder, work, "alpha double, cut int, distance double, p double")


@query(f"""WITH {tables.NETWORK}, u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges), n AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1)
SELECT CAST((SELECT sum(n) FROM n) AS BIGINT) AS nodes, (SELECT count(*) FROM u) AS edges, CAST((SELECT sum(n * (n - 1) // 2) FROM n) AS BIGINT) AS inner_pairs,
(SELECT count(*) FROM u JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey) AS inner_edges""")
def surprise_counts(spark, folder):
    """The counts that surprise is computed from, regions as groups."""
    e = graph.undirected(tables.network(spark, folder))
    m = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("r"))
    sizes = m.groupBy("r").agg(F.count("*").alias("n")).agg(F.sum("n").alias("nodes"), F.sum(F.expr("n * (n - 1) div 2")).alias("inner_pairs"))
    inner = e.join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst").agg(F.count("*").alias("edges"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("inner_edges"))
    return sizes.crossJoin(inner).select("nodes", "edges", "inner_pairs", "inner_edges")


@query()
def surprise(spark, folder):
    def work(batches):
        for b in batches:
            yield pd.DataFrame({"surprise": [round(studies.surprise(r.nodes, r.edges, r.inner_pairs, r.inner_edges), 6) for r in b.itertuples()]})

    return surprise_counts(spark, folder).mapInPandas(work, "surprise double")


@query()
def null_model(spark, folder):
    """Fits with the continuous attributes shuffled over nodes, beside the fit as it is."""
    grid = spark.createDataFrame([(k,) for k in range(6)], "draw int").repartition(6, "draw")

    def work(batches):
        for b in batches:
            out = []
            for row in b.itertuples():
                src, dst = np.array(row.src, int), np.array(row.dst, int)
                z = np.array([[np.nan if v is None else v for v in r] for r in row.continuous], float)
                if row.draw:
                    z = z[np.random.default_rng(row.draw).permutation(len(z))]
                m = affiliation.fit(row.n, src, dst, np.zeros((row.n, 0)), z, affiliation.Controls(3, rounds=100))
                out.append((row.draw, row.draw > 0, *(round(v, 6) for v in m.trace[-1][:2]), round(m.trace[-1][3], 6)))
            yield pd.DataFrame(out, columns=["draw", "shuffled", "loglik", "loglik_graph", "loglik_lin"])

    return grid.crossJoin(F.broadcast(packed_network(spark, folder))).mapInPandas(work, "draw int, shuffled boolean, loglik double, loglik_graph double, loglik_lin double")


@query()
def structure_and_features(spark, folder):
    """Agreement of labels from the graph, from the attributes, and from both."""

    def work(n, src, dst, row):
        a = _simple(n, src, dst)
        x = np.array([[0.0 if v is None or np.isnan(v) else v for v in r] for r in row.binary])
        by_graph, by_both = partition.spectral(a, 3), partition.covariate_spectral(a, x, 3)
        by_attributes = studies.fuzzy_means(x, 3).argmax(1)
        pairs = {"graph, both": (by_graph, by_both), "attributes, both": (by_attributes, by_both), "graph, attributes": (by_graph, by_attributes)}
        return pd.DataFrame([(k, round(studies.rand_index(*v), 6)) for k, v in pairs.items()], columns=["pair", "agreement"])

    return _per_graph(spark, folder, work, "pair string, agreement double")


@query(f"""WITH RECURSIVE {tables.MEMBERSHIPS}, m AS (SELECT node, community FROM memberships WHERE half = 1), n AS (SELECT community, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT x.community AS a, y.community AS b FROM m x JOIN m y ON x.node = y.node AND x.community <> y.community JOIN n ON n.community = x.community GROUP BY x.community, y.community, n.n HAVING count(*) / n.n > 0.45),
w AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a, a AS b FROM w UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a), l AS (SELECT a AS community, min(b) AS label FROM r GROUP BY a)
SELECT DISTINCT node, coalesce(label, community) AS community FROM m LEFT JOIN l USING (community)""")
def merged_communities(spark, folder):
    m = tables.memberships(spark, folder).filter("half = 1").select("node", "community")
    return q.merged(m, 0.45)


@query()
def point_clusters(spark, folder):
    """Regions' points grouped by complete linkage up to a width, with centres; a group of points is one task.

    Clusters are numbered by their smallest vec_id; points without both coordinates have none.
    """
    e = F.col("embedding").cast("array<double>")
    points = tables.table(spark, folder, "embeddings").select("label", "vec_id", e[0].alias("x"), e[1].alias("y"))

    def work(g):
        g = g.sort_values(["vec_id", "x", "y"])
        ok = np.isfinite(g[["x", "y"]].to_numpy(float)).all(axis=1)
        labels = pd.array([None] * len(g), dtype="Int32")
        labels[ok] = studies.linkage_points(g.loc[ok, ["x", "y"]].to_numpy(float), height=0.2)
        center = g.assign(cluster=labels)[ok].groupby("cluster")[["x", "y"]].transform("mean").round(6)
        return pd.DataFrame({"label": g["label"], "vec_id": g["vec_id"], "cluster": labels, "cx": center["x"], "cy": center["y"]}, index=g.index)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: told a number, Spark leaves the groups apart
    return points.repartition(n, "label").groupBy("label").applyInPandas(work, "label int, vec_id long, cluster int, cx double, cy double")


@query()
def average_breaks(spark, folder):
    """Break points of the mean series over all locations, applied to each location's series."""
    from ..operators import series

    rows = filled_panel(spark, folder)
    mean = rows.groupBy("year", "week").agg(F.avg("value").alias("value")).withColumn("panel", F.lit(0))

    def work(g):
        y = g.sort_values(["year", "week"])["value"].to_numpy(float)
        ends, _ = series.breaks(y, 3, max(len(y) // 8, 2)) if len(y) >= 16 else ([], 0)
        cuts = [0, *ends, len(y)]
        return pd.DataFrame([(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))], columns=["id", "start", "end"])

    cuts = mean.groupBy("panel").applyInPandas(work, "id int, start int, end int")  # a row a week
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("location").orderBy("year", "week")) - 1)
    rows = rows.join(F.broadcast(cuts), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    return rows.groupBy("location", "id").agg(F.count("*").alias("weeks"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"))


@query()
def segment_importance(spark, folder):
    """Out-strength of every source in each segment's influence network, ranked, the top two marked."""
    rows = _lasso_edges(spark, folder).groupBy("segment", "source", "target").agg(F.sqrt(F.sum(F.col("beta") * F.col("beta"))).alias("w"))
    out = rows.groupBy("segment", "source").agg(F.sum("w").alias("strength"), F.count("*").alias("targets"))
    rank = F.dense_rank().over(Window.partitionBy("segment").orderBy(F.col("strength").desc()))
    return out.withColumn("place", rank).select("segment", "source", r6("strength").alias("strength"), "targets", "place", (F.col("place") <= 2).alias("top"))


@query()
def imputed_categories(spark, folder):
    """Unlabelled documents' quality by the mode of their language, and by a regression on length."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    docs, labels = tables.table(spark, folder, "documents"), tables.table(spark, folder, "labels").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "lang", F.log1p("n_chars").alias("size"), F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")).cast("double").alias("symbols"))
    rows = rows.join(labels.select("doc_id", "quality"), "doc_id", "left")
    known = rows.filter("quality IS NOT NULL")
    n = known.groupBy("lang", "quality").agg(F.count("*").alias("n"))
    mode = n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "quality"))).filter("k = 1").select("lang", F.col("quality").alias("mode"))
    assembler = VectorAssembler(inputCols=["size", "symbols"], outputCol="x", handleInvalid="skip")
    model = LogisticRegression(featuresCol="x", labelCol="quality", regParam=0.01).fit(assembler.transform(known.withColumn("quality", F.col("quality").cast("double"))))
    gaps = model.transform(assembler.transform(rows.filter("quality IS NULL").drop("quality")))
    return gaps.join(mode, "lang", "left").select("doc_id", "lang", F.col("mode").cast("int").alias("by_mode"), F.col("prediction").cast("int").alias("by_regression"))


@query()
def kmeans_labels(spark, folder):
    """Clusters of the embeddings' first entries, against their labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = tables.table(spark, folder, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    model = KMeans(k=10, seed=1, featuresCol="x", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(F.col("vec_id").alias("node"), F.col("label").alias("a"), F.col("cluster").alias("b"))


@query()
def kmeans_agreement(spark, folder):
    return q.adjusted_rand(kmeans_labels(spark, folder)).select(F.round("ari", 4).alias("ari"))
