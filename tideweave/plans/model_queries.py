"""Models and kernels over the example tables: each run or series is one task's work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import affiliation, graph, partition, prep, series
from ..operators import quality as q
from ..sources import tables
from .registry import query


def r6(c):
    return F.round(c, 6)


def packed_network(spark, folder) -> DataFrame:
    """One row: the flow network of nations as arrays, with three binary and two continuous attributes.

    Nations are 25 whatever the scale, so the row is small.  The attributes are the region's
    membership and mean sizes of orders; every fifth value is missing.
    """
    edges = tables.network(spark, folder).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    own = tables.samples(spark, folder).groupBy("location").agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n"))
    place = tables.places(spark, folder).join(own, "location", "left").select("nationkey", "region", "mean", "n")
    regions = place.select("region").distinct().agg(F.array_sort(F.collect_list("region")).alias("regions"))
    rows = place.crossJoin(F.broadcast(regions))
    gap = lambda value, k: F.when(F.col("nationkey") % 5 != k, value)
    binary = F.array(*(gap((F.col("region") == F.col("regions")[k]).cast("double"), k) for k in range(3)))
    continuous = F.array(gap(F.col("mean"), 3), gap(F.ln("n"), 4))
    nodes = rows.select(F.struct("nationkey", binary.alias("b"), continuous.alias("c")).alias("v"))
    nodes = nodes.agg(F.array_sort(F.collect_list("v")).alias("v"))
    part = lambda c, f: F.transform(c, lambda x: x[f])
    return edges.crossJoin(nodes).select(
        F.size("v").alias("n"), part("e", "src").alias("src"), part("e", "dst").alias("dst"), part("v", "b").alias("binary"), part("v", "c").alias("continuous")
    )


def _grid(spark) -> DataFrame:
    rows = [(f"{k}-{p}-{size}", k, 0.001, size, size, p, 7, True) for k in (2, 3) for p in ("LASSO", "Ridge", "ElasticNet") for size in (0.001, 0.1)]
    return spark.createDataFrame(rows, "run_id string, communities int, alpha double, lambda_bin double, lambda_lin double, penalty string, seed int, directed boolean")


def _fits(spark, folder) -> DataFrame:
    runs = _grid(spark).repartition(8, "run_id").crossJoin(F.broadcast(packed_network(spark, folder)))
    return affiliation.fit_runs(runs)


@query()
def affil_fit_grid(spark, folder):
    rows = _fits(spark, folder)
    return rows.select("run_id", "n_iter", "failed", *(r6(c).alias(c) for c in ("loglik", "loglik_graph", "loglik_bin", "loglik_lin", "bic", "icl")))


@query()
def affil_memberships(spark, folder):
    """run_id, node, community of every run, the communities numbered by letters from a."""
    rows = _fits(spark, folder).select("run_id", F.posexplode("members").alias("node", "own"))
    return rows.select("run_id", "node", F.explode("own").alias("k")).select("run_id", "node", F.char(F.col("k") + 97).alias("community"))


@query()
def affil_impute(spark, folder):
    """Mean, median and spread over runs of each filled value, and whether it was missing."""
    rows = _fits(spark, folder).select("run_id", F.posexplode("imputed_cont").alias("node", "v"))
    rows = rows.select("run_id", "node", F.posexplode("v").alias("cov", "value"))
    mask = packed_network(spark, folder).select(F.posexplode("continuous").alias("node", "v")).select("node", F.posexplode("v").alias("cov", "x"))
    mask = mask.select("node", "cov", F.col("x").isNull().alias("is_missing"))
    stats = rows.groupBy("node", "cov").agg(r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("median"), r6(F.stddev_samp("value")).alias("sd"))
    return stats.join(mask, ["node", "cov"])


def _per_graph(spark, folder, work, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                yield work(row.n, np.array(row.src), np.array(row.dst), row)

    return packed_network(spark, folder).mapInPandas(run, schema)


@query()
def spectral_labels(spark, folder):
    def work(n, src, dst, row):
        labels = partition.spectral(partition.adjacency(n, src, dst), 3)
        return pd.DataFrame({"node": np.arange(n), "label": labels})

    return _per_graph(spark, folder, work, "node int, label int")


@query()
def covariate_spectral_labels(spark, folder):
    def work(n, src, dst, row):
        x = np.array([[0.0 if v is None or np.isnan(v) else v for v in r] for r in row.binary])
        a = partition.adjacency(n, src, dst)
        return pd.DataFrame({"node": np.arange(n)} | {k.replace("-", "_"): partition.covariate_spectral(a, x, 3, k) for k in ("assortative", "non-assortative", "cca")})

    return _per_graph(spark, folder, work, "node int, assortative int, non_assortative int, cca int")


@query()
def eigengap(spark, folder):
    def work(n, src, dst, row):
        k, values = partition.eigengap(partition.adjacency(n, src, dst))
        return pd.DataFrame({"place": np.arange(len(values)), "eigenvalue": values.round(6), "clusters": k})

    return _per_graph(spark, folder, work, "place int, eigenvalue double, clusters int")


@query()
def block_model_search(spark, folder):
    def work(n, src, dst, row):
        a = (partition.adjacency(n, src, dst) > 0).astype(float)
        labels, trace = partition.block_search(a, 3, rounds=60)
        return pd.DataFrame({"node": np.arange(n), "block": labels, "loglik": round(max(trace), 6)})

    return _per_graph(spark, folder, work, "node int, block int, loglik double")


@query()
def iterative_fill(spark, folder):
    def work(n, src, dst, row):
        levels = np.array([np.nan if r[0] is None or np.isnan(r[0]) else r[0] for r in row.binary])
        filled, labels = partition.iterative_fill((partition.adjacency(n, src, dst) > 0).astype(float), levels, 3)
        return pd.DataFrame({"node": np.arange(n), "level": filled, "label": labels, "was_missing": np.isnan(levels)})

    return _per_graph(spark, folder, work, "node int, level double, label int, was_missing boolean")


@query()
def centrality(spark, folder):
    def work(n, src, dst, row):
        pairs = sorted({(min(a, b), max(a, b)) for a, b in zip(src.tolist(), dst.tolist())})
        between, close = partition.betweenness(n, *zip(*pairs)) if pairs else (np.zeros(n), np.zeros(n))
        return pd.DataFrame({"node": np.arange(n), "betweenness": between.round(6), "closeness": close.round(6)})

    return _per_graph(spark, folder, work, "node int, betweenness double, closeness double")


def panel(spark, folder) -> DataFrame:
    """location, year, week, value with a null where a location has no sample."""
    full = prep.grid(tables.weekly(spark, folder).select("location", "year", "week", F.col("mean_value").alias("value")), ["location"], ["year", "week"])
    return full.select("location", "year", "week", "value")


def _per_series(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(location, frame in order)`` for every location; a series is as long as there are weeks."""
    return rows.groupBy("location").applyInPandas(lambda g: work(g["location"].iloc[0], g.sort_values(["year", "week"]).reset_index(drop=True)), schema)


@query()
def kalman_fill(spark, folder):
    def work(name, g):
        y = g["value"].to_numpy(float)
        filled, variance, low, high = series.kalman(y)
        return g.assign(filled=filled.round(6), variance=variance.round(6), low=low.round(6), high=high.round(6))

    return _per_series(panel(spark, folder), work, "location string, year int, week int, value double, filled double, variance double, low double, high double")


def filled_panel(spark, folder) -> DataFrame:
    def work(name, g):
        return g.assign(value=series.smooth(g["value"].to_numpy(float))[0])

    return _per_series(panel(spark, folder), work, "location string, year int, week int, value double")


@query()
def smoothed_panel(spark, folder):
    return filled_panel(spark, folder).withColumn("value", r6("value"))


@query()
def structural_breaks(spark, folder):
    def work(name, g):
        y = g["value"].to_numpy(float)
        ends, rss = series.breaks(y, 3, max(len(y) // 8, 2)) if len(y) >= 16 else ([], float("nan"))
        return pd.DataFrame([(name, i + 1, e, rss) for i, e in enumerate(ends)], columns=["location", "id", "pos", "rss"])

    return _per_series(filled_panel(spark, folder), work, "location string, id int, pos int, rss double").withColumn("rss", r6("rss"))


@query()
def break_envelopes(spark, folder):
    """Segments between break points and the envelope of each over all series."""
    found = structural_breaks(spark, folder).select("location", "id", "pos")
    size = panel(spark, folder).groupBy("location").agg(F.count("*").cast("int").alias("pos"))
    ends = found.unionByName(size.select("location", F.lit(4).alias("id"), "pos")).unionByName(size.select("location", F.lit(0).alias("id"), F.lit(0).alias("pos")))
    start = F.lag("pos").over(Window.partitionBy("location").orderBy("id"))
    rows = ends.select("location", "id", start.alias("start"), F.col("pos").alias("end")).filter("start IS NOT NULL")
    low = rows.groupBy("id").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    return rows.join(low, "id")


@query()
def mean_shifts(spark, folder):
    def work(name, g):
        y = g["value"].to_numpy(float)
        at = series.pelt(y)
        top, where = series.cusum(y)
        return pd.DataFrame({"location": [name], "shifts": [at], "cusum": [round(top, 6)], "cusum_at": [where]})

    return _per_series(filled_panel(spark, folder), work, "location string, shifts array<int>, cusum double, cusum_at int")


@query()
def stationarity(spark, folder):
    def work(name, g):
        y = g["value"].to_numpy(float)
        t0, s0 = series.unit_root(y)
        t1, s1 = series.unit_root(np.diff(y))
        b = series.autoregression(y, 2)
        return pd.DataFrame([(name, round(t0, 6), s0, round(t1, 6), s1, *b.round(6))], columns=["location", "level", "level_ok", "diff", "diff_ok", "constant", "ar1", "ar2"])

    return _per_series(filled_panel(spark, folder), work, "location string, level double, level_ok boolean, diff double, diff_ok boolean, constant double, ar1 double, ar2 double")


_ACF = f"""WITH {tables.WEEKLY}, t AS (SELECT region, year * 100 + week AS yw, avg(mean_value) AS v FROM weekly GROUP BY ALL),
p AS (SELECT region, v - avg(v) OVER (PARTITION BY region) AS z, row_number() OVER (PARTITION BY region ORDER BY yw) AS i FROM t),
s AS (SELECT region, sum(z * z) AS ss FROM p GROUP BY region), k AS (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS lag)
SELECT a.region, lag, round(sum(a.z * b.z) / first(ss), 6) AS acf FROM p a JOIN k ON true JOIN p b ON a.region = b.region AND b.i = a.i + lag JOIN s ON s.region = a.region GROUP BY ALL"""


@query(_ACF)
def autocorrelation(spark, folder):
    rows = tables.weekly(spark, folder).groupBy("region", (F.col("year") * 100 + F.col("week")).alias("yw")).agg(F.avg("mean_value").alias("v"))
    by = Window.partitionBy("region")
    rows = rows.withColumn("z", F.col("v") - F.avg("v").over(by)).withColumn("i", F.row_number().over(by.orderBy("yw")))
    total = rows.groupBy("region").agg(F.sum(F.col("z") * F.col("z")).alias("ss"))
    lag = F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("lag")
    early = rows.select("region", "z", "i", lag).withColumn("i", F.col("i") + F.col("lag"))
    pairs = early.join(rows.select("region", F.col("z").alias("z2"), "i"), ["region", "i"])
    sums = pairs.groupBy("region", "lag").agg(F.sum(F.col("z") * F.col("z2")).alias("s"))
    return sums.join(total, "region").select("region", "lag", r6(F.col("s") / F.col("ss")).alias("acf"))


def _region_panel(spark, folder) -> DataFrame:
    """One row per week of a wide panel of the five regions' means, in one group.

    The panel of regions has a row a week, however many samples there are.
    """
    rows = tables.weekly(spark, folder).groupBy("region", "year", "week").agg(F.avg("mean_value").alias("v"))
    names = [r.region for r in tables.places(spark, folder).select("region").distinct().orderBy("region").collect()]
    return prep.long_to_wide(rows, ["year", "week"], "region", "v", names).withColumn("panel", F.lit(0)), names


@query()
def granger_pairs(spark, folder):
    """F and p of each ordered pair of regions at order 1, on differences."""
    wide, names = _region_panel(spark, folder)

    def work(g):
        g = g.sort_values(["year", "week"])
        x = {n: np.diff(series.smooth(g[n].to_numpy(float))[0]) for n in names}
        rows = [(a, b, *map(float, series.granger(x[a], x[b]))) for a in names for b in names if a != b]
        return pd.DataFrame(rows, columns=["source", "target", "f", "p"]).round(6)

    return wide.groupBy("panel").applyInPandas(work, "source string, target string, f double, p double").withColumn("edge", F.col("p") <= 0.05)


def _lasso_edges(spark, folder) -> DataFrame:
    wide, names = _region_panel(spark, folder)

    def work(g):
        g = g.sort_values(["year", "week"]).reset_index(drop=True)
        x = np.column_stack([np.diff(series.smooth(g[n].to_numpy(float))[0]) for n in names])
        out = []
        for k, part in enumerate(np.array_split(x, 4)):
            out += [(k, names[i], names[j], lag, b) for i, j, lag, b in series.network_granger(part, 2)]
        return pd.DataFrame(out, columns=["segment", "target", "source", "lag", "beta"])

    return wide.groupBy("panel").applyInPandas(work, "segment int, target string, source string, lag int, beta double")


@query()
def granger_lasso_edges(spark, folder):
    return _lasso_edges(spark, folder).withColumn("beta", r6("beta"))


@query()
def granger_ring_weights(spark, folder):
    rows = _lasso_edges(spark, folder)
    return rows.groupBy("segment", "source", "target").agg(r6(F.sqrt(F.sum(F.col("beta") * F.col("beta")))).alias("weight"), F.max("lag").alias("order"))


@query()
def gap_study(spark, folder):
    """Errors of filling by series, share of gaps and repetition, the longest gap, and the errors' density mode."""
    shares = spark.createDataFrame([(s, k) for s in (0.05, 0.1, 0.2, 0.4) for k in range(5)], "share double, sim int")
    rows = filled_panel(spark, folder).groupBy("location").agg(F.array_sort(F.collect_list(F.struct("year", "week", "value"))).alias("s"))
    rows = rows.select("location", F.transform("s", lambda x: x["value"]).alias("y")).crossJoin(F.broadcast(shares))

    def work(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                y = np.array(r.y, float)
                gone = np.random.default_rng([r.sim, int(r.share * 100), len(y)]).random(len(y)) < r.share
                if not gone.any() or gone.all():
                    continue
                e = series.smooth(np.where(gone, np.nan, y))[0][gone] - y[gone]
                runs = np.diff(np.flatnonzero(np.concatenate([[True], ~gone, [True]]))) - 1
                out.append((r.location, r.share, r.sim, float(np.sqrt((e * e).mean())), float(np.abs(e).mean()), int(runs.max())))
            yield pd.DataFrame(out, columns=["location", "share", "sim", "rmse", "mae", "longest"])

    errors = rows.mapInPandas(work, "location string, share double, sim int, rmse double, mae double, longest int")

    def modes(g):
        return pd.DataFrame([(g["share"].iloc[0], len(g), g["rmse"].mean(), g["mae"].mean(), int(g["longest"].max()), series.density_mode(g["rmse"].to_numpy()))], columns=["share", "runs", "rmse", "mae", "longest", "rmse_mode"])

    return errors.groupBy("share").applyInPandas(modes, "share double, runs int, rmse double, mae double, longest int, rmse_mode double").withColumns({c: r6(c) for c in ("rmse", "mae", "rmse_mode")})


@query()
def generated_networks(spark, folder):
    """Planted networks by size and communities: edges, members, overlap, and recovery by the spectral method."""
    rows = [(n, k, o, s) for n in (60, 120) for k in (2, 3) for o in (0.0, 0.2) for s in range(3)]
    grid = spark.createDataFrame(rows, "nodes int, communities int, overlap double, seed int").repartition(8, "nodes", "communities", "overlap", "seed")

    def work(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                src, dst, members, f, h = affiliation.generate(r.nodes, [1.0] * r.communities, r.overlap, r.seed)
                x = affiliation.attributes(members, "binary", [(0.9, 0.1)] * r.communities, r.seed)
                gone = np.isnan(affiliation.drop_values(x, "random", 0.1, r.seed)).mean()
                labels = partition.spectral(partition.adjacency(r.nodes, src, dst), r.communities)
                main = np.abs(members).argmax(1)
                hit = sum((main[labels == c][:, None] == np.arange(r.communities)).sum(0).max() for c in np.unique(labels))
                out.append((r.nodes, r.communities, r.overlap, r.seed, len(src), int((members != 0).sum()), float(gone), hit / r.nodes, affiliation.graph_loglik(f, h, src, dst)))
            yield pd.DataFrame(out, columns=["nodes", "communities", "overlap", "seed", "edges", "memberships", "missing", "purity", "loglik"])

    return grid.mapInPandas(work, "nodes int, communities int, overlap double, seed int, edges int, memberships int, missing double, purity double, loglik double").withColumns({c: r6(c) for c in ("missing", "purity", "loglik")})


@query(f"""WITH {tables.WEEKLY}, {tables.NETWORK},
full_ AS (SELECT n.n_nationkey AS node, t.year, t.week, w.mean_value IS NULL AS gone FROM nation n CROSS JOIN (SELECT DISTINCT year, week FROM weekly) t LEFT JOIN weekly w ON w.location = n.n_name AND w.year = t.year AND w.week = t.week),
und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), ways AS (SELECT a AS node, b AS other FROM und UNION ALL SELECT b, a FROM und)
SELECT f.year, f.week, ways.node, count(*) AS neighbours, CAST(sum(CASE WHEN f.gone THEN 1 ELSE 0 END) AS BIGINT) AS missing_neighbours FROM ways JOIN full_ f ON f.node = ways.other GROUP BY ALL""")
def missing_neighbours(spark, folder):
    full = panel(spark, folder).join(F.broadcast(tables.places(spark, folder).select("location", F.col("nationkey").alias("other"))), "location")
    ways = graph.both_ways(graph.undirected(tables.network(spark, folder)))
    rows = full.join(F.broadcast(ways), "other")  # edges between 25 nations
    return rows.groupBy("year", "week", "node").agg(F.count("*").alias("neighbours"), F.sum(F.col("value").isNull().cast("long")).alias("missing_neighbours"))


@query("""WITH p AS (SELECT c_custkey AS id, radians(c_acctbal % 90) AS lat, radians(c_custkey % 180) AS lon FROM customer), s AS (SELECT s_suppkey AS sid, radians(s_acctbal % 90) AS lat2, radians(s_suppkey % 180) AS lon2 FROM supplier),
d AS (SELECT id, sid, sqrt(pow(cos(lat) * cos(lon) - cos(lat2) * cos(lon2), 2) + pow(cos(lat) * sin(lon) - cos(lat2) * sin(lon2), 2) + pow(sin(lat) - sin(lat2), 2)) AS chord FROM p, s)
SELECT id, min_by(sid, (round(chord, 9), sid)) AS nearest, round(2 * 6371.0088 * asin(least(round(min(chord), 9) / 2, 1)), 3) AS km FROM d GROUP BY id""")
def nearest_feature(spark, folder):
    """The nearest supplier of each customer by great circle."""
    p = tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") % 90).alias("lat"), (F.col("c_custkey") % 180).alias("lon"))
    s = tables.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("feature"), (F.col("s_acctbal") % 90).alias("lat"), (F.col("s_suppkey") % 180).alias("lon"))
    return graph.nearest(p, s).select("id", F.col("feature").alias("nearest"), F.round("distance", 3).alias("km"))


@query()
def selected_fits(spark, folder):
    """Fits per penalty on the first front of BIC and ICL."""
    from ..operators import pareto

    rows = affil_fit_grid(spark, folder).filter("NOT failed").withColumn("penalty", F.split("run_id", "-")[1])
    return pareto.first_front(rows, ["penalty"], "bic", "icl").select("penalty", "run_id", "bic", "icl")


@query()
def fit_agreement(spark, folder):
    """run_id, and Omega of every fit's memberships with the regions."""
    found = affil_memberships(spark, folder)
    place = tables.places(spark, folder).select(F.col("nationkey").alias("node"), F.col("region").alias("community"))
    runs = _grid(spark).select("run_id").crossJoin(F.broadcast(place.select("node")))  # 12 runs, 25 nations
    rows = q.omega(place, found, runs, ("run_id",))
    return rows.select("run_id", *(r6(c).alias(c) for c in ("observed", "expected", "omega")))
