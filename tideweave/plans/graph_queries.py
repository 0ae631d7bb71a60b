"""Flow networks between nations: construction and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, paths, prep
from ..sources import tables
from .registry import query

_N = tables.NETWORK
_U = _N + """,
und AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY ALL),
ways AS (SELECT src AS node, dst AS other, weight FROM und UNION ALL SELECT dst, src, weight FROM und)"""


def r6(c):
    return F.round(c, 6)


def _und(spark, folder):
    return graph.undirected(tables.network(spark, folder), "weight", F.sum)


@query(f"WITH {_N} SELECT src, dst, weight FROM edges")
def flow_network(spark, folder):
    return tables.network(spark, folder)


@query(f"""WITH {tables.FLOWS}, q AS (SELECT year, week, quantile_cont(weight, 0.7) AS cut FROM flows WHERE src <> dst GROUP BY ALL)
SELECT src, dst, year, week, weight FROM flows JOIN q USING (year, week) WHERE src <> dst AND weight > cut""")
def flow_quantile_edges(spark, folder):
    rows = tables.flows(spark, folder).filter("src != dst")
    return prep.above_group_quantile(rows, ["year", "week"], "weight", 0.7).select("src", "dst", "year", "week", "weight")


@query(f"""WITH {tables.FLOWS}, q AS (SELECT year, week, median(weight) AS cut FROM flows WHERE src <> dst GROUP BY ALL)
SELECT src, dst, year, week, weight FROM flows JOIN q USING (year, week) WHERE src <> dst AND weight > cut""")
def flow_median_filter(spark, folder):
    rows = tables.flows(spark, folder).filter("src != dst")
    return prep.above_group_quantile(rows, ["year", "week"], "weight", 0.5).select("src", "dst", "year", "week", "weight")


@query(f"""WITH {tables.FLOWS}, o AS (SELECT src AS node, year, sum(weight) AS w FROM flows WHERE src <> dst GROUP BY ALL), i AS (SELECT dst AS node, year, sum(weight) AS w FROM flows WHERE src <> dst GROUP BY ALL)
SELECT coalesce(o.node, i.node) AS node, coalesce(o.year, i.year) AS year, CAST(coalesce(o.w, 0) AS BIGINT) AS outflow, CAST(coalesce(i.w, 0) AS BIGINT) AS inflow FROM o FULL JOIN i ON o.node = i.node AND o.year = i.year""")
def flow_in_out(spark, folder):
    rows = tables.flows(spark, folder).filter("src != dst")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i"))))
    return rows.select("year", ends.alias("e")).groupBy("e.node", "year").agg(F.sum("e.o").alias("outflow"), F.sum("e.i").alias("inflow"))


@query(f"""WITH {_N}, s AS (SELECT min(weight) AS lo, max(weight) AS hi FROM edges) SELECT src, dst, round((weight - lo) / (hi - lo) + 0.01, 6) AS scaled FROM edges, s""")
def minmax_weights(spark, folder):
    rows = tables.network(spark, folder)
    one = rows.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    return rows.crossJoin(F.broadcast(one)).select("src", "dst", r6((F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.01).alias("scaled"))


@query(f"""WITH {_N}, e AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM e GROUP BY node""")
def degree_table(spark, folder):
    return graph.degrees(tables.network(spark, folder))


@query(f"""WITH {_N} SELECT count(*) AS edges, round(avg(CASE WHEN b.src IS NULL THEN 0.0 ELSE 1.0 END), 6) AS reciprocity FROM edges a LEFT JOIN edges b ON a.src = b.dst AND a.dst = b.src""")
def reciprocity(spark, folder):
    return graph.reciprocity(tables.network(spark, folder)).withColumn("reciprocity", r6("reciprocity"))


_TRI = "tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM und x JOIN und y ON x.dst = y.src JOIN und z ON z.src = x.src AND z.dst = y.dst)"


@query(f"""WITH {_U}, {_TRI}, d AS (SELECT node, count(*) AS d FROM ways GROUP BY node), t AS (SELECT CAST(sum(d * (d - 1) // 2) AS BIGINT) AS triples FROM d)
SELECT (SELECT count(*) FROM tri) AS triangles, triples, round(3.0 * (SELECT count(*) FROM tri) / triples, 6) AS transitivity FROM t""")
def transitivity(spark, folder):
    return graph.transitivity(_und(spark, folder)).withColumn("transitivity", r6("transitivity"))


@query(f"""WITH {_U}, {_TRI}, n AS (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri), t AS (SELECT node, count(*) AS triangles FROM n GROUP BY node),
d AS (SELECT node, count(*) AS degree FROM ways GROUP BY node)
SELECT node, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN round(2.0 * coalesce(triangles, 0) / (degree * (degree - 1)), 6) END AS clustering FROM d LEFT JOIN t USING (node)""")
def local_clustering(spark, folder):
    return graph.local_clustering(_und(spark, folder)).withColumn("clustering", r6("clustering"))


@query(f"""WITH {_U}, p AS (SELECT node, other, weight / sum(weight) OVER (PARTITION BY node) AS p FROM ways),
v AS (SELECT a.node, b.other, sum(a.p * b.p) AS via FROM p a JOIN p b ON a.other = b.node WHERE a.node <> b.other GROUP BY ALL)
SELECT node, round(sum((p + coalesce(via, 0)) ** 2), 6) AS "constraint" FROM p LEFT JOIN v USING (node, other) GROUP BY node""")
def burt_constraint(spark, folder):
    return graph.constraint(tables.network(spark, folder)).withColumn("constraint", r6("constraint"))


@query(f"""WITH {_U}, d AS (SELECT node, count(*) AS d FROM ways GROUP BY node) SELECT round(corr(x.d, y.d), 6) AS assortativity FROM ways JOIN d x ON ways.node = x.node JOIN d y ON ways.other = y.node""")
def assortativity(spark, folder):
    return graph.assortativity(_und(spark, folder)).withColumn("assortativity", r6("assortativity"))


@query(f"""WITH {_N} SELECT least(a.r_name, b.r_name) AS level_a, greatest(a.r_name, b.r_name) AS level_b, count(*) AS edges
FROM edges JOIN nation x ON src = x.n_nationkey JOIN region a ON x.n_regionkey = a.r_regionkey JOIN nation y ON dst = y.n_nationkey JOIN region b ON y.n_regionkey = b.r_regionkey GROUP BY ALL""")
def mixing_matrix(spark, folder):
    level = tables.places(spark, folder).select(F.col("nationkey").alias("node"), F.col("region").alias("level"))
    return graph.mixing_matrix(tables.network(spark, folder), level)


@query(f"""WITH {_U}, d AS (SELECT node, count(*) AS e FROM ways GROUP BY node), r AS (SELECT ways.node, e, row_number() OVER (PARTITION BY ways.node ORDER BY e DESC, other) AS k FROM ways JOIN d ON other = d.node),
g AS (SELECT node, count(*) AS degree, avg(e) AS connectivity, max(least(k, e)) AS h_index, sum(e - 1) AS beyond FROM r GROUP BY node)
SELECT node, degree, round(connectivity, 6) AS connectivity, CAST(h_index AS BIGINT) AS h_index, CAST((degree - 1) * beyond AS BIGINT) AS influence FROM g""")
def node_influence(spark, folder):
    return graph.neighbour_connectivity(_und(spark, folder)).withColumn("connectivity", r6("connectivity"))


@query(f"""WITH {_U}, f AS (SELECT a.node, b.other FROM ways a JOIN ways b ON a.other = b.node WHERE a.node <> b.other UNION SELECT node, other FROM ways)
SELECT node, count(*) + 1 AS size FROM f GROUP BY node""")
def two_step_ego(spark, folder):
    return graph.ego_sizes(_und(spark, folder), 2)


@query("""WITH m AS (SELECT l_suppkey AS road, o_custkey % 40 AS place, median(l_partkey) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
n AS (SELECT place, lead(place) OVER (PARTITION BY road ORDER BY m, place) AS then_ FROM m)
SELECT DISTINCT least(place, then_) AS src, greatest(place, then_) AS dst FROM n WHERE then_ IS NOT NULL AND place <> then_""")
def road_network(spark, folder):
    line, orders = tables.table(spark, folder, "lineitem"), tables.table(spark, folder, "orders")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return graph.consecutive_places(rows.select(F.col("l_suppkey").alias("road"), (F.col("o_custkey") % 40).alias("place"), F.col("l_partkey").alias("milepost")))


@query(f"""WITH {_U}, gone AS (SELECT 0 AS node UNION ALL SELECT 7), near AS (SELECT ways.node, other FROM ways JOIN gone USING (node) WHERE other NOT IN (SELECT node FROM gone))
SELECT src, dst FROM und WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)
UNION SELECT a.other, b.other FROM near a JOIN near b ON a.node = b.node AND a.other < b.other""")
def bridged_network(spark, folder):
    gone = spark.createDataFrame([(0,), (7,)], "node int")
    return graph.bridge_removed(_und(spark, folder), gone)


@query("""WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS value FROM embeddings),
s AS (SELECT avg(value) AS m, var_pop(value) AS v FROM p), b AS (SELECT CAST(unnest([0.05, 0.1, 0.2]) AS DOUBLE) AS band),
d AS (SELECT sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) AS d, (a.value - m) * (c.value - m) AS zz, v FROM p a, p c, s WHERE a.id <> c.id)
SELECT band, count(*) AS links, round(sum(zz) / (count(*) * first(v)), 6) AS moran_i FROM d, b WHERE d <= band GROUP BY band""")
def moran_bands(spark, folder):
    e = F.col("embedding").cast("array<double>")
    points = tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), e[0].alias("x"), e[1].alias("y"), e[2].alias("value"))
    return graph.morans_i(points, [0.05, 0.1, 0.2]).withColumn("moran_i", r6("moran_i"))


@query(f"""WITH RECURSIVE {_N}, steps AS (SELECT src AS source, src AS node, 0 AS hops FROM (SELECT DISTINCT src FROM edges)
UNION SELECT source, dst, hops + 1 FROM steps JOIN edges ON node = src WHERE hops < 8)
SELECT source, node, CAST(min(hops) AS INTEGER) AS hops FROM steps GROUP BY source, node""")
def bfs_distance(spark, folder):
    edges = paths.settled(tables.network(spark, folder))
    return paths.hops(edges, edges.select(F.col("src").alias("node")).distinct())


_ROADS = """
roads AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(w) AS weight FROM (
  SELECT c_custkey % 60 AS a, (c_custkey * c_custkey + 1) % 60 AS b, CAST(c_custkey % 13 + 1 AS DOUBLE) AS w FROM customer) WHERE a <> b GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_ROADS}, ways AS (SELECT src AS node, dst AS other, weight FROM roads UNION ALL SELECT dst, src, weight FROM roads),
steps AS (SELECT n AS source, n AS node, CAST(0 AS DOUBLE) AS distance FROM (SELECT DISTINCT node AS n FROM ways)
  UNION SELECT source, other, min(distance + weight) FROM steps JOIN ways USING (node) WHERE distance + weight <= 60 GROUP BY ALL)
SELECT CAST(source AS BIGINT) AS source, CAST(node AS BIGINT) AS node, min(distance) AS distance FROM steps GROUP BY source, node""")
def shortest_distance(spark, folder):
    edges = _roads(spark, folder)
    return paths.distances(edges, graph.nodes(edges)).drop("path")


def _roads(spark, folder):
    k = F.col("c_custkey")
    rows = tables.table(spark, folder, "customer").select((k % 60).alias("src"), ((k * k + 1) % 60).alias("dst"), (k % 13 + 1).cast("double").alias("weight"))
    return paths.settled(graph.undirected(rows, "weight", F.min))


@query()
def shortest_path_contraction(spark, folder):
    edges = _roads(spark, folder)
    busy = graph.both_ways(edges).groupBy("node").agg(F.count("*").alias("d"))
    mean = busy.agg(F.avg("d").alias("mean"))
    return paths.contracted(edges, busy.crossJoin(F.broadcast(mean)).filter("d > mean").select("node"))


@query()
def page_rank(spark, folder):
    return paths.pagerank(paths.settled(tables.network(spark, folder))).withColumn("rank", r6("rank"))


@query()
def hubs_and_authorities(spark, folder):
    rows = paths.hubs_authorities(paths.settled(tables.network(spark, folder)))
    return rows.select("node", r6("hub").alias("hub"), r6("authority").alias("authority"))


@query()
def core_numbers(spark, folder):
    return paths.k_core(paths.settled(_und(spark, folder)))


@query()
def propagated_labels(spark, folder):
    return paths.label_propagation(paths.settled(_und(spark, folder)))


@query(f"""WITH {_N}, dy AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS k FROM edges GROUP BY ALL),
w AS (SELECT a AS u, b AS v, k FROM dy UNION ALL SELECT b, a, k FROM dy),
t AS (SELECT x.u AS m, x.v AS a, y.v AS b, x.k AS k1, y.k AS k2 FROM w x JOIN w y ON x.u = y.u AND x.v < y.v),
f AS (SELECT t.*, coalesce(dy.k, 0) AS k FROM t LEFT JOIN dy ON t.a = dy.a AND t.b = dy.b)
SELECT array_to_string(list_sort([k1, k2, k]), '') AS dyads, count(*) AS triads FROM f WHERE k = 0 OR m < a GROUP BY 1""")
def triad_census(spark, folder):
    return graph.triad_census(tables.network(spark, folder))
