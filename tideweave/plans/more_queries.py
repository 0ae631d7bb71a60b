"""Further single operators: filters, joins, roll-ups, simulated changes, scores of nodes and covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import graph, paths, prep, simulate
from ..operators import quality as q
from ..sources import tables
from .registry import query

_W, _N = tables.WEEKLY, tables.NETWORK
_U = _N + """,
und AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY ALL),
ways AS (SELECT src AS node, dst AS other, weight FROM und UNION ALL SELECT dst, src, weight FROM und)"""


def r6(c):
    return F.round(c, 6)


def _und(spark, folder):
    return graph.undirected(tables.network(spark, folder), "weight", F.sum)


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F')""")
def date_range_semi_join(spark, folder):
    orders = tables.table(spark, folder, "orders")
    some = orders.filter("o_orderstatus = 'F'").select("o_orderpriority").distinct()
    day = F.col("o_orderdate")
    rows = orders.filter((day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day < F.lit("1997-01-01").cast("timestamp_ntz")))
    return rows.join(some, "o_orderpriority", "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT replace(replace(l_returnflag, 'A', 'accepted'), 'N', 'none') AS flag, CAST(sum(coalesce(CASE WHEN l_tax > 0.05 THEN l_quantity END, 0)) AS DOUBLE) AS q, count(*) AS n FROM lineitem GROUP BY 1""")
def recoded_values(spark, folder):
    rows = tables.table(spark, folder, "lineitem").replace({"A": "accepted", "N": "none"}, subset=["l_returnflag"])
    q_ = F.when(F.col("l_tax") > 0.05, F.col("l_quantity"))
    return rows.withColumn("q", q_).fillna(0, ["q"]).groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("q").alias("q"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_suppkey, sum(l_quantity) AS q, sum(l_discount) AS d, sum(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, round(q / n, 6) AS q, round(d / n, 6) AS d, round(t / n, 6) AS t FROM t""")
def per_column_shares(spark, folder):
    """Sums of all numeric columns by key, each divided by the number of rows."""
    parts = {"q": "l_quantity", "d": "l_discount", "t": "l_tax"}
    rows = tables.table(spark, folder, "lineitem").groupBy("l_suppkey").agg(*(F.sum(c).alias(k) for k, c in parts.items()), F.count("*").alias("n"))
    return rows.select("l_suppkey", *(r6(F.col(k) / F.col("n")).alias(k) for k in parts))


@query(f"""WITH {_W}, a AS (SELECT location, year, week, round(mean_value, 6) AS v FROM weekly), b AS (SELECT location, year, count(*) AS weeks FROM weekly WHERE week > 26 GROUP BY ALL)
SELECT a.location, a.year, week, v, weeks FROM a LEFT JOIN b ON a.location = b.location AND a.year = b.year""")
def composite_left_join(spark, folder):
    w = tables.weekly(spark, folder)
    late = w.filter("week > 26").groupBy("location", "year").agg(F.count("*").alias("weeks"))
    left = w.select("location", "year", "week", r6("mean_value").alias("v"))
    shared = [c for c in left.columns if c in late.columns]  # a natural join with its columns spelled out
    return left.join(late, shared, "left")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, k.n FROM lineitem l JOIN (SELECT l_returnflag AS f, l_linestatus AS s, l_suppkey AS k, l_linenumber AS j, count(*) AS n FROM lineitem GROUP BY ALL) k
ON l.l_returnflag = k.f AND l.l_linestatus = k.s AND l.l_suppkey = k.k AND l.l_linenumber = k.j""")
def four_key_join(spark, folder):
    line = tables.table(spark, folder, "lineitem")
    keys = {"l_returnflag": "f", "l_linestatus": "s", "l_suppkey": "k", "l_linenumber": "j"}
    n = line.groupBy(*(F.col(a).alias(b) for a, b in keys.items())).agg(F.count("*").alias("n"))
    on = reduce(lambda x, y: x & y, (F.col(a) == F.col(b) for a, b in keys.items()))
    return line.join(n, on).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "n")


@query("""SELECT user_id, array_to_string(list_sort(list(event_type)), ',') AS types, count(*) AS n FROM events GROUP BY user_id""")
def collected_lists(spark, folder):
    return tables.table(spark, folder, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("types"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS k FROM (SELECT DISTINCT event_type, user_id FROM events))
SELECT CAST(k AS INTEGER) AS k, max(CASE WHEN event_type = 'click' THEN user_id END) AS click, max(CASE WHEN event_type = 'view' THEN user_id END) AS "view" FROM r WHERE event_type IN ('click', 'view') GROUP BY k""")
def ragged_to_table(spark, folder):
    """Lists of unequal length as columns of one table."""
    rows = tables.table(spark, folder, "events").filter(F.col("event_type").isin("click", "view")).select("event_type", "user_id").distinct()
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("user_id")))
    return prep.long_to_wide(rows, ["k"], "event_type", "user_id", ["click", "view"])


@query("""SELECT p_partkey, regexp_extract(p_brand, '^[A-Za-z]+', 0) AS word, TRY_CAST(regexp_extract(p_brand, '[0-9]+', 0) AS INTEGER) AS number, split_part(p_name, ' ', 1) AS first_word FROM part""")
def split_columns(spark, folder):
    return tables.table(spark, folder, "part").select(
        "p_partkey", F.regexp_extract("p_brand", "^[A-Za-z]+", 0).alias("word"), F.regexp_extract("p_brand", "[0-9]+", 0).try_cast("int").alias("number"), F.split("p_name", " ")[0].alias("first_word")
    )


@query(f"""WITH {_W} SELECT week, {', '.join(f"round(avg(CASE WHEN year = {y} THEN mean_value END), 6) AS y{y}" for y in range(1995, 2002))} FROM weekly GROUP BY week""")
def transposed_means(spark, folder):
    rows = tables.weekly(spark, folder).withColumn("y", F.concat(F.lit("y"), F.col("year").cast("string")))
    names = [f"y{y}" for y in range(1995, 2002)]
    wide = rows.groupBy("week").pivot("y", names).agg(F.avg("mean_value"))
    return wide.select("week", *(r6(n).alias(n) for n in names))


@query("""SELECT o_custkey, CAST(max_by(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS last_order, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS last_price, count(*) AS n FROM orders GROUP BY 1""")
def last_of_trace(spark, folder):
    at = F.struct("o_orderdate", "o_orderkey")
    return tables.table(spark, folder, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("last_order"), F.max_by("o_totalprice", at).alias("last_price"), F.count("*").alias("n"))


@query(f"""WITH {_N}, d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT r_name AS region, round(avg(d), 6) AS mean, min(d) AS low, max(d) AS high, round(var_samp(d), 6) AS var FROM d JOIN nation ON node = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def degree_by_region(spark, folder):
    d = graph.degrees(tables.network(spark, folder)).withColumnRenamed("degree", "d")
    place = tables.places(spark, folder).select(F.col("nationkey").alias("node"), "region")
    rows = d.join(F.broadcast(place), "node").groupBy("region")
    return rows.agg(r6(F.avg("d")).alias("mean"), F.min("d").alias("low"), F.max("d").alias("high"), r6(F.var_samp("d")).alias("var"))


@query(f"""WITH {_U}, d AS (SELECT node, count(*) AS d FROM ways GROUP BY node), t AS (SELECT 1 AS one, d.* FROM d)
SELECT count(*) FILTER (d IS NULL) AS isolated, count(*) FILTER (d = 1) AS pendant, count(*) AS nodes FROM nation LEFT JOIN d ON n_nationkey = node""")
def isolated_and_pendant(spark, folder):
    d = graph.both_ways(_und(spark, folder)).groupBy("node").agg(F.count("*").alias("d"))
    rows = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("node")).join(d, "node", "left")
    return rows.agg(F.count(F.when(F.col("d").isNull(), 1)).alias("isolated"), F.count(F.when(F.col("d") == 1, 1)).alias("pendant"), F.count("*").alias("nodes"))


@query(f"""WITH {_N} SELECT count(*) AS edges, n AS nodes, round(count(*) / (n * (n - 1)), 6) AS density FROM edges, (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) GROUP BY n""")
def density(spark, folder):
    e = tables.network(spark, folder)
    n = graph.nodes(e).agg(F.count("*").alias("nodes"))
    return e.agg(F.count("*").alias("edges")).crossJoin(n).select("edges", "nodes", r6(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"))


@query(f"""WITH {_N}, keep AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey < 3) SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM keep) AND dst IN (SELECT node FROM keep)""")
def induced_subgraph(spark, folder):
    keep = tables.table(spark, folder, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("node"))
    return graph.induced(tables.network(spark, folder), keep)


@query(f"""WITH RECURSIVE {_N}, steps AS (SELECT src AS source, src AS node, 0 AS hops FROM (SELECT DISTINCT src FROM edges) UNION SELECT source, dst, hops + 1 FROM steps JOIN edges ON node = src WHERE hops < 8),
d AS (SELECT source, node, min(hops) AS hops FROM steps GROUP BY ALL)
SELECT CAST(max(hops) AS INTEGER) AS diameter, round(avg(CASE WHEN hops > 0 THEN hops END), 6) AS mean_distance, round(avg(CASE WHEN hops > 0 THEN 1.0 / hops END), 6) AS efficiency FROM d""")
def distance_summary(spark, folder):
    """Diameter, mean distance and mean inverse distance over pairs that are connected."""
    edges = paths.settled(tables.network(spark, folder))
    d = paths.hops(edges, edges.select(F.col("src").alias("node")).distinct())
    far = F.when(F.col("hops") > 0, F.col("hops"))
    return d.agg(F.max("hops").alias("diameter"), r6(F.avg(far)).alias("mean_distance"), r6(F.avg(1.0 / far)).alias("efficiency"))


@query(f"""WITH RECURSIVE {_N}, steps AS (SELECT src AS source, src AS node, 0 AS hops FROM (SELECT DISTINCT src FROM edges) UNION SELECT source, dst, hops + 1 FROM steps JOIN edges ON node = src WHERE hops < 8),
d AS (SELECT source, node, min(hops) AS hops FROM steps GROUP BY ALL) SELECT source AS node, CAST(max(hops) AS INTEGER) AS eccentricity, round((count(*) - 1) / nullif(CAST(sum(hops) AS BIGINT), 0), 6) AS closeness FROM d GROUP BY source""")
def eccentricity(spark, folder):
    edges = paths.settled(tables.network(spark, folder))
    d = paths.hops(edges, edges.select(F.col("src").alias("node")).distinct())
    return d.groupBy(F.col("source").alias("node")).agg(F.max("hops").alias("eccentricity"), r6(F.try_divide(F.count("*") - 1, F.sum("hops"))).alias("closeness"))


@query("""WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS value FROM embeddings),
s AS (SELECT avg(value) AS m, var_pop(value) AS v FROM p), z AS (SELECT id, x, y, value - m AS z, v FROM p, s)
SELECT a.id, count(*) AS links, round(a.z * sum(b.z) / (count(*) * a.v), 6) AS local_i FROM z a JOIN z b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1 GROUP BY a.id, a.z, a.v""")
def local_moran(spark, folder):
    """Local Moran's I with neighbours nearer than 0.1, compared within neighbouring squares."""
    e = F.col("embedding").cast("array<double>")
    p = tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), e[0].alias("x"), e[1].alias("y"), e[2].alias("value"))
    one = p.agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    z = p.crossJoin(F.broadcast(one)).select("id", "x", "y", (F.col("value") - F.col("m")).alias("z"), "v")
    cell = lambda c: F.floor(F.col(c) / 0.1)
    near = F.explode(F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = z.select("id", "x", "y", "z", "v", near.alias("c")).select("id", "x", "y", "z", "v", "c.cx", "c.cy")
    b = z.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    rows = a.join(b, ["cx", "cy"]).filter((F.col("id") != F.col("id2")) & (d <= 0.1))
    return rows.groupBy("id", "z", "v").agg(F.count("*").alias("links"), F.sum("z2").alias("s")).select("id", "links", r6(F.col("z") * F.col("s") / (F.col("links") * F.col("v"))).alias("local_i"))


@query(f"""WITH {_U}, m AS (SELECT n_nationkey AS node, n_regionkey AS r FROM nation),
x AS (SELECT a.r AS ra, b.r AS rb FROM und JOIN m a ON src = a.node JOIN m b ON dst = b.node), n AS (SELECT r, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY r),
k AS (SELECT least(ra, rb) AS r, greatest(ra, rb) AS s, CAST(count(*) AS DOUBLE) AS m FROM x GROUP BY ALL)
SELECT a.r AS r, b.r AS s, coalesce(k.m, 0) AS edges, round(coalesce(k.m, 0) / (CASE WHEN a.r = b.r THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END), 6) AS probability
FROM n a JOIN n b ON a.r <= b.r LEFT JOIN k ON k.r = a.r AND k.s = b.r""")
def node_mix_estimate(spark, folder):
    """Probability of an edge by pair of groups: the maximum-likelihood fit of a node-mix model."""
    m = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("level"))
    found = graph.mixing_matrix(_und(spark, folder), m).select(F.col("level_a").alias("r"), F.col("level_b").alias("s"), F.col("edges").cast("double").alias("m"))
    n = m.groupBy("level").agg(F.count("*").cast("double").alias("n"))
    a, b = n.select(F.col("level").alias("r"), F.col("n").alias("nr")), n.select(F.col("level").alias("s"), F.col("n").alias("ns"))
    pairs = a.join(b, F.col("r") <= F.col("s")).join(found, ["r", "s"], "left").fillna(0.0, ["m"])
    total = F.when(F.col("r") == F.col("s"), F.col("nr") * (F.col("nr") - 1) / 2).otherwise(F.col("nr") * F.col("ns"))
    return pairs.select("r", "s", F.col("m").alias("edges"), r6(F.try_divide("m", total)).alias("probability"))


@query("""WITH l AS (SELECT DISTINCT p_type AS level, substr(p_type, 1, 1) AS g FROM part) SELECT a.level AS a, b.level AS b, CASE WHEN a.level = b.level THEN 0.5 WHEN a.g = b.g THEN 0.2 ELSE 0.05 END::DOUBLE AS probability FROM l a JOIN l b ON a.level >= b.level""")
def category_pair_table(spark, folder):
    levels = tables.table(spark, folder, "part").select(F.col("p_type").alias("level"), F.substring("p_type", 1, 1).alias("group")).distinct()
    return simulate.category_pairs(levels, 0.5, 0.2, 0.05)


@query()
def edges_removed(spark, folder):
    """Share of edges left after random removal, by group, for several shares: a sensitivity table."""
    e = tables.network(spark, folder)
    out = []
    for share in (0.1, 0.3, 0.5):
        left = simulate.remove_share(e, ["src"], ["src", "dst"], share, seed=3)
        out.append(left.groupBy("src").agg(F.count("*").alias("left")).withColumn("share", F.lit(share)))
    total = e.groupBy("src").agg(F.count("*").alias("edges"))
    return reduce(lambda a, b: a.unionByName(b), out).join(total, "src")


@query()
def values_blanked(spark, folder):
    """Gaps at random, among large and among small values, and the errors of filling them by the mean."""
    rows = tables.covariates(spark, folder).withColumnRenamed("value", "truth").withColumn("value", F.col("truth"))
    parts = []
    for name, among in (("random", None), ("large", F.col("truth") > 0), ("small", F.col("truth") < 0)):
        gaps = simulate.blank_share(rows, ["cov"], ["node", "cov"], "value", 0.2, 5, among)
        filled = F.coalesce("value", F.avg("value").over(Window.partitionBy("cov")))
        parts.append(q.imputation_error(gaps.withColumn("imputed", filled)).withColumn("kind", F.lit(name)))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumns({c: r6(c) for c in ("rmse", "rmse_missing", "rmse_missing_all_rows")})


@query()
def simulated_blocks(spark, folder):
    """A block model drawn over the nations, its mixing matrix and its log-likelihood."""
    nodes = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("block"))
    e = simulate.block_edges(nodes, "block", 0.7, 0.1, 11)
    mix = graph.mixing_matrix(e, nodes.withColumnRenamed("block", "level"))
    return mix.crossJoin(q.block_loglik(e, nodes).select(r6("loglik").alias("loglik")))


@query("""WITH c AS (SELECT user_id % 5 AS grp, event_type FROM events), m AS (SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS lg FROM (SELECT DISTINCT event_type FROM events))
SELECT grp, round(avg(CASE WHEN lg = grp % 2 THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n FROM c JOIN m USING (event_type) GROUP BY grp""")
def group_agreement(spark, folder):
    """Share of rows whose level's group is the one that their cluster stands for."""
    events = tables.table(spark, folder, "events")
    level = events.select("event_type").distinct().withColumn("lg", F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1))
    rows = events.select((F.col("user_id") % 5).alias("grp"), "event_type").join(level, "event_type")
    return rows.groupBy("grp").agg(r6(F.avg((F.col("lg") == F.col("grp") % 2).cast("double"))).alias("agreement"), F.count("*").alias("n"))


_C = tables.COVARIATES


@query(f"""WITH {_C}, g AS (SELECT node, cov, round(value * 10) AS v FROM covariates), n AS (SELECT cov, CAST(v AS INTEGER) AS v, count(*) AS n FROM g WHERE v >= 1 GROUP BY ALL)
SELECT CAST(cov AS INTEGER) AS cov, v AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY cov ORDER BY n DESC, v) AS k FROM n) WHERE k = 1""")
def integer_mode(spark, folder):
    """The most frequent positive integer of rounded values."""
    rows = tables.covariates(spark, folder).withColumn("v", F.round(F.col("value") * 10).cast("int")).filter("v >= 1")
    return prep.mode(rows, ["cov"], "v")


@query(f"""WITH {_W}, t AS (SELECT region, year, week, avg(mean_value) AS v FROM weekly GROUP BY ALL), p AS (SELECT region, year * 53 + week AS i, v FROM t),
w AS (SELECT a.i, max(CASE WHEN a.region = 'AFRICA' THEN a.v END) AS x, max(CASE WHEN a.region = 'ASIA' THEN a.v END) AS y FROM p a GROUP BY a.i)
SELECT count(*) AS weeks, round(corr(x, y), 6) AS r FROM w""")
def cross_correlation(spark, folder):
    rows = tables.weekly(spark, folder).groupBy("region", (F.col("year") * 53 + F.col("week")).alias("i")).agg(F.avg("mean_value").alias("v"))
    wide = prep.long_to_wide(rows, ["i"], "region", "v", ["AFRICA", "ASIA"])
    return wide.agg(F.count("*").alias("weeks"), r6(F.corr("AFRICA", "ASIA")).alias("r"))


_M = tables.MEMBERSHIPS


@query(f"""WITH {_M}, n AS (SELECT half, node, count(*) AS k FROM memberships GROUP BY ALL), u AS (SELECT half, user_id AS node FROM (SELECT DISTINCT user_id FROM events), (SELECT 1 AS half UNION ALL SELECT 2))
SELECT u.half, coalesce(k, 0) AS communities, count(*) AS nodes FROM u LEFT JOIN n USING (half, node) GROUP BY ALL""")
def overlap_distribution(spark, folder):
    """How many nodes are in so many communities, by half month; 0 counts too."""
    m = tables.memberships(spark, folder).groupBy("half", "node").agg(F.count("*").alias("k"))
    nodes = tables.table(spark, folder, "events").select(F.col("user_id").alias("node")).distinct()
    every = nodes.withColumn("half", F.explode(F.array(F.lit(1), F.lit(2))))
    return every.join(m, ["half", "node"], "left").groupBy("half", F.coalesce("k", F.lit(0)).alias("communities")).agg(F.count("*").alias("nodes"))


@query(f"""WITH {_M}, a AS (SELECT * FROM memberships WHERE half = 1), b AS (SELECT * FROM memberships WHERE half = 2),
x AS (SELECT a.community AS c, b.community AS d, CAST(count(*) AS DOUBLE) AS k FROM a JOIN b ON a.node = b.node GROUP BY ALL),
na AS (SELECT community AS c, CAST(count(*) AS DOUBLE) AS n FROM a GROUP BY 1), nb AS (SELECT community AS d, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY 1),
f AS (SELECT c, d, 2 * k / (na.n + nb.n) AS f1 FROM x JOIN na USING (c) JOIN nb USING (d)), p AS (SELECT c, max(f1) AS f1 FROM f GROUP BY c), r AS (SELECT d, max(f1) AS f1 FROM f GROUP BY d)
SELECT round(((SELECT avg(f1) FROM p) + (SELECT avg(f1) FROM r)) / 2, 6) AS f1""")
def cover_f1(spark, folder):
    """Mean F1 of each community's best match, both ways."""
    m = tables.memberships(spark, folder)
    a, b = m.filter("half = 1").select("node", F.col("community").alias("c")), m.filter("half = 2").select("node", F.col("community").alias("d"))
    both = a.join(b, "node").groupBy("c", "d").agg(F.count("*").alias("k"))
    f = both.join(a.groupBy("c").agg(F.count("*").alias("n1")), "c").join(b.groupBy("d").agg(F.count("*").alias("n2")), "d").withColumn("f1", 2 * F.col("k") / (F.col("n1") + F.col("n2")))
    p = f.groupBy("c").agg(F.max("f1").alias("f1")).agg(F.avg("f1").alias("p"))
    r = f.groupBy("d").agg(F.max("f1").alias("f1")).agg(F.avg("f1").alias("r"))
    return p.crossJoin(r).select(r6((F.col("p") + F.col("r")) / 2).alias("f1"))


@query(f"""WITH {_M}, n AS (SELECT community, count(*) AS n FROM memberships WHERE half = 1 GROUP BY 1), t AS (SELECT count(DISTINCT user_id) AS t FROM events) SELECT node, community FROM memberships SEMI JOIN (SELECT community FROM n, t WHERE n <= 0.8 * t AND n > 2) k USING (community) WHERE half = 1""")
def trimmed_communities(spark, folder):
    m = tables.memberships(spark, folder).filter("half = 1").select("node", "community")
    n = tables.table(spark, folder, "events").select("user_id").distinct().count()
    return q.trimmed(m, n, 0.8, 2)


@query("""WITH t AS (SELECT p_brand AS scenario, CASE WHEN p_size <= 25 THEN 'with' ELSE 'without' END AS kind, avg(p_retailprice) AS m FROM part GROUP BY ALL)
SELECT scenario, round(max(CASE WHEN kind = 'with' THEN m END) - max(CASE WHEN kind = 'without' THEN m END), 6) AS difference FROM t GROUP BY scenario""")
def covariate_difference(spark, folder):
    rows = tables.table(spark, folder, "part").select(F.col("p_brand").alias("scenario"), F.when(F.col("p_size") <= 25, "with").otherwise("without").alias("kind"), F.col("p_retailprice").alias("v"))
    wide = rows.groupBy("scenario").pivot("kind", ["with", "without"]).agg(F.avg("v"))
    return wide.select("scenario", r6(F.col("with") - F.col("without")).alias("difference"))


@query("""WITH g AS (SELECT p_brand AS scenario, p_retailprice >= 1000 AS good FROM part) SELECT scenario, CAST(count(*) FILTER (good) AS BIGINT) AS good, round(count(*) FILTER (good) / count(*), 6) AS share FROM g GROUP BY scenario""")
def good_share(spark, folder):
    good = F.col("p_retailprice") >= 1000
    rows = tables.table(spark, folder, "part").groupBy(F.col("p_brand").alias("scenario")).agg(F.count(F.when(good, 1)).alias("good"), F.count("*").alias("n"))
    return rows.select("scenario", "good", r6(F.col("good") / F.col("n")).alias("share"))


@query("""SELECT c_custkey, round(c_acctbal / 10000, 6) AS p, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS inv, round(CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 + ln(1 + exp(-c_acctbal / 1000)) ELSE ln(1 + exp(c_acctbal / 1000)) END, 6) AS lse FROM customer""")
def link_functions(spark, folder):
    x = F.col("c_acctbal") / 1000
    return tables.table(spark, folder, "customer").select("c_custkey", r6(F.col("c_acctbal") / 10000).alias("p"), r6(numbers.inverse_logit(x)).alias("inv"), r6(numbers.log1pexp(x)).alias("lse"))


@query()
def eigen_centrality(spark, folder):
    """Leading eigenvector of the flow network by power steps, scaled to a largest value of 1."""
    both = paths.settled(graph.both_ways(_und(spark, folder), "weight"))
    v = both.select("node").distinct().withColumn("x", F.lit(1.0))
    for _ in range(25):
        new = both.join(v.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        new = new.crossJoin(F.broadcast(new.agg(F.max("x").alias("top")))).select("node", (F.col("x") / F.col("top")).alias("x"))
        v = paths.settled(new)
    return v.select("node", r6("x").alias("centrality"))


@query()
def padded_segments(spark, folder):
    """Segments stretched to their envelope, null outside a series' own part, then differenced."""
    from .model_queries import break_envelopes, filled_panel

    rows = filled_panel(spark, folder)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("location").orderBy("year", "week")) - 1)
    env = break_envelopes(spark, folder).withColumn("pos", F.explode(F.sequence("low", F.col("high") - 1)))
    own = env.join(rows.select("location", "pos", "value"), ["location", "pos"], "left")
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    own = own.select("id", "location", "pos", F.when(inside, F.col("value")).alias("value"))
    d = F.col("value") - F.lag("value").over(Window.partitionBy("id", "location").orderBy("pos"))
    return own.withColumn("diff", r6(d)).withColumn("value", r6("value"))
