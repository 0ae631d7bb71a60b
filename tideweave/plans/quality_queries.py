"""Communities of users by event type, scored against each other, a graph and covariates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, pareto, quality
from ..sources import tables
from .registry import query

_M = tables.MEMBERSHIPS
_USERS = """
following AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events),
ug AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM following WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT DISTINCT user_id AS node FROM events)"""
_H1 = "h1 AS (SELECT node, community FROM memberships WHERE half = 1)"
_BG = f"{_M}, {_H1}, {_USERS}, m AS (SELECT * FROM h1 UNION ALL SELECT node, '0' FROM nodes WHERE node NOT IN (SELECT node FROM h1))"


def r6(c):
    return F.round(c, 6)


def _users(spark, folder):
    """Undirected edges between users whose events of a type follow one another on a day."""
    events = tables.table(spark, folder, "events")
    then = F.lead("user_id").over(Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id"))
    rows = events.select(F.col("user_id").alias("src"), then.alias("dst")).filter("dst IS NOT NULL")
    return graph.undirected(rows)


def _nodes(spark, folder):
    return tables.table(spark, folder, "events").select(F.col("user_id").alias("node")).distinct()


def _half(spark, folder, k):
    return tables.memberships(spark, folder).filter(F.col("half") == k).select("node", "community")


def _rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


@query(f"""WITH {_M}, {_H1}, h2 AS (SELECT node, community FROM memberships WHERE half = 2), nodes AS (SELECT DISTINCT user_id AS node FROM events),
p AS (SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON a.node < b.node),
j AS (SELECT x.node AS u, y.node AS v, count(*) AS j FROM h1 x JOIN h1 y ON x.community = y.community AND x.node < y.node GROUP BY ALL),
k AS (SELECT x.node AS u, y.node AS v, count(*) AS k FROM h2 x JOIN h2 y ON x.community = y.community AND x.node < y.node GROUP BY ALL),
c AS (SELECT coalesce(j, 0) AS j, coalesce(k, 0) AS k, CAST(count(*) AS DOUBLE) AS n FROM p LEFT JOIN j USING (u, v) LEFT JOIN k USING (u, v) GROUP BY ALL),
t AS (SELECT sum(n) AS p, sum(CASE WHEN j = k THEN n ELSE 0 END) AS s FROM c),
e AS (SELECT sum(a.n * b.n) AS e FROM (SELECT j, sum(n) AS n FROM c GROUP BY j) a JOIN (SELECT k, sum(n) AS n FROM c GROUP BY k) b ON a.j = b.k)
SELECT round(s / p, 6) AS observed, round(e / (p * p), 6) AS expected, round((s / p - e / (p * p)) / (1 - e / (p * p)), 6) AS omega FROM t, e""")
def omega_index(spark, folder):
    return _rounded(quality.omega(_half(spark, folder, 1), _half(spark, folder, 2), _nodes(spark, folder)), "observed", "expected", "omega")


@query("""WITH n AS (SELECT user_id, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS half, event_type, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT user_id, half, event_type, row_number() OVER (PARTITION BY user_id, half ORDER BY n DESC, event_type) AS k FROM n),
c AS (SELECT a.event_type AS a, b.event_type AS b, CAST(count(*) AS DOUBLE) AS n FROM l a JOIN l b ON a.user_id = b.user_id WHERE a.half = 1 AND b.half = 2 AND a.k = 1 AND b.k = 1 GROUP BY ALL),
t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), sa AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), sb AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM t, sa, sb""")
def adjusted_rand(spark, folder):
    n = tables.table(spark, folder, "events").groupBy("user_id", F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("half"), "event_type").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("user_id", "half").orderBy(F.col("n").desc(), "event_type"))
    label = n.withColumn("k", k).filter("k = 1")
    a = label.filter("half = 1").select("user_id", F.col("event_type").alias("a"))
    b = label.filter("half = 2").select("user_id", F.col("event_type").alias("b"))
    return _rounded(quality.adjusted_rand(a.join(b, "user_id")), "ari")


@query(f"""WITH {_M}, {_H1}, h2 AS (SELECT node, community FROM memberships WHERE half = 2), cells AS (SELECT node, community FROM (SELECT DISTINCT user_id AS node FROM events), (SELECT DISTINCT event_type AS community FROM events)),
x AS (SELECT h1.node IS NOT NULL AS t, h2.node IS NOT NULL AS p FROM cells LEFT JOIN h1 USING (node, community) LEFT JOIN h2 ON cells.node = h2.node AND cells.community = h2.community),
c AS (SELECT CAST(count(*) FILTER (t AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT t AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (t AND NOT p) AS DOUBLE) AS fn, CAST(count(*) AS DOUBLE) AS n FROM x)
SELECT round(1 - (fp + fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def precision_recall_f1(spark, folder):
    types = tables.table(spark, folder, "events").select(F.col("event_type").alias("community")).distinct()
    cells = _nodes(spark, folder).crossJoin(types)
    truth, found = _half(spark, folder, 1).withColumn("truth", F.lit(1)), _half(spark, folder, 2).withColumn("predicted", F.lit(1))
    cells = cells.join(truth, ["node", "community"], "left").join(found, ["node", "community"], "left").fillna(0, ["truth", "predicted"])
    return _rounded(quality.precision_recall(cells), "accuracy", "precision", "recall", "f1")


_C = tables.COVARIATES


@query(f"""WITH {_C}, m AS (SELECT *, node % 5 = cov AS gone FROM covariates), f AS (SELECT *, CASE WHEN gone THEN avg(CASE WHEN NOT gone THEN value END) OVER (PARTITION BY community, cov) ELSE value END AS imputed FROM m)
SELECT CAST(cov AS INTEGER) AS cov, round(sqrt(avg((value - imputed) ** 2)), 6) AS rmse, round(sqrt(avg(CASE WHEN gone THEN (value - imputed) ** 2 END)), 6) AS rmse_missing,
round(sqrt(sum(CASE WHEN gone THEN (value - imputed) ** 2 END) / count(*)), 6) AS rmse_missing_all_rows FROM f GROUP BY cov""")
def rmse_observed_missing(spark, folder):
    rows = tables.covariates(spark, folder).withColumn("is_missing", F.col("node") % 5 == F.col("cov"))
    mean = F.avg(F.when(~F.col("is_missing"), F.col("value"))).over(Window.partitionBy("community", "cov"))
    rows = rows.withColumn("imputed", F.when(F.col("is_missing"), mean).otherwise(F.col("value"))).withColumnRenamed("value", "truth")
    return _rounded(quality.imputation_error(rows), "rmse", "rmse_missing", "rmse_missing_all_rows")


@query(f"""WITH {_C}, g AS (SELECT cov, var_samp(value) AS av FROM covariates GROUP BY cov), o AS (SELECT community, cov, var_samp(value) AS v, count(*) AS n FROM covariates GROUP BY ALL)
SELECT community, max(n) AS size, round(avg(v / av), 6) AS dispersion FROM o JOIN g USING (cov) GROUP BY community""")
def dispersion_continuous(spark, folder):
    return _rounded(quality.dispersion(tables.covariates(spark, folder)), "dispersion")


_BIN = f"{_C}, b AS (SELECT node, community, cov, CAST(value > 0 AS INTEGER) AS value FROM covariates)"


@query(f"""WITH {_BIN}, g AS (SELECT cov, avg(value) * (1 - avg(value)) AS av FROM b GROUP BY cov), o AS (SELECT community, cov, avg(value) * (1 - avg(value)) AS v, count(*) AS n FROM b GROUP BY ALL)
SELECT community, max(n) AS size, round(avg(v), 6) AS spread, round(avg(v / av), 6) AS ratio FROM o JOIN g USING (cov) GROUP BY community""")
def dispersion_binary(spark, folder):
    rows = tables.covariates(spark, folder).withColumn("value", (F.col("value") > 0).cast("int"))
    return _rounded(quality.binary_dispersion(rows), "spread", "ratio")


@query(f"""WITH {_C}, o AS (SELECT community, cov, var_samp(value) AS v, count(*) AS n FROM covariates GROUP BY ALL), g AS (SELECT cov, var_samp(value) AS v, count(*) AS n FROM covariates GROUP BY cov),
w AS (SELECT sum((n - 1) * v) AS w FROM o), t AS (SELECT sum((n - 1) * v) AS t FROM g) SELECT round(w, 6) AS within, round(t, 6) AS total, round(1 - w / t, 6) AS r2 FROM w, t""")
def trace_r2(spark, folder):
    return _rounded(quality.trace_r2(tables.covariates(spark, folder)), "within", "total", "r2")


@query(f"""WITH {_C}, l AS (SELECT cov, min(value) AS lo, max(value) AS hi FROM covariates GROUP BY cov), x AS (SELECT node, community, cov, (value - lo) / (hi - lo) AS x FROM covariates JOIN l USING (cov)),
p AS (SELECT a.community, a.node AS u, b.node AS v, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c FROM x a JOIN x b ON a.community = b.community AND a.cov = b.cov AND a.node < b.node GROUP BY ALL),
n AS (SELECT community, count(DISTINCT node) AS n FROM x GROUP BY community)
SELECT p.community, first(n.n) AS n, round(avg(c), 6) AS cosine FROM p JOIN n ON p.community = n.community GROUP BY p.community""")
def cosine_cohesion(spark, folder):
    return _rounded(quality.cosine_cohesion(tables.covariates(spark, folder)), "cosine")


@query(f"""WITH {_C}, d AS (SELECT a.node, b.community AS other, b.node = a.node AS self, sum((a.value - b.value) ** 2) AS d FROM covariates a JOIN covariates b ON a.cov = b.cov GROUP BY a.node, b.community, b.node),
m AS (SELECT d.node, other, other = o.community AS own, avg(CASE WHEN NOT self THEN d END) AS d FROM d JOIN (SELECT DISTINCT node, community FROM covariates) o ON d.node = o.node GROUP BY ALL),
s AS (SELECT node, avg(CASE WHEN own THEN d END) AS a, min(CASE WHEN NOT own THEN d END) AS b FROM m GROUP BY node)
SELECT community, round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM s JOIN (SELECT DISTINCT node, community FROM covariates) USING (node) GROUP BY community""")
def silhouette_scores(spark, folder):
    return _rounded(quality.silhouette(tables.covariates(spark, folder)), "silhouette")


_INSIDE = "ins AS (SELECT a.community, src, dst FROM ug JOIN m a ON src = a.node JOIN m b ON dst = b.node AND a.community = b.community)"


@query(f"""WITH {_BG}, {_INSIDE}, i AS (SELECT community, count(*) AS m FROM ins GROUP BY 1), n AS (SELECT community, count(*) AS n FROM m GROUP BY 1)
SELECT community, n, coalesce(m, 0) AS edges, CASE WHEN n > 1 THEN round(2.0 * coalesce(m, 0) / (n * (n - 1)), 6) ELSE 0 END AS density FROM n LEFT JOIN i USING (community)""")
def internal_density(spark, folder):
    m = quality.with_background(_half(spark, folder, 1), _nodes(spark, folder))
    return _rounded(quality.internal_density(_users(spark, folder), m), "density")


@query(f"""WITH {_BG}, {_INSIDE}, t AS (SELECT x.community, x.src AS a, x.dst AS b, y.dst AS c FROM ins x JOIN ins y ON x.community = y.community AND x.dst = y.src JOIN ins z ON z.community = x.community AND z.src = x.src AND z.dst = y.dst),
k AS (SELECT community, count(*) AS t FROM (SELECT community, a AS node FROM t UNION SELECT community, b FROM t UNION SELECT community, c FROM t) GROUP BY 1), n AS (SELECT community, count(*) AS n FROM m GROUP BY 1)
SELECT community, n, round(coalesce(t, 0) / n, 6) AS participation FROM n LEFT JOIN k USING (community)""")
def triangle_participation(spark, folder):
    m = quality.with_background(_half(spark, folder, 1), _nodes(spark, folder))
    return _rounded(quality.triangle_participation(_users(spark, folder), m), "participation")


@query(f"""WITH {_BG}, e AS (SELECT a.community AS c, b.community AS d, max(CASE WHEN a.community = b.community THEN 1 ELSE 0 END) OVER (PARTITION BY src, dst) AS common FROM ug JOIN m a ON src = a.node JOIN m b ON dst = b.node),
r AS (SELECT c, d FROM e WHERE common = 0 OR c = d UNION ALL SELECT a.community, b.community FROM m a JOIN m b ON a.node = b.node AND a.community < b.community),
x AS (SELECT c AS community, c = d AS ins, 1 AS n FROM r UNION ALL SELECT d, false, 1 FROM r WHERE c <> d),
v AS (SELECT community, CAST(sum(CASE WHEN ins THEN 0 ELSE n END) AS BIGINT) AS cut, CAST(sum(CASE WHEN ins THEN 2 * n ELSE n END) AS BIGINT) AS volume FROM x GROUP BY 1), t AS (SELECT 2 * count(*) AS total FROM r)
SELECT community, cut, volume, CASE WHEN least(volume, total - volume) > 0 THEN round(cut / least(volume, total - volume), 6) ELSE 0 END AS conductance FROM v, t""")
def ego_split_conductance(spark, folder):
    m = quality.with_background(_half(spark, folder, 1), _nodes(spark, folder))
    return _rounded(quality.conductance(quality.ego_split_mixing(_users(spark, folder), m)), "conductance")


@query(f"""WITH {_BG}, s AS (SELECT node, community, 1.0 / count(*) OVER (PARTITION BY node) AS a FROM m), d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM ug UNION ALL SELECT dst FROM ug) GROUP BY 1), t AS (SELECT count(*) AS m FROM ug),
e AS (SELECT x.a * y.a AS aa, dx.d * dy.d AS dd, t.m FROM ug JOIN s x ON src = x.node JOIN s y ON dst = y.node AND x.community = y.community JOIN d dx ON src = dx.node JOIN d dy ON dst = dy.node, t),
k AS (SELECT sum((k / (2 * m)) ** 2) AS ex FROM (SELECT community, sum(a * d) AS k FROM s JOIN d USING (node) GROUP BY 1), t)
SELECT round(sum(aa * (1 - dd / (2 * m)) / m), 6) AS q_edges, round(sum(aa / m) - first(ex), 6) AS q_newman FROM e, k""")
def modularity_overlap(spark, folder):
    m = quality.with_background(_half(spark, folder, 1), _nodes(spark, folder))
    return _rounded(quality.modularity(_users(spark, folder), m), "q_edges", "q_newman")


@query(f"""WITH {_M}, {_H1}, n AS (SELECT community, count(*) AS n FROM h1 GROUP BY 1) SELECT x.community AS a, y.community AS b, round(count(*) / first(n), 6) AS share
FROM h1 x JOIN h1 y ON x.node = y.node AND x.community <> y.community JOIN n ON n.community = x.community GROUP BY ALL""")
def community_containment(spark, folder):
    return _rounded(quality.containment(_half(spark, folder, 1)), "share")


@query(f"""WITH {_BG}, {_INSIDE}, i AS (SELECT community, count(*) AS m FROM ins GROUP BY 1), n AS (SELECT community, count(*) AS n FROM m GROUP BY 1),
d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM ug UNION ALL SELECT dst FROM ug) GROUP BY 1), v AS (SELECT community, sum(d) AS vol FROM m JOIN d USING (node) GROUP BY 1),
o AS (SELECT community, avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) AS overlap FROM (SELECT community, count(*) OVER (PARTITION BY node) AS k FROM m) GROUP BY 1),
r AS (SELECT community, n, coalesce(m, 0) AS m, coalesce(vol, 0) AS vol, overlap FROM n LEFT JOIN i USING (community) LEFT JOIN v USING (community) JOIN o USING (community))
SELECT community, round((m - (n - 1)) / nullif(n * (n - 1) / 2 - (n - 1), 0), 6) AS partition_density, round((m - (vol - 2 * m)) / n, 6) AS quality, round((vol - 2 * m) / nullif(vol, 0), 6) AS normalised_cut, round(overlap, 6) AS overlap FROM r""")
def cover_scores(spark, folder):
    m = quality.with_background(_half(spark, folder, 1), _nodes(spark, folder))
    return _rounded(quality.cover_scores(_users(spark, folder), m), "partition_density", "quality", "normalised_cut", "overlap")


@query(f"""WITH {tables.NETWORK}, u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges), e AS (SELECT src, dst FROM u UNION ALL SELECT dst, src FROM u),
m AS (SELECT x.n_regionkey AS r, y.n_regionkey AS s, CAST(count(*) AS DOUBLE) AS m FROM e JOIN nation x ON src = x.n_nationkey JOIN nation y ON dst = y.n_nationkey GROUP BY ALL), n AS (SELECT n_regionkey AS r, CAST(count(*) AS DOUBLE) AS n FROM nation GROUP BY 1)
SELECT round(sum(m * ln(m / (a.n * b.n))), 6) AS loglik FROM m JOIN n a ON m.r = a.r JOIN n b ON m.s = b.r""")
def sbm_loglik(spark, folder):
    blocks = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("block"))
    return _rounded(quality.block_loglik(graph.undirected(tables.network(spark, folder)), blocks), "loglik")


_CAND = """cand AS (SELECT p_partkey AS run, p_brand AS scenario, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part)"""


def _candidates(spark, folder):
    return tables.table(spark, folder, "part").select(F.col("p_partkey").alias("run"), F.col("p_brand").alias("scenario"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


@query(f"""WITH {_CAND} SELECT scenario, run, x, y FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE a.scenario = b.scenario AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))""")
def pareto_front1(spark, folder):
    return pareto.first_front(_candidates(spark, folder), ["scenario"], "x", "y").select("scenario", "run", "x", "y")


@query()
def pareto_all_fronts(spark, folder):
    return pareto.fronts(_candidates(spark, folder), ["scenario"], ["x", "y"])


@query(f"""WITH {_CAND}, f AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE a.scenario = b.scenario AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y)))
SELECT run, x, y FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))""")
def pareto_front_of_fronts(spark, folder):
    one = pareto.first_front(_candidates(spark, folder), ["scenario"], "x", "y").withColumn("all", F.lit(0))
    return pareto.first_front(one, ["all"], "x", "y").select("run", "x", "y")


@query(f"""WITH {_CAND}, b AS (SELECT scenario, 'least x' AS kind, min_by(run, (x, run)) AS run FROM cand GROUP BY 1 UNION ALL SELECT scenario, 'least y', min_by(run, (y, run)) FROM cand GROUP BY 1
UNION ALL SELECT scenario, 'largest x', min_by(run, (-x, run)) FROM cand GROUP BY 1) SELECT * FROM b""")
def best_run_per_scenario(spark, folder):
    rows = _candidates(spark, folder)
    out = rows.groupBy("scenario").agg(F.min_by("run", F.struct("x", "run")).alias("least x"), F.min_by("run", F.struct("y", "run")).alias("least y"), F.min_by("run", F.struct(-F.col("x"), "run")).alias("largest x"))
    return out.unpivot(["scenario"], ["least x", "least y", "largest x"], "kind", "run")


@query("""WITH t AS (SELECT p_brand AS scenario, p_size AS size, median(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END) AS directed, median(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END) AS undirected FROM part GROUP BY ALL)
SELECT scenario, round(median((directed - undirected) / undirected * 100), 6) AS median_uplift, round(avg((directed - undirected) / undirected * 100), 6) AS mean_uplift FROM t GROUP BY scenario""")
def uplift_pivot(spark, folder):
    part = tables.table(spark, folder, "part").select(F.col("p_brand").alias("scenario"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 2 == 0, "directed").otherwise("undirected").alias("kind"), "p_retailprice")
    wide = part.groupBy("scenario", "size").pivot("kind", ["directed", "undirected"]).agg(F.median("p_retailprice"))
    up = (F.col("directed") - F.col("undirected")) / F.col("undirected") * 100
    return wide.groupBy("scenario").agg(r6(F.median(up)).alias("median_uplift"), r6(F.avg(up)).alias("mean_uplift"))


@query(f"""WITH {_C}, g AS (SELECT cov, avg(value) AS g FROM covariates GROUP BY cov), o AS (SELECT community, cov, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM covariates GROUP BY ALL),
s AS (SELECT cov, sum(n * (m - g) ** 2) AS ssb, sum((n - 1) * v) AS ssw, count(*) AS k, sum(n) AS n FROM o JOIN g USING (cov) GROUP BY cov)
SELECT CAST(cov AS INTEGER) AS cov, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2 FROM s""")
def anova_f(spark, folder):
    rows = tables.covariates(spark, folder)
    g = rows.groupBy("cov").agg(F.avg("value").alias("g"))
    o = rows.groupBy("community", "cov").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    s = o.join(g, "cov").groupBy("cov").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("ssb"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"), F.count("*").alias("k"), F.sum("n").alias("n"))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return s.select("cov", r6(f).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))
