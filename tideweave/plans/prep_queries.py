"""Weekly panels, ranks, reshaping, joins and roll-ups over the example tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, numbers
from ..functions.dates import week_since
from ..operators import prep
from ..sources import readers, tables
from .registry import query

R6 = "round({}, 6)".format
_W = tables.WEEKLY


def r6(c):
    return F.round(c, 6)


@query(f"""WITH {_W} SELECT region, year, week, round(avg(mean_value), 6) AS mean_value, CAST(sum(n_obs) AS BIGINT) AS n_obs
FROM weekly WHERE region IS NOT NULL GROUP BY ALL""")
def weekly_region_mean(spark, folder):
    rows = prep.complete_rows(tables.weekly(spark, folder), "region", "mean_value")
    return rows.groupBy("region", "year", "week").agg(r6(F.avg("mean_value")).alias("mean_value"), F.sum("n_obs").alias("n_obs"))


_FIVE = tuple(f"NATION_{k}" for k in (0, 5, 10, 15, 20))


@query(f"""WITH {_W} SELECT year, week, {', '.join(f"round(max(CASE WHEN location = '{n}' THEN mean_value END), 6) AS {n.lower()}" for n in _FIVE)}
FROM weekly GROUP BY year, week""")
def weekly_location_panel_pivot(spark, folder):
    rows = tables.weekly(spark, folder).withColumn("v", r6(F.col("mean_value")))
    wide = prep.long_to_wide(rows, ["year", "week"], "location", "v", list(_FIVE))
    return wide.select("year", "week", *(F.col(n).alias(n.lower()) for n in _FIVE))


@query(f"""WITH {_W}, t AS (SELECT year, week, location, v FROM (SELECT *, round(mean_value, 6) AS v FROM weekly))
SELECT year, week, location, v, CASE WHEN row_number() OVER (PARTITION BY year, week ORDER BY v DESC, location) = 1 THEN 'max' ELSE 'not max' END AS flag FROM t""")
def week_max_flag(spark, folder):
    rows = tables.weekly(spark, folder).select("year", "week", "location", r6("mean_value").alias("v"))
    return prep.flag_first(rows, ["year", "week"], [F.col("v").desc(), F.col("location")])


_GRID = f"""WITH {_W}, full_ AS (
  SELECT l.location, t.year, t.week, w.mean_value FROM (SELECT DISTINCT location FROM weekly) l CROSS JOIN (SELECT DISTINCT year, week FROM weekly) t
  LEFT JOIN weekly w ON w.location = l.location AND w.year = t.year AND w.week = t.week)"""


def _full(spark, folder):
    return prep.grid(tables.weekly(spark, folder).select("location", "year", "week", "mean_value"), ["location"], ["year", "week"])


@query(f"""{_GRID}, s AS (SELECT location, avg(CASE WHEN mean_value IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM full_ GROUP BY 1)
SELECT location, count(*) AS weeks, round(avg(mean_value), 6) AS mean_value FROM full_ SEMI JOIN (SELECT * FROM s WHERE m < 0.4) k USING (location) GROUP BY location""")
def missing_share_filter(spark, folder):
    rows = prep.drop_sparse(_full(spark, folder), "location", "mean_value", 0.4)
    return rows.groupBy("location").agg(F.count("*").alias("weeks"), r6(F.avg("mean_value")).alias("mean_value"))


@query(f"""{_GRID}, r AS (SELECT *, mean_value IS NULL AS gap, row_number() OVER (PARTITION BY location ORDER BY year, week)
  - row_number() OVER (PARTITION BY location, mean_value IS NULL ORDER BY year, week) AS run FROM full_),
n AS (SELECT location, run, sum(CASE WHEN gap THEN 1 ELSE 0 END) AS n FROM r GROUP BY location, run)
SELECT location, CAST(max(n) AS BIGINT) AS longest_gap FROM n GROUP BY location""")
def longest_gap(spark, folder):
    return prep.longest_gap(_full(spark, folder), "location", ["year", "week"], "mean_value")


@query(f"""WITH {_W}, t AS (SELECT year, location, round(avg(mean_value), 6) AS v FROM weekly GROUP BY ALL),
r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY year ORDER BY v DESC) AS INTEGER) AS rank_high, CAST(dense_rank() OVER (PARTITION BY year ORDER BY v) AS INTEGER) AS rank_low FROM t)
SELECT *, CASE WHEN rank_high <= 3 THEN 'top' WHEN rank_low <= 3 THEN 'bottom' END AS "end" FROM r""")
def top_bottom_rank(spark, folder):
    rows = tables.weekly(spark, folder).groupBy("year", "location").agg(r6(F.avg("mean_value")).alias("v"))
    return prep.label_ends(rows, ["year"], "v", 3)


@query(f"""WITH {_W}, t AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY year, week) AS place, year || '.' || week AS wk FROM weekly),
c AS (SELECT *, CAST(ceil(place / 25.0) AS INTEGER) AS chunk FROM t)
SELECT location, chunk, min_by(wk, place) || '-' || max_by(wk, place) AS chunk_label, count(*) AS weeks, round(avg(mean_value), 6) AS mean_value FROM c GROUP BY location, chunk""")
def chunk_means(spark, folder):
    rows = tables.weekly(spark, folder).withColumn("wk", F.concat_ws(".", F.col("year").cast("string"), F.col("week").cast("string")))
    rows = prep.chunks(rows, "location", ["year", "week"], "wk", 25)
    return rows.groupBy("location", "chunk", "chunk_label").agg(F.count("*").alias("weeks"), r6(F.avg("mean_value")).alias("mean_value"))


@query(f"""WITH {_W}, t AS (SELECT location, year, week, round(mean_value, 6) AS v FROM weekly),
d AS (SELECT *, v - lag(v) OVER w AS d1, ln(v) - ln(lag(v) OVER w) AS ld FROM t WINDOW w AS (PARTITION BY location ORDER BY year, week))
SELECT location, year, week, v, round(d1, 6) AS diff1, round(d1 - lag(d1) OVER (PARTITION BY location ORDER BY year, week), 6) AS diff2, round(ld, 6) AS log_diff FROM d""")
def series_differences(spark, folder):
    rows = tables.weekly(spark, folder).select("location", "year", "week", r6("mean_value").alias("v"))
    rows = prep.differences(rows, "location", ["year", "week"], "v")
    return rows.withColumns({c: r6(c) for c in ("diff1", "diff2", "log_diff")})


def _lag_sql(move):
    return f"""WITH {_W}, t AS (SELECT location, year, week, round(mean_value, 6) AS v FROM weekly)
SELECT *, {move}(v, 1) OVER w AS lag1, {move}(v, 2) OVER w AS lag2 FROM t WINDOW w AS (PARTITION BY location ORDER BY year, week)"""


@query(_lag_sql("lag"))
def lag_design(spark, folder):
    rows = tables.weekly(spark, folder).select("location", "year", "week", r6("mean_value").alias("v"))
    return prep.lags(rows, "location", ["year", "week"], "v", 2)


@query(_lag_sql("lead"))
def lead_design(spark, folder):
    rows = tables.weekly(spark, folder).select("location", "year", "week", r6("mean_value").alias("v"))
    return prep.lags(rows, "location", ["year", "week"], "v", 2, shift_up=True)


@query(f"""WITH {_W}, b AS (SELECT DISTINCT location, year * 100 + week AS pos FROM weekly WHERE week IN (1, 14, 27, 40)),
s AS (SELECT location, pos AS start, lead(pos) OVER (PARTITION BY location ORDER BY pos) AS "end" FROM b)
SELECT location, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM s WHERE "end" IS NOT NULL""")
def segment_table(spark, folder):
    rows = tables.weekly(spark, folder).filter(F.col("week").isin(1, 14, 27, 40)).select("location", (F.col("year") * 100 + F.col("week")).alias("at")).distinct()
    return prep.segments(rows, "location", "at")


@query(f"""WITH {tables.SAMPLES} SELECT region, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
round(stddev_samp(value), 6) AS sd, round(var_samp(value), 6) AS var, round(min(value), 6) AS min, round(max(value), 6) AS max FROM samples GROUP BY region""")
def block_statistics(spark, folder):
    rows = prep.block_stats(tables.samples(spark, folder), ["region"], "value")
    return rows.select("region", "n", *(r6(c).alias(c) for c in ("mean", "median", "sd", "var", "min", "max")))


@query(f"""WITH {tables.SAMPLES} SELECT location, {', '.join(f'round(quantile_cont(value, {q}), 6) AS {n}' for q, n in ((0, 'low'), (0.25, 'q1'), (0.5, 'median'), (0.75, 'q3'), (1, 'high')))}
FROM samples GROUP BY location""")
def five_number_summary(spark, folder):
    rows = prep.five_numbers(tables.samples(spark, folder), ["location"], "value")
    return rows.select("location", *(r6(c).alias(c) for c in rows.columns[1:]))


@query(f"""WITH {tables.SAMPLES} , f AS (SELECT min(sample_date) AS d0 FROM samples),
t AS (SELECT location, CAST(date_diff('day', d0, sample_date) // 7 + 1 AS INTEGER) AS weekno, sample_date, value FROM samples, f)
SELECT weekno, location, round(avg(value), 6) AS mean_value, CAST(min(sample_date) AS VARCHAR) AS first_date, count(*) AS n FROM t GROUP BY ALL""")
def week_number_means(spark, folder):
    """Weeks since the first sample; of the other columns the first by date."""
    rows = tables.samples(spark, folder)
    first = rows.agg(F.min("sample_date").alias("d0"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("weekno", week_since(F.col("sample_date"), F.col("d0")))
    return rows.groupBy("weekno", "location").agg(r6(F.avg("value")).alias("mean_value"), F.min_by("sample_date", "sample_date").cast("string").alias("first_date"), F.count("*").alias("n"))


@query(f"""WITH {_W}, t AS (SELECT year * 100 + week AS yw, mean_value FROM weekly)
SELECT CASE WHEN yw BETWEEN 199501 AND 199626 THEN 'wave1' WHEN yw BETWEEN 199640 AND 199813 THEN 'wave2' WHEN yw >= 199901 THEN 'wave3' END AS wave,
count(*) AS n, round(avg(mean_value), 6) AS mean_value FROM t GROUP BY ALL""")
def wave_buckets(spark, folder):
    yw = F.col("year") * 100 + F.col("week")
    wave = F.when(yw.between(199501, 199626), "wave1").when(yw.between(199640, 199813), "wave2").when(yw >= 199901, "wave3")
    return tables.weekly(spark, folder).groupBy(wave.alias("wave")).agg(F.count("*").alias("n"), r6(F.avg("mean_value")).alias("mean_value"))


@query("""SELECT l_orderkey, l_linenumber, round(list_sum([l_quantity, l_discount, l_tax]), 6) AS row_sum, round(list_avg([l_quantity, l_discount, l_tax]), 6) AS row_mean,
least(l_quantity, l_discount, l_tax) AS row_min, greatest(l_quantity, l_discount, l_tax) AS row_max FROM lineitem""")
def row_statistics(spark, folder):
    parts = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    stats = (numbers.row_stat(parts, s) for s in ("sum", "mean", "min", "max"))
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", *((r6(c) if s in ("sum", "mean") else c).alias(f"row_{s}") for s, c in zip(("sum", "mean", "min", "max"), stats))
    )


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY p_brand) AS share FROM n)
SELECT p_type, round(median(share), 6) AS median_share, count(*) AS brands FROM s GROUP BY p_type""")
def share_of_parent(spark, folder):
    n = tables.table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("p_brand"))
    return n.withColumn("share", share).groupBy("p_type").agg(r6(F.median("share")).alias("median_share"), F.count("*").alias("brands"))


@query("""SELECT p_brand, round(corr(p_size, p_retailprice), 6) AS r, count(*) AS n FROM part GROUP BY p_brand""")
def grouped_correlation(spark, folder):
    return tables.table(spark, folder, "part").groupBy("p_brand").agg(r6(F.corr("p_size", "p_retailprice")).alias("r"), F.count("*").alias("n"))


@query(f"""WITH {tables.COVARIATES}, p AS (SELECT a.cov AS x, b.cov AS y, a.value AS vx, b.value AS vy FROM covariates a JOIN covariates b ON a.node = b.node)
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(corr(vx, vy), 6) AS r, count(*) AS n FROM p WHERE x < y GROUP BY x, y""")
def correlation_matrix(spark, folder):
    rows = tables.covariates(spark, folder)
    a, b = (rows.select("node", F.col("cov").alias(c), F.col("value").alias(f"v{c}")) for c in "xy")
    return a.join(b, "node").filter("x < y").groupBy("x", "y").agg(r6(F.corr("vx", "vy")).alias("r"), F.count("*").alias("n"))


@query(f"""WITH {_W}, l AS (SELECT location, year, avg(mean_value) AS m FROM weekly GROUP BY ALL)
SELECT year, round(avg(m), 6) AS mean_of_means, round(stddev_samp(m), 6) AS sd_of_means FROM l GROUP BY year""")
def two_level_mean(spark, folder):
    low = tables.weekly(spark, folder).groupBy("location", "year").agg(F.avg("mean_value").alias("m"))
    return low.groupBy("year").agg(r6(F.avg("m")).alias("mean_of_means"), r6(F.stddev_samp("m")).alias("sd_of_means"))


@query("""SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ', ') AS types, CAST(count(DISTINCT p_type) AS BIGINT) AS n FROM part GROUP BY p_brand""")
def collapsed_levels(spark, folder):
    types = F.array_sort(F.collect_set("p_type"))
    return tables.table(spark, folder, "part").groupBy("p_brand").agg(F.array_join(types, ", ").alias("types"), F.size(types).cast("long").alias("n"))


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM n) WHERE k = 1""")
def modal_level(spark, folder):
    return prep.mode(tables.table(spark, folder, "part"), ["p_brand"], "p_type")


@query("""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY l_returnflag""")
def conditional_share(spark, folder):
    flag = (F.col("l_discount") > 0.05).cast("double")
    return tables.table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg(flag)).alias("share"))


@query("""WITH c AS (SELECT o_custkey AS custkey, min_by(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM orders GROUP BY 1)
SELECT c_custkey AS custkey, c_mktsegment AS segment, first_priority FROM customer LEFT JOIN c ON c_custkey = custkey""")
def first_lookup_match(spark, folder):
    customer = tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    orders = tables.table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("first_priority"), "o_orderdate", "o_orderkey")
    return prep.first_match(customer, orders, "custkey", ["o_orderdate", "o_orderkey"], ["first_priority"])


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, unnest(map_keys(m)) AS key, CAST(unnest(map_values(m)) AS INTEGER) AS n
FROM (SELECT event_id, CAST(CAST(props AS JSON) AS MAP(VARCHAR, INTEGER)) AS m FROM events)""")
def json_map_counts(spark, folder):
    events = tables.table(spark, folder, "events")
    return events.select("event_id", F.explode(readers.counts_of_json(F.col("props"))).alias("key", "n"))


@query("""SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1, nation n2 WHERE n1.n_nationkey <> n2.n_nationkey""")
def ordered_pairs(spark, folder):
    nation = tables.table(spark, folder, "nation")  # 25 rows
    a, b = (nation.select(F.col("n_name").alias(c)) for c in "ab")
    return a.crossJoin(F.broadcast(b)).filter("a != b")


@query("""SELECT a.n_regionkey AS regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def pairs_within_group(spark, folder):
    nation = tables.table(spark, folder, "nation")
    a = nation.select(F.col("n_regionkey").alias("regionkey"), F.col("n_nationkey").alias("x"), F.col("n_name").alias("a"))
    b = nation.select(F.col("n_regionkey").alias("regionkey"), F.col("n_nationkey").alias("y"), F.col("n_name").alias("b"))
    return a.join(b, "regionkey").filter("x < y").select("regionkey", "a", "b")


_ALPHA, _K, _PENALTY = (0.0005, 0.001, 0.01), (2, 3, 4, 5, 6), ("LASSO", "Ridge", "ElasticNet")


@query(f"""SELECT a AS alpha, k AS nc, p AS penalty, l AS lambda FROM (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in _ALPHA)}]) AS a),
(SELECT CAST(unnest({list(_K)}) AS INTEGER) AS k), (SELECT unnest({list(_PENALTY)}) AS p), (SELECT CAST(unnest([0.001, 0.01, 0.1]) AS DOUBLE) AS l)""")
def parameter_grid(spark, folder):
    frame = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    out = frame("alpha", _ALPHA, "double")
    for f in (frame("nc", _K, "int"), frame("penalty", _PENALTY, "string"), frame("lambda", (0.001, 0.01, 0.1), "double")):
        out = out.crossJoin(F.broadcast(f))
    return out


@query("""SELECT a.n_name AS name, b.n_name AS match FROM nation a, nation b
WHERE a.n_nationkey <> b.n_nationkey AND levenshtein(lower(a.n_name), lower(b.n_name)) <= ceil(length(a.n_name) * 0.1)""")
def fuzzy_name_join(spark, folder):
    nation = tables.table(spark, folder, "nation")
    a = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("x"))
    b = nation.select(F.col("n_name").alias("match"), F.col("n_nationkey").alias("y"))
    return prep.fuzzy_join(a, b, "name", "match", 0.1).filter("x != y").select("name", "match")


@query("""WITH u AS (SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier)
SELECT kind, nation, count(*) AS n, round(sum(bal), 4) AS total FROM u GROUP BY ALL""")
def appended_balances(spark, folder):
    c = tables.table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    s = tables.table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("kind", "nation").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 4).alias("total"))


@query("""SELECT 'only customers' AS side, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)""")
def set_operations(spark, folder):
    c = tables.table(spark, folder, "customer").select(F.col("c_nationkey").alias("k"))
    s = tables.table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).select(F.lit("only customers").alias("side"), "k").union(c.intersect(s).select(F.lit("both"), "k"))


@query("""WITH t AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT flag, status, name, value FROM (SELECT flag, status, CAST(n AS DOUBLE) AS n, CAST(q AS DOUBLE) AS q FROM t) UNPIVOT (value FOR name IN (n, q))""")
def wide_to_long(spark, folder):
    rows = tables.table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    rows = rows.agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    return prep.wide_to_long(rows, ["flag", "status"], ["n", "q"])


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""SELECT user_id, {', '.join(f"CAST(max(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS INTEGER) AS {t}" for t in _TYPES)} FROM events GROUP BY user_id""")
def one_hot_levels(spark, folder):
    return readers.one_hot(tables.table(spark, folder, "events"), "user_id", "event_type", list(_TYPES))


@query("""WITH n AS (SELECT DISTINCT c_name AS name FROM customer UNION SELECT DISTINCT s_name FROM supplier)
SELECT name, row_number() OVER (ORDER BY name) AS node_id FROM n""")
def numbered_nodes(spark, folder):
    c, s = tables.table(spark, folder, "customer"), tables.table(spark, folder, "supplier")
    names_ = c.select(F.col("c_name").alias("src"), F.col("c_name").alias("dst")).union(s.select("s_name", "s_name"))
    return readers.numbered_nodes(names_)


@query("""SELECT c_custkey, CASE WHEN k <= 26 THEN chr(CAST(96 + k AS INTEGER)) ELSE chr(CAST(96 + (k - 1) // 26 AS INTEGER)) || chr(CAST(97 + (k - 1) % 26 AS INTEGER)) END AS letters,
lpad(CAST(c_custkey AS VARCHAR), 12, '0')[1:2] AS state, lpad(CAST(c_custkey AS VARCHAR), 12, '0')[6:11] AS tract, regexp_replace(c_name, '[^A-Za-z0-9._]', '.', 'g') AS clean
FROM (SELECT *, c_custkey % 700 + 1 AS k FROM customer)""")
def names_and_codes(spark, folder):
    code = F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    return tables.table(spark, folder, "customer").select(
        "c_custkey", names.letters_of(F.col("c_custkey") % 700 + 1).alias("letters"), names.census_part(code, "state").alias("state"),
        names.census_part(code, "tract").alias("tract"), names.syntactic(F.col("c_name")).alias("clean"),
    )


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.8) AS cut FROM orders)
SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders, q WHERE o_totalprice < cut GROUP BY 1""")
def below_global_quantile(spark, folder):
    orders = tables.table(spark, folder, "orders")
    cut = orders.agg(F.percentile("o_totalprice", F.lit(0.8)).alias("cut"))
    return orders.crossJoin(F.broadcast(cut)).filter("o_totalprice < cut").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS k FROM orders) WHERE k = 1""")
def group_maximum(spark, folder):
    return prep.group_top(tables.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice")


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / sd, 6) AS z, round((l_extendedprice - lo) / (hi - lo), 6) AS scaled,
round(sign((l_extendedprice - m) / sd) * greatest(abs((l_extendedprice - m) / sd) - 0.5, 0), 6) + 0 AS shrunk FROM lineitem, s""")
def scaled_values(spark, folder):
    """z-scores, min-max scaling and soft thresholding; the statistics are one row."""
    line = tables.table(spark, folder, "lineitem")
    p = F.col("l_extendedprice")
    one = line.agg(F.avg(p).alias("m"), F.stddev_samp(p).alias("sd"), F.min(p).alias("lo"), F.max(p).alias("hi"))
    rows = line.crossJoin(F.broadcast(one)).withColumn("z", (p - F.col("m")) / F.col("sd"))
    return rows.select("l_orderkey", "l_linenumber", r6("z").alias("z"), r6((p - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("scaled"), (r6(numbers.soft_threshold(F.col("z"), F.lit(0.5))) + 0.0).alias("shrunk"))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1),
f AS (SELECT coalesce(a.k, b.k) AS k, customers, suppliers FROM a FULL JOIN b ON a.k = b.k)
SELECT n_nationkey AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM nation LEFT JOIN f ON n_nationkey = f.k""")
def full_join_on_grid(spark, folder):
    a = tables.table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = tables.table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    nation = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"))
    return nation.join(a.join(b, "k", "full"), "k", "left").fillna(0)
