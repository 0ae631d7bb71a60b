"""Views of the example tables as surveillance samples, mobility flows and attributed graphs.

Each view has an equivalent in SQL, which the queries' own SQL builds on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import epi_week, epi_year


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """nationkey, location, region: 25 rows, whatever the scale."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("location"), F.col("r_name").alias("region")
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """location, region, sample_date, value: an order is a sample of its customer's nation."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(places(spark, folder)), F.col("c_nationkey") == F.col("nationkey"))
        .select("location", "region", F.to_date("o_orderdate").alias("sample_date"), F.ln("o_totalprice").alias("value"))
    )


SAMPLES = """
samples AS (
  SELECT n_name AS location, r_name AS region, CAST(o_orderdate AS DATE) AS sample_date, ln(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def weekly(spark: SparkSession, folder: str) -> DataFrame:
    """location, region, year, week, mean_value, n_obs by epidemiological week."""
    day = F.col("sample_date")
    return (
        samples(spark, folder)
        .groupBy("location", "region", epi_year(day).alias("year"), epi_week(day).alias("week"))
        .agg(F.avg("value").alias("mean_value"), F.count("*").alias("n_obs"))
    )


WEEKLY = (
    SAMPLES
    + """,
dated AS (SELECT *, sample_date + CAST(3 - dayofweek(sample_date) AS INTEGER) AS mid FROM samples),
weekly AS (
  SELECT location, region, CAST(year(mid) AS INTEGER) AS year, CAST((dayofyear(mid) - 1) // 7 + 1 AS INTEGER) AS week,
         avg(value) AS mean_value, count(*) AS n_obs
  FROM dated GROUP BY ALL)"""
)


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, year, week, weight: line items go from the customer's nation to the supplier's."""
    line, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    day = F.to_date("l_shipdate")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), epi_year(day).alias("year"), epi_week(day).alias("week"))
        .agg(F.count("*").alias("weight"))
    )


FLOWS = """
shipped AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, CAST(l_shipdate AS DATE) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
flows AS (
  SELECT src, dst, CAST(year(d + CAST(3 - dayofweek(d) AS INTEGER)) AS INTEGER) AS year,
         CAST((dayofyear(d + CAST(3 - dayofweek(d) AS INTEGER)) - 1) // 7 + 1 AS INTEGER) AS week, count(*) AS weight
  FROM shipped GROUP BY ALL)"""


def network(spark: SparkSession, folder: str, share: float = 0.6) -> DataFrame:
    """src, dst, weight: total flows between different nations above the given quantile of them."""
    total = flows(spark, folder).filter("src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    cut = total.agg(F.percentile("weight", F.lit(share)).alias("cut"))
    return total.crossJoin(F.broadcast(cut)).filter("weight > cut").select("src", "dst", "weight")


NETWORK = (
    FLOWS
    + """,
total AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM flows WHERE src <> dst GROUP BY ALL),
edges AS (SELECT src, dst, weight FROM total WHERE weight > (SELECT quantile_cont(weight, 0.6) FROM total))"""
)


def memberships(spark: SparkSession, folder: str) -> DataFrame:
    """half, node, community: users belong to the event types that they have more events of in a half month than the mean user."""
    events = table(spark, folder, "events")
    half = F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2)
    n = events.groupBy(half.alias("half"), F.col("user_id").alias("node"), F.col("event_type").alias("community")).agg(F.count("*").alias("n"))
    mean = n.groupBy("half", "community").agg(F.avg("n").alias("mean"))
    return n.join(mean, ["half", "community"]).filter("n > mean").select("half", "node", "community")


MEMBERSHIPS = """
counted AS (SELECT CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS half, user_id AS node, event_type AS community, count(*) AS n FROM events GROUP BY ALL),
memberships AS (SELECT half, node, community FROM (SELECT *, avg(n) OVER (PARTITION BY half, community) AS mean FROM counted) WHERE n > mean)"""


def covariates(spark: SparkSession, folder: str, dims: int = 4) -> DataFrame:
    """node, community, cov, value: the first entries of the embeddings, by label."""
    rows = table(spark, folder, "embeddings")
    parts = F.slice(F.col("embedding").cast("array<double>"), 1, dims)
    return rows.select(F.col("vec_id").alias("node"), F.col("label").alias("community"), F.posexplode(parts).alias("cov", "value"))


COVARIATES = """
covariates AS (
  SELECT vec_id AS node, label AS community, i - 1 AS cov, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(generate_series(1, 4)) AS i))"""
