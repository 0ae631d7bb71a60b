"""Preparation of weekly panels: missing values, gaps, ranks, chunks, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the columns (in any column if none is named)."""
    return rows.dropna(subset=list(columns) or None)


def grid(panel: DataFrame, keys: list[str], times: list[str]) -> DataFrame:
    """Every key with every time that the panel has; what is missing is null."""
    every = panel.select(*keys).distinct().crossJoin(panel.select(*times).distinct())
    return every.join(panel, keys + times, "left")


def missing_share(full: DataFrame, key: str, value: str) -> DataFrame:
    return full.groupBy(key).agg(F.avg(F.col(value).isNull().cast("double")).alias("missing_share"))


def drop_sparse(full: DataFrame, key: str, value: str, least_missing: float) -> DataFrame:
    """Keys whose share of missing values is below the limit."""
    keep = missing_share(full, key, value).filter(F.col("missing_share") < least_missing).select(key)
    return full.join(keep, key, "left_semi")


def longest_gap(full: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Length of the longest run of missing values of each key; 0 without any."""
    by_key = Window.partitionBy(key).orderBy(*order)
    by_state = Window.partitionBy(key, "gap").orderBy(*order)
    runs = full.withColumn("gap", F.col(value).isNull()).withColumn("run", F.row_number().over(by_key) - F.row_number().over(by_state))
    lengths = runs.groupBy(key, "run").agg(F.sum(F.col("gap").cast("long")).alias("n"))
    return lengths.groupBy(key).agg(F.max("n").alias("longest_gap"))


def flag_first(rows: DataFrame, by: list[str], order: list[Column], yes: str = "max", no: str = "not max", name: str = "flag") -> DataFrame:
    """Marks the first row of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, F.when(rank == 1, yes).otherwise(no))


def group_top(rows: DataFrame, by: list[str], value: str, ties: bool = True, largest: bool = True, tie_break: list[str] | None = None) -> DataFrame:
    """Rows with the largest (smallest) value of their group, all of equal ones or the first."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    window = Window.partitionBy(*by).orderBy(order, *([] if ties else tie_break or []))
    return rows.withColumn("_rank", (F.rank() if ties else F.row_number()).over(window)).filter("_rank = 1").drop("_rank")


def label_ends(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """Adds dense ranks from both ends, and ``top`` or ``bottom`` for ranks up to k."""
    w = Window.partitionBy(*by)
    high, low = F.dense_rank().over(w.orderBy(F.col(value).desc())), F.dense_rank().over(w.orderBy(F.col(value).asc()))
    rows = rows.withColumn("rank_high", high).withColumn("rank_low", low)
    return rows.withColumn("end", F.when(F.col("rank_high") <= k, "top").when(F.col("rank_low") <= k, "bottom"))


def above_group_quantile(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Rows above their group's exact quantile (linear between values)."""
    cuts = rows.groupBy(*by).agg(F.percentile(value, F.lit(share)).alias("cut"))
    return rows.join(cuts, by).filter(F.col(value) > F.col("cut"))


def chunks(rows: DataFrame, key: str, order: list[str], label: str, size: int) -> DataFrame:
    """Adds chunk, the number of each row's run of ``size`` rows, and its first and last label."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("place", place).withColumn("chunk", F.ceil(F.col("place") / size).cast("int"))
    own = Window.partitionBy(key, "chunk")
    name = F.concat_ws("-", F.min_by(label, "place").over(own), F.max_by(label, "place").over(own))
    return rows.withColumn("chunk_label", name)


def segments(breaks: DataFrame, key: str, at: str) -> DataFrame:
    """Break points as [start, end) of consecutive ones; the last has no end and goes."""
    end = F.lead(at, 1).over(Window.partitionBy(key).orderBy(at))
    return breaks.select(key, F.col(at).alias("start"), end.alias("end")).filter(F.col("end").isNotNull())


def differences(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """First and second differences and the difference of logarithms."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("diff1", F.col(value) - F.lag(value, 1).over(w))
    rows = rows.withColumn("diff2", F.col("diff1") - F.lag("diff1", 1).over(w))
    return rows.withColumn("log_diff", F.ln(value) - F.ln(F.lag(value, 1).over(w)))


def lags(rows: DataFrame, key: str, order: list[str], value: str, depth: int, shift_up: bool = False) -> DataFrame:
    """Adds lag1 to lag<depth>; ``shift_up`` takes following values in their place."""
    w = Window.partitionBy(key).orderBy(*order)
    move = F.lead if shift_up else F.lag
    return rows.withColumns({f"lag{k}": move(value, k).over(w) for k in range(1, depth + 1)})


def first_match(rows: DataFrame, lookup: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Left join with the first row only of each key of the lookup."""
    first = lookup.groupBy(key).agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in columns))
    return rows.join(first, key, "left")


def long_to_wide(rows: DataFrame, keys: list[str], name: str, value: str, names: list) -> DataFrame:
    return rows.groupBy(*keys).pivot(name, names).agg(F.first(value))


def wide_to_long(rows: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return rows.unpivot(keys, columns, name, value)


def mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value, of equally frequent ones the smallest."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), value)
    return n.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select(*by, F.col(value).alias("mode"), "n")


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str, share: float = 0.1) -> DataFrame:
    """Pairs of names within an edit distance of ``ceil(share * length of a)``, upper and lower case alike.

    Every pair is compared, so both sides should be lists of names, not tables of rows.
    """
    near = F.levenshtein(F.lower(a), F.lower(b)) <= F.ceil(F.length(a) * share)
    return left.join(right, near)


def block_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, sd, var, min, max of each group."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"),
        F.var_samp(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def five_numbers(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    names = ("low", "q1", "median", "q3", "high")
    return rows.groupBy(*by).agg(q.alias("q")).select(*by, *(F.col("q")[i].alias(n) for i, n in enumerate(names)))
