"""Readers of the text formats that surveillance and network data come in; schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.paths import settled


def csv(spark: SparkSession, path: str, schema: str, where: Column | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """A CSV file or folder, plain or gzipped; rows and columns that are not asked for are not kept.

    A gzipped file is one task's input; spread it with ``repartition`` before heavy work.
    """
    rows = spark.read.options(header=True, **options).schema(schema).csv(path)
    if where is not None:
        rows = rows.filter(where)
    return rows.select(*columns) if columns else rows


def delimited_utf16(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated UTF-16, every column as text."""
    return csv(spark, path, ", ".join(f"`{c}` string" for c in columns), sep="\t", encoding="UTF-16", multiLine=True)


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src and dst of lines with two fields between white space."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(part[0].alias("src"), part[1].alias("dst")).filter("src != '' AND dst IS NOT NULL")


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of a 0/1 matrix with a row of fields a line; nodes are numbered from 1.

    Lines are numbered by their place in the file, so the file must be one split.
    """
    rows = spark.read.text(path, wholetext=True)
    lines = rows.select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("i", "line"))
    cells = lines.select((F.col("i") + 1).alias("src"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "x"))
    return cells.filter(F.col("x").try_cast("double") != 0).select("src", (F.col("j") + 1).alias("dst"))


def circles(rows: DataFrame, column: str = "value", more_than: int = 4) -> DataFrame:
    """circle, node of ragged lines: a name and its members between tabs; small circles go."""
    part = F.split(F.trim(column), r"\t+")
    long = rows.select(part[0].alias("circle"), F.explode(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0)))).alias("node"))
    large = long.groupBy("circle").agg(F.count("*").alias("n")).filter(F.col("n") > more_than).select("circle")
    return long.join(large, "circle", "left_semi")


def one_hot(rows: DataFrame, key: str, level: str, levels: list) -> DataFrame:
    """One row per key with a 0/1 column for each level."""
    return rows.groupBy(key).pivot(level, levels).agg(F.max(F.lit(1))).fillna(0)


def numbered_nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """name, node_id: names of all endpoints and dense numbers from 1 in their order.

    Names are sorted into ranges, counted range by range, and numbered with what lies before their
    range; only a row per range is summed up in one place.
    """
    names = edges.select(F.col(src).alias("name")).union(edges.select(F.col(dst))).filter("name IS NOT NULL").distinct()
    part = F.spark_partition_id()
    own = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    ranges = settled(names.orderBy("name").select("name", part.alias("range"), own.alias("own")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    return ranges.join(counted, "range").select("name", (F.col("own") + F.col("before") + 1).alias("node_id"))


def runs_in(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Files of experiment runs with the number in each file's name as run_id."""
    name = F.regexp_extract(F.input_file_name(), r"(\d+)[^/0-9]*$", 1).try_cast("long")
    return spark.read.schema(schema).parquet(pattern).withColumn("run_id", name)


def counts_of_json(cell: Column) -> Column:
    """A map of counts from a JSON object in a cell."""
    return F.from_json(cell, "map<string,int>")


def gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, dst, weight) of a GML file without nested values in them."""
    text = spark.read.text(path, wholetext=True)
    block = lambda name: F.explode(F.regexp_extract_all("value", F.lit(name + r"\s*\[([^\[\]]*)\]"), F.lit(1)))
    number = lambda c, key: F.regexp_extract(c, rf"(?:^|\s){key}\s+(-?[\d.]+)", 1)
    nodes = text.select(block("node").alias("b")).select(number("b", "id").cast("long").alias("id"), F.nullif(F.regexp_extract("b", r'label\s+"([^"]*)"', 1), F.lit("")).alias("label"))
    edges = text.select(block("edge").alias("b")).select(number("b", "source").cast("long").alias("src"), number("b", "target").cast("long").alias("dst"), number("b", "(?:weight|value)").try_cast("double").alias("weight"))
    return nodes, edges
