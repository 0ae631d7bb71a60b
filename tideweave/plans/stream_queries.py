"""Streams over the example tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables
from ..streaming.weekly import to_memory, weekly_means
from .registry import query

_SQL = """SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS VARCHAR) AS week_start, event_type, round(avg(value), 6) AS mean_value, CAST(count(value) AS BIGINT) AS n_obs
FROM (SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS d, * FROM events) GROUP BY CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER), event_type"""


def _shown(rows):
    return rows.select(F.col("week_start").cast("string").alias("week_start"), "event_type", F.round("mean_value", 6).alias("mean_value"), "n_obs")


@query(_SQL)
def weekly_event_means(spark, folder):
    return _shown(weekly_means(tables.table(spark, folder, "events"), "ts", ["event_type"], "value"))


@query(_SQL)
def streamed_event_means(spark, folder):
    """The same through Structured Streaming; the result has a row per week and type."""
    events = tables.table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*")
    return _shown(to_memory(weekly_means(stream, "ts", ["event_type"], "value"), f"weekly_{uuid.uuid4().hex}"))
