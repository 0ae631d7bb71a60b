"""Weekly means over a stream of samples, with late ones taken in up to a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows of seven days begin on Sundays: 1970-01-01 was a Thursday.
SUNDAY = "3 days"


def weekly_means(samples: DataFrame, time: str, by: list[str], value: str, delay: str = "7 days") -> DataFrame:
    """week_start, the keys, mean_value, n_obs of a stream or a table, by epidemiological weeks."""
    stamp = F.col(time).cast("timestamp")
    rows = samples.withColumn("_time", stamp).filter(F.col("_time").isNotNull())
    if samples.isStreaming:
        rows = rows.withWatermark("_time", delay)
    out = rows.groupBy(F.window("_time", "7 days", "7 days", SUNDAY).alias("w"), *by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_obs"))
    return out.select(F.to_date("w.start").alias("week_start"), *by, "mean_value", "n_obs")


def to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is available now and return its table; for small results."""
    run = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)
