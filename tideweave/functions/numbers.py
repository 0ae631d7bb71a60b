"""Numeric expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def logit(p: Column) -> Column:
    return F.ln(F.try_divide(p, 1 - p))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log1pexp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def soft_threshold(x: Column, size: Column) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - size, F.lit(0.0))


def min_max(x: Column, over: WindowSpec) -> Column:
    """x between its least (0) and greatest (1) value in the window; a constant stays as it is."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high > low, (x - low) / (high - low)).otherwise(x)


def z_score(x: Column, over: WindowSpec) -> Column:
    return F.try_divide(x - F.avg(x).over(over), F.stddev_samp(x).over(over))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    """Great-circle distance in the radius's unit, angles in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def parse_number(text: Column) -> Column:
    """The first number in a text, thousands separators dropped; null if there is none."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"[-+]?\d*\.?\d+", 0).try_cast("double")


def row_stat(columns: list[Column], stat: str) -> Column:
    """sum, mean, min or max over columns of a row, nulls skipped; null if all are null."""
    if stat in ("min", "max"):
        return (F.least if stat == "min" else F.greatest)(*columns)
    n = sum(c.isNotNull().cast("int") for c in columns)
    total = sum(F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns)
    return F.when(n > 0, total if stat == "sum" else total / n)
