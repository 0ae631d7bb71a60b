"""Writers of results: partitioned Parquet and CSV, and tables for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    (rows.write.mode(mode).partitionBy(*by) if by else rows.write.mode(mode)).parquet(path)


def csv(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = rows.write.mode(mode).option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def report(rows: DataFrame, digits: int = 2, **names: str) -> DataFrame:
    """Numbers as text with so many digits; ``names`` renames columns."""
    kinds = dict(rows.dtypes)
    shown = [(F.format_number(c, digits) if kinds[c] in ("double", "float") else F.col(c)).alias(names.get(c, c)) for c in rows.columns]
    return rows.select(*shown)
