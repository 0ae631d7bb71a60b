"""Weeks of surveillance calendars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _middle(day: Column) -> Column:
    """The Wednesday of the Sunday-to-Saturday week that holds a day."""
    return F.date_add(day, F.lit(4) - F.dayofweek(day))


def epi_year(day: Column) -> Column:
    """Year that owns the day's epidemiological week: the year of its Wednesday."""
    return F.year(_middle(day))


def epi_week(day: Column) -> Column:
    """Number of the day's epidemiological week, from 1; weeks begin on Sundays."""
    return (F.floor((F.dayofyear(_middle(day)) - 1) / 7) + 1).cast("int")


def week_since(day: Column, first: Column) -> Column:
    """Number of the seven-day week since a first day, from 1."""
    return (F.floor(F.datediff(day, first) / 7) + 1).cast("int")


def parse_day(text: Column, *formats: str) -> Column:
    """A date by the first format that fits, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))
