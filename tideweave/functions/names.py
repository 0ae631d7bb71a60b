"""Names and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(n: int) -> str:
    """1 is a, 26 is z, 27 is aa."""
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


def letters_of(n: Column) -> Column:
    """The same for columns with values from 1 to 702."""
    last = F.char(F.lit(97) + (n - 1) % 26)
    return F.when(n <= 26, last).otherwise(F.concat(F.char(F.lit(96) + F.floor((n - 1) / 26)), last))


#: Where the parts of a census block group's code are.
CENSUS_PARTS = {"state": (1, 2), "county": (3, 3), "tract": (6, 6), "block_group": (12, 1)}


def census_part(code: Column, part: str) -> Column:
    """A part of a 12-digit code, as text so that leading zeros stay."""
    at, n = CENSUS_PARTS[part]
    return F.substring(code, at, n)


def before_dot(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^.]+", 0)


def syntactic(text: Column) -> Column:
    """A name without characters that are not letters, digits, dots or underscores."""
    clean = F.regexp_replace(text, r"[^A-Za-z0-9._]", ".")
    return F.when(clean.rlike(r"^([A-Za-z]|\.[^0-9]|\.$)"), clean).otherwise(F.concat(F.lit("X"), clean))
