import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideweave.functions import dates, names, numbers


@pytest.mark.parametrize(
    "day, year, week",
    [("2021-01-03", 2021, 1), ("2021-01-02", 2020, 53), ("2023-01-01", 2023, 1), ("2022-12-31", 2022, 52), ("2024-12-29", 2025, 1), ("2015-01-03", 2014, 53)],
)
def test_epidemiological_weeks(spark, day, year, week):
    row = spark.sql(f"SELECT DATE'{day}' AS d").select(dates.epi_year(F.col("d")).alias("y"), dates.epi_week(F.col("d")).alias("w")).first()
    assert (row.y, row.w) == (year, week)


def test_days_by_several_formats(spark):
    rows = spark.createDataFrame([("01/02/23",), ("2023-01-02",), ("nonsense",), (None,)], "s string")
    got = [str(r[0]) for r in rows.select(dates.parse_day(F.col("s"), "MM/dd/yy", "yyyy-MM-dd")).collect()]
    assert got == ["2023-01-02", "2023-01-02", "None", "None"]


def test_letters(spark):
    assert [names.letters(n) for n in (1, 26, 27, 52, 702, 703)] == ["a", "z", "aa", "az", "zz", "aaa"]
    got = [r[0] for r in spark.range(1, 703).select(names.letters_of(F.col("id").cast("int"))).collect()]
    assert got == [names.letters(n) for n in range(1, 703)]


def test_names_and_codes(spark):
    row = spark.createDataFrame([("480291234567", "1,234.5 units", "a b-c", "B.1.617.2")], "code string, num string, name string, lineage string")
    row = row.select(
        *(names.census_part(F.col("code"), p) for p in ("state", "county", "tract", "block_group")), numbers.parse_number(F.col("num")), names.syntactic(F.col("name")), names.before_dot(F.col("lineage"))
    ).first()
    assert list(row) == ["48", "029", "123456", "7", 1234.5, "a.b.c", "B"]


def test_numbers(spark):
    row = spark.createDataFrame([(0.8, -3.0, 800.0)], "p double, x double, big double").select(
        numbers.inverse_logit(numbers.logit(F.col("p"))), numbers.soft_threshold(F.col("x"), F.lit(1.0)), numbers.log1pexp(F.col("big")), numbers.log1pexp(F.col("x"))
    ).first()
    assert [round(v, 6) for v in row] == [0.8, -2.0, 800.0, 0.048587]


def test_scaling_and_row_statistics(spark):
    rows = spark.createDataFrame([(1.0, None, 3.0), (2.0, 2.0, 2.0)], "a double, b double, c double")
    every = Window.partitionBy()
    got = rows.select(numbers.min_max(F.col("a"), every), numbers.min_max(F.col("b"), every), *(numbers.row_stat([F.col(c) for c in "abc"], s) for s in ("sum", "mean", "min", "max"))).collect()
    assert [tuple(r) for r in got] == [(0.0, None, 4.0, 2.0, 1.0, 3.0), (1.0, 2.0, 6.0, 2.0, 2.0, 2.0)]


def test_great_circle(spark):
    km = spark.range(1).select(numbers.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0]
    assert abs(km - 6371.0088 * 3.141592653589793 / 2) < 1e-6
