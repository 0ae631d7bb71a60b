"""Every query of the engine runs; those with SQL give the same rows as DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tideweave.plans import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(tables):
    con = duckdb.connect()
    for name in os.listdir(tables):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{tables}/{name}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def show(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        # pandas turns integers with nulls into floats
        return repr(float(v)) if isinstance(v, (int, float, np.integer)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(show(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, tables, duck):
    got = QUERIES[name](spark, tables).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_fit_agreement_has_every_run(spark, tables):
    from tideweave.plans import model_queries

    rows = QUERIES["fit_agreement"](spark, tables).collect()
    assert sorted(r.run_id for r in rows) == sorted(r.run_id for r in model_queries._grid(spark).collect())
    assert all(None not in (r.observed, r.expected, r.omega) for r in rows)
