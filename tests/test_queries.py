"""Every registered query of the bar library against its SQL on DuckDB, or for rows where SQL can't express it."""

import os

import duckdb
import pandas as pd
import pytest

from barloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def canonical(frame: pd.DataFrame) -> list[str]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, float) else v

    rows = frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)
    return sorted(str(tuple(cell(v) for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
