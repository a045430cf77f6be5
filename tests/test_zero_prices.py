"""Queries against their SQL on events with prices of zero and of a cent, which the small tables don't have."""

import duckdb
import pytest
from test_queries import ORACLES, QUERIES, canonical

from barloom.plans.base import r

EVENTS = "/root/testdata/sf0.01/events.parquet"
ODD = "CASE WHEN hash(event_id) % 11 = 0 THEN 0.0 WHEN hash(event_id) % 11 = 1 THEN 0.01 ELSE value END"
#: A few prices of zero, so that most windows hold none.
FEW = "CASE WHEN hash(event_id) % 997 = 0 THEN 0.0 ELSE value END"
#: Each query with the prices, as SQL, that it is run on.
CASES = [
    ("X-01", ODD),
    ("X-01", FEW),
    ("W-11", ODD),
    ("W-11", FEW),
    ("W-10", ODD),
    ("W-10", FEW),
    ("O-06", ODD),
    ("O-06", FEW),
    ("O-07", ODD),
    ("O-07", FEW),
    ("A-35", ODD),
    ("A-35", FEW),
    ("A-40", ODD),
    ("A-40", FEW),
    ("A-33", ODD),
    ("A-33", FEW),
    ("A-32", ODD),
    ("A-32", FEW),
    ("A-19", ODD),
    ("A-19", FEW),
    ("W-33", ODD),
    ("W-33", FEW),
]


@pytest.mark.parametrize("name, prices", CASES)
def test_query_matches_sql_on_zero_prices(spark, tmp_path, name, prices):
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * REPLACE ({prices} AS value) FROM '{EVENTS}') TO '{tmp_path}/events.parquet'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_rounding_is_that_of_sql(spark):
    # a mean of 32 prices in cents, half a millionth but for the last bit of its sum
    values = [43.472812499999996, -43.472812499999996, 0.1234565, -1e-9, None, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert [str(x["x"]) for x in rows.select(r("x", "x")).collect()] == [str(v) for v in want]
