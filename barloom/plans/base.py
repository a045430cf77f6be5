"""Registration of queries with their DuckDB SQL, and the SQL of the common bar tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ts import DAY, HOUR
from barloom.sources.ticks import bars, table, ticks

__all__ = ["DAY", "HOUR", "QUERIES", "ORACLES", "bars", "query", "r", "sql", "table", "ticks"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _bars_sql(step: int) -> str:
    return f"""SELECT symbol, (t // {step}) * {step} AS open_time, arg_min(price, t) AS open, max(price) AS high, min(price) AS low,
      arg_max(price, t) AS close, count(*)::DOUBLE AS volume, sum(price) AS quote_volume, count(*) AS trades,
      (count(*) FILTER (k >= 50))::DOUBLE AS taker_buy_base, coalesce(sum(price) FILTER (k >= 50), 0.0) AS taker_buy_quote,
      (t // {step}) * {step} + {step} - 1 AS close_time
      FROM ticks GROUP BY ALL"""


COMMON = f"""WITH ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS t, event_id, user_id, value AS price, CAST(props->>'$.k' AS INT) AS k FROM events),
  h AS ({_bars_sql(HOUR)}),
  d AS ({_bars_sql(DAY)})"""


def sql(body: str, **tables: str) -> str:
    """``body`` after the common tables (ticks, h: hourly bars, d: daily bars) and further named ones."""
    return COMMON + "".join(f",\n  {name} AS ({text})" for name, text in tables.items()) + "\n" + body


def r(x: Column | str, name: str | None = None) -> Column:
    """Rounded to six places as SQL on DuckDB does it, at the millionfold, without a negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.round(x * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)
    return out.alias(name) if name else out


def query(name: str, oracle: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add
