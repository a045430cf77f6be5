"""Registry of the bar queries: importing the plan modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.plans import base, intake, intraday, judging, learning, more, returns, streams, tables, windows


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["G-08"](spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


__all__ = ["flagship", "intake", "intraday", "judging", "learning", "more", "oracle_sql", "queries", "returns", "streams", "tables", "windows"]
