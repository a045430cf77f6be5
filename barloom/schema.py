"""Declared schemas and the check that a table has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


KLINE = _struct(
    "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double, ignore double"
)
BAR = _struct(
    "symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double"
)


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns; refuses missing ones and other types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return df.select(*schema.names)
