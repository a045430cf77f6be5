"""Longer bars from shorter ones and comparison of two sets of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUES = ["open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]


def resample(bars: DataFrame, step: int, longer: int, complete: bool = True) -> DataFrame:
    """Bars of ``longer`` from bars of ``step``; only complete periods unless told otherwise."""
    if longer % step or longer <= step:
        raise ValueError("the longer interval must be a multiple of the shorter one")
    out = (
        bars.groupBy("symbol", (F.floor(F.col("open_time") / longer) * longer).alias("period"))
        .agg(
            F.min_by("open", "open_time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"),
            *[F.sum(c).alias(c) for c in VALUES[4:]],
            F.count("*").alias("n"),
        )
        .withColumnRenamed("period", "open_time")
    )
    out = out.where(F.col("n") == longer // step) if complete else out
    return out.withColumn("close_time", F.col("open_time") + longer - 1)


def compare(left: DataFrame, right: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Values that differ by more than a relative tolerance of the right one: (symbol, open_time, field, left, right)."""
    a = left.select("symbol", "open_time", *[F.col(c).cast("double").alias(f"l_{c}") for c in VALUES])
    b = right.select("symbol", "open_time", *[F.col(c).cast("double").alias(f"r_{c}") for c in VALUES])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right")) for c in VALUES])).alias("v")
    rows = a.join(b, ["symbol", "open_time"]).select("symbol", "open_time", pairs).select("symbol", "open_time", "v.*")
    return rows.where(~F.coalesce(F.abs(F.col("left") - F.col("right")) <= tolerance * F.abs("right"), F.col("left").isNull() & F.col("right").isNull()))
