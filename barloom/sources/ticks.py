"""Ticks from an event table and bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, taken as UTC whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        micros(F.col("ts")).alias("t"),
        "event_id",
        "user_id",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def bars_from_ticks(rows: DataFrame, step: int) -> DataFrame:
    """One bar per symbol and non-empty period; every aggregate is combined before the exchange."""
    buy = F.col("k") >= 50
    return (
        rows.groupBy("symbol", (F.expr(f"t div {step}") * step).alias("open_time"))
        .agg(
            F.min_by("price", "t").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "t").alias("close"),
            F.count("*").cast("double").alias("volume"),
            F.sum("price").alias("quote_volume"),
            F.count("*").alias("trades"),
            F.count_if(buy).cast("double").alias("taker_buy_base"),
            F.sum(F.when(buy, F.col("price")).otherwise(0.0)).alias("taker_buy_quote"),
        )
        .withColumn("close_time", F.col("open_time") + step - 1)
    )


def bars(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), step)
