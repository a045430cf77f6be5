"""Point-in-time universe and cross-sections at one time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.ts import DAY

#: Fixed listing dates of the registered queries (days since 1970); other symbols are listed from the start.
LISTED = [("error", 19733)]


def listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTED, "symbol string, first_day long")


def listed(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Bars from each symbol's listing midnight on. The listing is a short list of exceptions, checked before it is broadcast."""
    if dates.count() <= 100_000:
        dates = F.broadcast(dates)
    return bars.join(dates, "symbol", "left").where(F.col("first_day").isNull() | (F.col("open_time") >= F.col("first_day") * DAY)).drop("first_day")


def rank(rows: DataFrame, value: str) -> DataFrame:
    """Average-tie rank over the eligible count, known only if every eligible symbol has a value."""
    at = Window.partitionBy("open_time")
    n = F.count(value).over(at)
    ties = F.count("*").over(Window.partitionBy("open_time", value))
    place = (F.rank().over(at.orderBy(value)) + (ties - 1) / 2) / n
    return rows.withColumn("value", F.when(n == F.count("*").over(at), place))


def demean(rows: DataFrame, value: str) -> DataFrame:
    at = Window.partitionBy("open_time")
    return rows.withColumn("value", F.when(F.count(value).over(at) == F.count("*").over(at), F.col(value) - F.avg(value).over(at)))
