"""Session calendars, segments, setups and intraday rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.ts import DAY, over, ratio


def calendar(spark: SparkSession, first: str, last: str, holidays: list[str], specials: list[str]) -> DataFrame:
    """Business days less holidays plus specials: (day, kind)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    special = F.col("day").isin([F.lit(d).cast("date") for d in specials]) if specials else F.lit(False)
    holiday = F.col("day").isin([F.lit(d).cast("date") for d in holidays]) if holidays else F.lit(False)
    return days.where(special | ((F.weekday("day") < 5) & ~holiday)).select("day", F.when(special, "special").otherwise("normal").alias("kind"))


def segments(bars: DataFrame, step: int) -> DataFrame:
    """A running segment number that rises after a time gap or at a new day."""
    piece = scan.by_time(step)
    rows = scan.scanned(bars, ["symbol"], piece, ["open_time"], before={"_last": F.col("open_time")})
    broken = F.coalesce((F.col("open_time") - F.col("_last") != step) | (F.expr(f"open_time div {DAY}") != F.expr(f"_last div {DAY}")), F.lit(True))
    return scan.scanned(rows.withColumn("_b", broken.cast("long")), ["symbol"], piece, ["open_time"], sums={"segment": F.col("_b")}).drop("_b", "_last")


def vwap(bars: DataFrame) -> DataFrame:
    """Running volume-weighted typical price in a day."""
    w = over("symbol", "_day")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = bars.withColumn("_day", F.expr(f"open_time div {DAY}"))
    return rows.withColumn("vwap", ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w))).drop("_day")


def setups(days: DataFrame, n: int) -> DataFrame:
    """Previous close and the mean true range of the n sessions before."""
    w = over()
    before = F.lag("close").over(w)
    rows = days.withColumns({"prev_close": before, "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))})
    f = w.rowsBetween(-n, -1)
    return rows.withColumn("atr", F.when(F.count("_tr").over(f) == n, F.avg("_tr").over(f))).drop("_tr")


def state_changes(rows: DataFrame, signal: str) -> DataFrame:
    before = F.coalesce(F.lag(signal).over(over()), F.lit(0))
    on = F.col(signal) == 1
    return rows.withColumn("state", F.when(on & (before == 0), "entry").when(~on & (before == 1), "exit").when(on, "hold").otherwise("flat"))


def identity_runs(rows: DataFrame, step: int, scale: float = 0.05) -> DataFrame:
    """Stretches of days (symbol, open_time, isin, high_ratio, low_ratio) with one ISIN, all shifted or none: both ratios to the
    reference more than ``scale`` above one, or both below. One row each, numbered, with its first and last day, number of
    days and the least and greatest ratio; over pieces of a series."""
    low, high = F.least("high_ratio", "low_ratio"), F.greatest("high_ratio", "low_ratio")
    rows = rows.withColumn("shifted", (low > 1 + scale) | (high < 1 - scale))
    piece = scan.by_time(step)
    rows = scan.scanned(rows, ["symbol"], piece, ["open_time"], before={"_was": F.struct("isin", "shifted")})
    new = (~F.col("_was").eqNullSafe(F.struct("isin", "shifted"))).cast("long")
    rows = scan.scanned(rows, ["symbol"], piece, ["open_time"], sums={"g": new})
    found = rows.groupBy("symbol", "g").agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"), F.count("*").alias("n"), F.min(low).alias("low"), F.max(high).alias("high"), F.first("isin").alias("isin"), F.first("shifted").alias("shifted"))
    return found.select("symbol", "g", "isin", "shifted", "first", "last", "n", "low", "high")


def opening(bars: DataFrame, step: int, slots: int) -> DataFrame:
    """Opening-range aggregates of a day: high, low and volume of its first slots, and their share of the whole day."""
    slot = F.floor(F.pmod("open_time", F.lit(DAY)) / step)
    first = slot < slots
    return bars.groupBy("symbol", (F.expr(f"open_time div {DAY}") * DAY).alias("day")).agg(
        F.max(F.when(first, F.col("high"))).alias("high"), F.min(F.when(first, F.col("low"))).alias("low"), F.sum(F.when(first, F.col("volume"))).alias("volume"), ratio(F.sum(F.when(first, F.col("volume"))), F.sum("volume")).alias("share")
    )


def breakout(bars: DataFrame, step: int, slots: int) -> DataFrame:
    """At most one entry and exit a day: enter at the first later close above the opening high, leave at the first close
    at or below the opening low behind it. Two conditional minima, each combined before its exchange."""
    rows = bars.withColumns({"day": F.expr(f"open_time div {DAY}") * DAY, "slot": F.floor(F.pmod("open_time", F.lit(DAY)) / step)})
    opened = opening(bars, step, slots).select("symbol", "day", F.col("high").alias("range_high"), F.col("low").alias("range_low"))
    rows = rows.join(opened, ["symbol", "day"])
    entry = rows.where((F.col("slot") >= slots) & (F.col("close") > F.col("range_high"))).groupBy("symbol", "day").agg(F.min("slot").alias("entry"))
    after = rows.join(entry, ["symbol", "day"]).where((F.col("slot") > F.col("entry")) & (F.col("close") <= F.col("range_low")))
    left = after.groupBy("symbol", "day").agg(F.min("slot").alias("exit"))
    return entry.join(left, ["symbol", "day"], "left").select("symbol", "day", "entry", "exit")


def expand(decisions: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """Entry and exit slots as a 0/1 target of each bar."""
    rows = bars.withColumns({"day": F.expr(f"open_time div {DAY}") * DAY, "slot": F.floor(F.pmod("open_time", F.lit(DAY)) / step)})
    on = F.col("entry").isNotNull() & (F.col("slot") >= F.col("entry")) & (F.col("exit").isNull() | (F.col("slot") < F.col("exit")))
    return rows.join(decisions, ["symbol", "day"], "left").withColumn("target", F.coalesce(on, F.lit(False)).cast("int"))


def full_sessions(bars: DataFrame, step: int, first: int, last: int) -> DataFrame:
    """Status of each symbol and day: the first rule that fails, or ``full``."""
    slot = F.floor(F.pmod("open_time", F.lit(DAY)) / step)
    inside = (slot >= first) & (slot < last)
    rows = bars.groupBy("symbol", (F.expr(f"open_time div {DAY}") * DAY).alias("day")).agg(
        F.count_if(inside).alias("n"), F.count_if(inside & ~(F.col("volume") > 0)).alias("idle"), F.count_if(inside & ~(F.col("low") <= F.least("open", "close"))).alias("bad")
    )
    status = F.when(F.col("n") != last - first, "incomplete").when(F.col("idle") > 0, "no volume").when(F.col("bad") > 0, "bad prices").otherwise("full")
    return rows.select("symbol", "day", status.alias("status"))


