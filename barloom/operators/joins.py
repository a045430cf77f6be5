"""Alignment, interval, as-of and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.ts import DAY

KEYS = ["symbol", "open_time"]
#: A dimension up to so many rows is broadcast; a longer one is joined by exchange.
BROADCAST_ROWS = 100_000


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Exact-time alignment: what has no partner is unknown, never the nearest."""
    return left.join(right, KEYS, "left")


def small(dimension: DataFrame) -> DataFrame:
    return F.broadcast(dimension) if dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dimension


def interval(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with each membership (symbol, lo, hi, ...) whose half-open interval holds their time."""
    return rows.join(small(members), "symbol").where((F.col("open_time") >= F.col("lo")) & (F.col("open_time") < F.col("hi")))


def as_of(rows: DataFrame, known: DataFrame, value: str, width: int = 366 * DAY) -> DataFrame:
    """The latest ``value`` known at or before each row's time. Both sides share one exchange by symbol and stretches of
    ``width``; the last value of each stretch is handed on to the later ones, however far."""
    both = rows.withColumn("_row", F.lit(1)).unionByName(known.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    found = scan.scanned(both, ["symbol"], scan.by_time(1, width), ["open_time", "_row"], lasts={"_known": F.col(value)})
    return found.where("_row = 1").withColumn(value, F.col("_known")).drop("_row", "_known")


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    a, b = left.select(key, F.col(value).alias("_l"), F.lit(True).alias("_a")), right.select(key, F.col(value).alias("_r"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("_l").eqNullSafe(F.col("_r")))
    return both.select(key, F.when(F.col("_b").isNull(), "only left").when(F.col("_a").isNull(), "only right").otherwise("differs").alias("status"))


def calendar_audit(rows: DataFrame, every: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, day, status, n) of the days of rows (symbol, day) that aren't as the calendar (day, slots) has them: missing,
    unexpected or incomplete. Days are small and travel to each symbol as one array, so nothing is joined crosswise."""
    days = calendar.agg(F.collect_list(F.struct("day", "slots")).alias("all"))  # a calendar: as many rows as days
    expected = every.select("symbol").distinct().join(F.broadcast(days)).select("symbol", F.explode("all").alias("x")).select("symbol", "x.day", "x.slots")
    seen = rows.groupBy("symbol", "day").agg(F.count("*").alias("n"))
    both = expected.join(seen, ["symbol", "day"], "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("slots").isNull(), "unexpected").when(F.col("n") != F.col("slots"), "incomplete")
    return both.select("symbol", "day", status.alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n")).where("status is not null")


def universe(days: DataFrame, members: DataFrame) -> DataFrame:
    """(open_time, members, tradable, unlisted): arrays of the symbols whose interval holds each day, of those listed by then,
    and of the others. ``members`` is a table of intervals, small beside prices."""
    each = days.join(small(members), (F.col("open_time") >= F.col("lo")) & (F.col("open_time") < F.col("hi")))
    listed = F.when(F.col("open_time") >= F.col("listed"), F.col("symbol"))
    out = each.groupBy("open_time").agg(F.array_sort(F.collect_list("symbol")).alias("members"), F.array_sort(F.collect_list(listed)).alias("tradable"))
    return out.withColumn("unlisted", F.array_except("members", "tradable"))


def price_screen(detailed: DataFrame, daily: DataFrame, tolerance: float) -> DataFrame:
    """Extremes of detailed bars against an official daily reference."""
    found = detailed.groupBy("symbol", (F.expr(f"open_time div {DAY}") * DAY).alias("open_time")).agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    off = (F.abs(F.col("_h") - F.col("high")) > tolerance * F.abs("high")) | (F.abs(F.col("_l") - F.col("low")) > tolerance * F.abs("low"))
    return daily.join(found, KEYS).withColumn("status", F.when(off, "off scale").otherwise("ok"))


def reference(rows: DataFrame, official: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the value of their one official row and ``matched``: the key that found it, ambiguous or none.

    Keys are tried in order; a later one only where the earlier ones found nothing. The official side is combined by key
    first, so a key held by many official rows doesn't multiply the rows that ask for it.
    """
    out, matched, found = rows, F.lit(None).cast("string"), F.lit(None)
    for key in keys:
        one = official.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"_n_{key}"), F.min(value).alias(f"_v_{key}"))
        out = out.join(one, key, "left")
    for key in reversed(keys):
        n = F.col(f"_n_{key}")
        matched = F.when(n == 1, key).when(n > 1, "ambiguous").otherwise(matched)
        found = F.when(n == 1, F.col(f"_v_{key}")).when(n.isNull(), found)
    return out.select(*rows.columns, F.coalesce(matched, F.lit("none")).alias("matched"), found.alias(value))
