"""From raw rows to a store of bars: normalise, validate, drop repeated rows, find gaps, write bars and reports, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import quality
from barloom.sources import stores


def normalise(rows: DataFrame) -> DataFrame:
    """Both clocks in microseconds; a close time in milliseconds ends its millisecond. Refused clocks are NULL."""
    end = F.when(F.col("close_time") < 100_000_000_000_000, F.col("close_time") * 1000 + 999).otherwise(F.col("close_time"))
    return rows.withColumns({"open_time": quality.clock_micros(F.col("open_time")), "close_time": end})


def tidy(rows: DataFrame) -> DataFrame:
    """The first row (by its place in the source, ``file`` and ``line``) of each symbol and time."""
    return quality.keep_first(rows, ["symbol", "open_time"], ["file", "line"])


def build(rows: DataFrame, step: int, root: str) -> DataFrame:
    """Write ``bars`` and the reports ``validation`` and ``gaps`` below ``root``; return the counters of each symbol.

    ``rows`` has the bar columns, symbol, file and line. Bad and off-grid bars stay in the store and are reported; rows with
    a refused clock are counted and left out. Gaps are measured between rows on the grid.
    """
    clean = stores.settle(normalise(rows))  # files are parsed once
    dated = clean.where(F.col("open_time").isNotNull())
    kept = tidy(dated).drop("file", "line")
    stores.write_bars(kept, f"{root}/bars")
    stored = rows.sparkSession.read.parquet(f"{root}/bars")
    stores.write_reports(root, validation=quality.report(dated, step), gaps=quality.gaps(stored, step))
    read = clean.groupBy("symbol").agg(
        F.count("*").alias("read"), F.count_if(F.col("open_time").isNull()).alias("refused"), F.count_distinct("file").alias("files")
    )
    found = rows.sparkSession.read.parquet(f"{root}/validation").groupBy("symbol").agg(F.count("*").alias("problems"))
    holes = rows.sparkSession.read.parquet(f"{root}/gaps").groupBy("symbol").agg(F.count("*").alias("gap_runs"), F.sum("missing").alias("missing"))
    written = stored.groupBy("symbol").agg(F.count("*").alias("written"))
    zero = F.lit(0).cast("long")
    out = read.join(written, "symbol", "left").join(found, "symbol", "left").join(holes, "symbol", "left")
    counts = {c: F.coalesce(c, zero) for c in ("written", "problems", "gap_runs", "missing")}
    out = out.withColumns(counts)
    return out.withColumn("repeated", F.col("read") - F.col("refused") - F.col("written"))
