"""Calibration maps and the way from a predicted probability to a bounded signal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import ts
from barloom.operators import joins

#: A map travels in the plan; one of more points is refused.
MOST_POINTS = 1000


def interpolate(p: Column, points: list[tuple[float, float]]) -> Column:
    """The piecewise-linear value of ``p`` on points (x, y) with rising x; flat beyond both ends, unknown where p is."""
    xs, ys = [float(x) for x, _ in points], [float(y) for _, y in points]
    if not points or len(points) > MOST_POINTS or any(not math.isfinite(v) for v in xs + ys) or any(a >= b for a, b in zip(xs, xs[1:], strict=False)):
        raise ValueError(f"a calibration map has 1 to {MOST_POINTS} finite points with rising x")
    x, y = F.array(*[F.lit(v) for v in xs]), F.array(*[F.lit(v) for v in ys])
    below = F.size(F.filter(x, lambda v: v <= p))
    x0, x1, y0, y1 = F.get(x, below - 1), F.get(x, below), F.get(y, below - 1), F.get(y, below)
    inner = y0 + (y1 - y0) * (p - x0) / (x1 - x0)
    return F.when(p.isNotNull() & ~F.isnan(p), F.when(below == 0, F.lit(ys[0])).when(below == len(xs), F.lit(ys[-1])).otherwise(inner))


def monotone_points(rows: DataFrame, bin: Column) -> list[tuple[float, float]]:
    """A rising map from the rates of y by bin: each bin's mean p with the highest rate up to it; one point a bin."""
    bins = rows.groupBy(bin.alias("_b")).agg(F.avg("p").alias("x"), F.avg("y").alias("y")).orderBy("x").limit(MOST_POINTS + 1).collect()
    out: list[tuple[float, float]] = []
    for r in bins:
        out.append((r["x"], max(r["y"], out[-1][1] if out else r["y"])))
    return out


def payoffs(rows: DataFrame, value: str) -> DataFrame:
    """(symbol, up, down): mean rising and other returns in basis points, of the rows given (TRAIN)."""
    y = F.col(value)
    return rows.groupBy("symbol").agg((F.avg(F.when(y > 0, y)) * 10_000).alias("up"), (F.avg(F.when(y <= 0, y)) * 10_000).alias("down"))


def edge_signal(rows: DataFrame, paid: DataFrame, points: list[tuple[float, float]], cost: Column, step: int, window: int, ready: int) -> DataFrame:
    """Rows of symbol, open_time and p with the calibrated probability, the edge before and after costs in basis points, its
    trailing score and the bounded signal ``alpha``.

    The score is known where the last ``window`` rows are one step apart. Scaling never makes a trade out of an edge inside
    costs nor turns one round: there the signal is 0. It is available once the decision comes at or after ``ready``.
    """
    rows = rows.join(joins.small(paid), "symbol")
    calibrated = interpolate(ts.finite(F.col("p")), points)
    rows = rows.withColumn("calibrated", calibrated).withColumn("gross", F.col("calibrated") * F.col("up") + (1 - F.col("calibrated")) * F.col("down"))
    rows = rows.withColumn("net", F.signum("gross") * F.greatest(F.abs("gross") - cost, F.lit(0.0)))
    rows = rows.withColumn("score", ts.zscore(F.col("net"), window))
    steady = ts.steps_on_time(window, step) == window - 1
    value = ts.clip(F.col("score"), -1.0, 1.0)
    kept = F.when((F.col("net") == 0) | (F.signum(value) != F.signum("net")), F.lit(0.0)).otherwise(value)
    usable = F.coalesce(steady & F.col("score").isNotNull(), F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("alpha", F.when(F.col("usable") & (F.col("open_time") + step >= ready), kept))
    return rows.drop("up", "down", "usable")
