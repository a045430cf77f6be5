"""Signals to lagged positions, returns, costs, drawdowns and metrics, as window columns and aggregates."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.ts import choose, clip, contiguous, finite, over, ratio  # noqa: F401

YEAR_HOURS = 24 * 365


def positions(rows: DataFrame, step: int, delay: int = 1, scale: float = 1.0, *keys: str) -> DataFrame:
    """Columns position, held, ret, gross, turnover from symbol, open_time, close and signal.

    The target is the clipped signal of ``delay - 1`` bars before; before the first usable target the position is flat,
    after it an unknown target or a gap stays unknown. The position held over a bar is the one of the bar before.
    """
    keys = keys or ("symbol",)
    w = over(*keys)
    target = clip(F.col("signal") / scale, -1.0, 1.0)
    back = delay - 1
    delayed = target if not back else F.when(contiguous(back + 1, step, w), F.lag(target, back).over(w))
    rows = rows.withColumn("_t", delayed)
    known = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(F.when(F.col("_t").isNotNull(), F.col("open_time"))).alias("_first"))
    rows = rows.join(known, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*[f"_k_{k}" for k in keys])
    rows = rows.withColumn("position", F.when(F.col("_first").isNull() | (F.col("open_time") < F.col("_first")), F.lit(0.0)).otherwise(F.col("_t")))
    past = {"_time": F.col("open_time"), "held": F.col("position"), "_close": F.col("close")}
    rows = scan.scanned(rows, list(keys), scan.by_time(step), ["open_time"], before=past)
    close, earlier = F.col("close"), F.col("_close")
    on_time = F.coalesce((F.col("open_time") - F.col("_time") == step) & (F.col("open_time") % step == 0), F.lit(False))
    rows = rows.withColumn("ret", F.when(on_time & (close > 0) & (earlier > 0), ratio(close, earlier) - 1))
    change = F.when(F.col("_time").isNull(), F.abs("position")).otherwise(F.abs(F.col("position") - F.col("held")))
    return rows.withColumns({"gross": F.col("held") * F.col("ret"), "turnover": change}).drop("_t", "_first", "_time", "_close")


def costs(rows: DataFrame, bps: Column) -> DataFrame:
    cost = F.col("turnover") * bps / 10_000
    return rows.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))


def boundary(rows: DataFrame, *keys: str) -> DataFrame:
    """Move the first row's entry cost into the first realised interval: net and cost of row 2 take it, row 1 has none."""
    w = over(*(keys or ("symbol",)))
    rn = F.row_number().over(w)
    moved = F.when(rn == 2, F.lag("cost").over(w)).otherwise(F.lit(0.0))
    rows = rows.withColumn("_rn", rn).withColumn("_moved", moved)
    return rows.withColumn("net", F.when(F.col("_rn") == 1, F.lit(None)).otherwise(F.col("net") - F.col("_moved"))).drop("_rn", "_moved")


def return_metrics(rows: DataFrame, value: str, per_year: float, *keys: str) -> DataFrame:
    """n, total, mean, annual, vol, sharpe, annual_sharpe; undefined ones are NULL.

    The deviation is taken on values scaled by their largest size, so tiny returns keep their spread.
    """
    keys = keys or ("symbol",)
    x = F.col(value)
    biggest = rows.groupBy(*keys).agg(F.max(F.abs(x)).alias("_m"))
    scaled = rows.join(biggest, list(keys)).groupBy(*keys).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.when((F.max("_m") == 0) & (F.count(x) > 1), 0.0).otherwise(F.stddev_samp(ratio(x, F.nullif(F.col("_m"), F.lit(0.0)))) * F.max("_m")).alias("vol")
    )
    vol = F.nullif(F.col("vol"), F.lit(0.0))
    return scaled.select(
        *keys, "n", "total", "mean", (F.col("mean") * per_year).alias("annual"), "vol", ratio(F.col("mean"), vol).alias("sharpe"), (ratio(F.col("mean"), vol) * per_year**0.5).alias("annual_sharpe")
    )


def drawdown(rows: DataFrame, value: str, step: int, *keys: str) -> DataFrame:
    """Running total, its peak (0 at least) and the drop from it, with the rows since the last peak; over pieces of a series."""
    keys = list(keys or ("symbol",))
    piece = scan.by_time(step)
    rows = scan.scanned(rows.where(F.col(value).isNotNull()), keys, piece, ["open_time"], sums={"cum": F.col(value), "_rn": F.lit(1).cast("long")})
    top = F.struct(F.col("cum").alias("c"), F.col("_rn").alias("n"))  # of equal totals the latest is the larger
    rows = scan.scanned(rows, keys, piece, ["open_time"], maxima={"_top": top})
    rows = rows.withColumns({"peak": F.greatest("_top.c", F.lit(0.0)), "_at": F.when(F.col("_top.c") >= 0, F.col("_top.n")).otherwise(0)})
    return rows.withColumns({"drop": F.col("peak") - F.col("cum"), "underwater": F.col("_rn") - F.col("_at")}).drop("_rn", "_at", "_top")


def below_peak(rows: DataFrame, value: str, step: int, *keys: str) -> DataFrame:
    """``drawdown``: how far an equity curve is below its running maximum, as a fraction; over pieces of a series."""
    rows = scan.scanned(rows, list(keys or ("symbol",)), scan.by_time(step), ["open_time"], maxima={"_peak": F.col(value)})
    return rows.withColumn("drawdown", ratio(F.col(value), F.col("_peak")) - 1).drop("_peak")


def daily(rows: DataFrame, value: str, step: int, *keys: str) -> DataFrame:
    """Daily sums with the number of known periods, the number expected, and whether some are missing."""
    day = 86_400_000_000
    expected = day // step
    return rows.groupBy(*(keys or ("symbol",)), (F.floor(F.col("open_time") / day) * day).alias("day")).agg(
        F.sum(value).alias("total"), F.count(value).alias("n"), F.lit(expected).cast("long").alias("expected"), (F.count(value) < expected).alias("has_gaps")
    )


def diagnostics(rows: DataFrame, *keys: Column) -> DataFrame:
    """Turnover, its mean, and the share of periods that the held position had the return's sign in, by keys; each unknown
    unless every period has what it needs."""
    whole = lambda x, *needs: F.when(F.count_if(~F.coalesce(reduce(and_, [F.col(c).isNotNull() for c in needs]), F.lit(False))) == 0, x)
    hit = (F.signum("held") == F.signum("ret")).cast("int")
    return rows.groupBy(*keys).agg(whole(F.sum("turnover"), "turnover").alias("turnover"), whole(F.avg("turnover"), "turnover").alias("mean_turnover"), whole(F.avg(hit), "held", "ret").alias("hit_rate"))


def stability(rows: DataFrame, value: str, per_year: float, keys: list[str], part: str) -> DataFrame:
    """Of the annual Sharpe by ``part`` (months, say), where it is defined: how many, mean, least and the share above zero."""
    s = return_metrics(rows, value, per_year, *keys, part).select(*keys, F.col("annual_sharpe").alias("s"))
    above = F.avg(F.when(F.col("s").isNotNull(), (F.col("s") > 0).cast("int")))
    return s.groupBy(*keys).agg(F.count("s").alias("defined"), F.avg("s").alias("mean"), F.min("s").alias("least"), above.alias("positive"))


def fitness(annual_sharpe: Column, annual: Column, turnover: Column, floor: float = 0.125) -> Column:
    return annual_sharpe * F.sqrt(F.abs(annual) / F.greatest(turnover, F.lit(floor)))


def sweep(rows: DataFrame, bps: Column, multipliers: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0, 3.0)) -> DataFrame:
    """The same gross returns under several cost multipliers, as an explode of a fixed list."""
    return costs(rows.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in multipliers]))), bps * F.col("multiplier"))


def correlation(rows: DataFrame, x: str, y: str, keys: list[str], spearman: bool = False, least: int = 2) -> DataFrame:
    """(keys, n, corr) over rows where both are known; NULL when either is constant or there are too few."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if spearman:
        for c in (x, y):
            w = Window.partitionBy(*keys).orderBy(c)
            both = both.withColumn(f"_{c}", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2)
        x, y = f"_{x}", f"_{y}"
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("a"), F.stddev_pop(y).alias("b"), (F.min(x) == F.max(x)).alias("fx"), (F.min(y) == F.max(y)).alias("fy"))
    value = F.when((F.col("n") >= least) & ~F.col("fx") & ~F.col("fy"), clip(ratio(F.col("c"), F.col("a") * F.col("b")), -1.0, 1.0))
    return out.select(*keys, "n", value.alias("corr"))


def pair_correlations(rows: DataFrame, key: str, day: str, value: str, least: int, block: int = 512, days: int = 256) -> DataFrame:
    """(one, two, n, corr) for all pairs of keys (one before two) with ``least`` shared days on which both values are known.

    Keys are dealt into blocks of about ``block``, days (any whole numbers) into groups of ``days``. A task takes one pair of
    blocks and one group of days as matrices, and their products are the sums of all of its pairs at once; what leaves it is
    one row for each pair that met. No rows are joined by day. Each key's mean is taken off before, so sums don't cancel.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(day).alias("d"), F.col(value).alias("v"))
    means = known.groupBy("k").agg(F.avg("v").alias("m"))
    blocks = max(1, -(-means.count() // block))
    mine, other = F.pmod(F.xxhash64("k"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = known.join(means, "k").select("k", "d", (F.col("v") - F.col("m")).alias("v"), mine.alias("mine"), other.alias("other"))
    sent = sent.select("k", "d", "v", "mine", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), F.expr(f"d div {days}").alias("g"))

    def products(part: pd.DataFrame) -> pd.DataFrame:
        x = part.pivot(index="d", columns="k", values="v")
        block_of = part.drop_duplicates("k").set_index("k")["mine"].reindex(x.columns).to_numpy()
        held, x = x.notna().to_numpy().astype(float), x.fillna(0.0)
        names, x = x.columns.to_numpy(), x.to_numpy()
        n, s, ss, xy = held.T @ held, x.T @ held, (x * x).T @ held, x.T @ x
        i, j = np.nonzero(n)
        same = part["a"].iloc[0] == part["b"].iloc[0]
        use = (names[i] < names[j]) & (same | (block_of[i] != block_of[j]))
        i, j = i[use], j[use]
        return pd.DataFrame({"one": names[i], "two": names[j], "n": n[i, j].astype(np.int64), "x": s[i, j], "y": s[j, i], "xx": ss[i, j], "yy": ss[j, i], "xy": xy[i, j]})

    kind = rows.schema[key].dataType.simpleString()
    parts = sent.groupBy("a", "b", "g").applyInPandas(products, f"one {kind}, two {kind}, n long, x double, y double, xx double, yy double, xy double")
    sums = parts.groupBy("one", "two").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).where(F.col("n") >= least)
    spread = lambda c: F.col("n") * F.col(c + c) - F.col(c) * F.col(c)
    varies = lambda c: spread(c) > 1e-12 * F.col("n") * F.col(c + c)
    corr = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread("x") * spread("y"))
    return sums.select("one", "two", "n", F.when(varies("x") & varies("y"), clip(corr, -1.0, 1.0)).alias("corr"))


def edge_after_cost(gain: Column, cost: float) -> Column:
    """What a move leaves after a cost: its size less the cost, zero at least, with its sign."""
    return F.signum(gain) * F.greatest(F.abs(gain) - cost, F.lit(0.0))
