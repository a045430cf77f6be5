"""Model reports: classification, regression, seeds, ranks; and information coefficients by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ts import ratio
from barloom.operators import pnl


def classification(rows: DataFrame) -> DataFrame:
    """One row of label against predicted: n, accuracy, macro-F1 (0 for a class that is undefined) and the majority's share."""
    pairs = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))  # classes squared
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said"), hit.cast("long").alias("hit")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s"))
    classes = sides.groupBy("s.c").agg(F.sum("s.real").alias("real"), F.sum("s.said").alias("said"), F.sum("s.hit").alias("hit"))
    f1 = F.coalesce(ratio(2.0 * F.col("hit"), F.col("real") + F.col("said")), F.lit(0.0))
    return classes.agg(
        F.sum("real").alias("n"), (F.sum("hit") / F.sum("real")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.max("real") / F.sum("real")).alias("majority")
    )


def log_loss(rows: DataFrame, edge: float = 1e-6) -> DataFrame:
    """Mean log loss of p against y (0 or 1), with p kept off 0 and 1."""
    p = F.greatest(F.least("p", F.lit(1 - edge)), F.lit(edge))
    return rows.agg(F.avg(-F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def auc(rows: DataFrame, parts: int = 4096) -> DataFrame:
    """Area under the curve of p for y by rank sums with average ties, exact and without one global order.

    Values are counted first; ranks run inside ``parts`` ranges of p, over the totals of the ranges below.
    """
    values = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    # values below 0 and above 1 share the outer ranges, so there are never more ranges than parts
    values = values.withColumn("part", F.least(F.greatest(F.floor(F.col("p") * parts), F.lit(0)), F.lit(parts - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = values.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.join(F.broadcast(offsets), "part").withColumn("rank", F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2)
    pos, neg = F.sum("pos"), F.sum("n") - F.sum("pos")
    return ranked.agg(ratio(F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def regression(rows: DataFrame) -> DataFrame:
    """MAE, RMSE and R2 of ``prediction`` on TEST rows, next to those of the TRAIN mean; rows has y, prediction, split."""
    base = rows.where("split = 'train'").agg(F.avg("y")).first()[0]
    e, b = F.col("y") - F.col("prediction"), F.col("y") - F.lit(base)
    return rows.where("split = 'test'").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - ratio(F.avg(e * e), F.var_pop("y"))).alias("r2"),
        F.avg(F.abs(b)).alias("base_mae"), F.sqrt(F.avg(b * b)).alias("base_rmse"),
    )


def seeds(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean and spread over seeds of (keys, seed, score); one seed alone has a spread of 0."""
    return scores.groupBy(*keys).agg(F.count("*").alias("seeds"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("spread"))


def period_ic(rows: DataFrame, x: str, y: str, start: Column, end: Column) -> DataFrame:
    """(symbol, period, n, corr): the correlation of each symbol over all (period NULL) and by the period of ``start``,
    without labels whose ``end`` lies in another period."""
    whole = pnl.correlation(rows, x, y, ["symbol"]).select("symbol", F.lit(None).cast("long").alias("period"), "n", "corr")
    inside = rows.withColumn("period", start).where(start == end)
    return whole.unionByName(pnl.correlation(inside, x, y, ["symbol", "period"]).select("symbol", "period", "n", "corr"))


def cross_section_ic(rows: DataFrame, x: str, y: str, period: Column, done: Column, least: int) -> DataFrame:
    """(kind, period, n, value, ratio): the correlation across keys at each time with ``least`` known pairs; its mean by
    period, of labels that end in it; its mean over all times, with the mean of the periods over their deviation."""
    rows = rows.withColumns({"_p": period, "_done": done})
    times = pnl.correlation(rows, x, y, ["open_time", "_p", "_done"], least=least).where(F.col("n") >= least)
    none = F.lit(None).cast("double")
    each = times.select(F.lit("time").alias("kind"), F.col("open_time").alias("period"), "n", F.col("corr").alias("value"), none.alias("ratio"))
    months = times.where(F.col("corr").isNotNull() & (F.col("_p") == F.col("_done"))).groupBy(F.col("_p").alias("period")).agg(F.count("*").alias("n"), F.avg("corr").alias("value"))
    whole = times.agg(F.count("corr").alias("n"), F.avg("corr").alias("value")).join(months.agg(ratio(F.avg("value"), F.nullif(F.stddev_samp("value"), F.lit(0.0))).alias("ratio")))
    out = each.unionByName(months.select(F.lit("month").alias("kind"), "period", "n", "value", none.alias("ratio")))
    return out.unionByName(whole.select(F.lit("all").alias("kind"), F.lit(None).cast("long").alias("period"), "n", "value", "ratio"))


def effort(results: DataFrame, group: str) -> DataFrame:
    """Attempts, invalid and valid ones by group and in all (group NULL), with the best valid result by fitness, then id."""
    valid = F.col("status") != "INVALID"
    best = F.min(F.when(valid & F.col("fitness").isNotNull(), F.struct((-F.col("fitness")).alias("f"), F.col("id").alias("id"))))
    return results.rollup(group).agg(F.count("*").alias("attempts"), F.count_if(~valid).alias("invalid"), F.count_if(valid).alias("valid"), best["id"].alias("best"))


def overview(results: DataFrame, selections: DataFrame) -> DataFrame:
    """Each definition with its latest measurement, its selection and how often it was tried."""
    latest = results.groupBy("id").agg(F.max_by(F.struct("status", "split"), F.struct("finished", "run")).alias("r"), F.count("*").alias("attempts"))
    chosen = F.coalesce("selection", F.lit("UNDECIDED"))
    return latest.join(selections, "id", "left").select("id", F.col("r.status").alias("measurement"), F.col("r.split").alias("split"), chosen.alias("selection"), "attempts")
