"""Versioned tables: latest rows, budgets, state histories, reliability reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: A probability is kept above this in a log loss: the spacing of doubles at one.
LEAST_PROBABILITY = 2.220446049250313e-16


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns of each key, as a combinable maximum."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def budget(accesses: DataFrame, keys: list[str], most: int) -> DataFrame:
    used = F.count("*")
    return accesses.groupBy(*keys).agg(used.alias("used"), F.greatest(most - used, F.lit(0)).alias("remaining"), (used >= most).alias("refused"))


def illegal(history: DataFrame, keys: list[str], order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose state may not follow the one before."""
    rows = history.withColumn("before", F.lag(state).over(Window.partitionBy(*keys).orderBy(*order)))
    legal = F.concat_ws(">", "before", state).isin([f"{a}>{b}" for a, b in allowed])
    return rows.where(F.col("before").isNotNull() & ~legal)


def register(existing: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """``asked`` definitions (a version, or NULL for the next one) with the version they get and ``refused``: a version that
    exists already, or that is not the next one, is never written."""
    top = existing.groupBy(key).agg(F.max("version").alias("_top"))
    rows = asked.withColumnRenamed("version", "_asked").join(top, key, "left")
    following = F.coalesce("_top", F.lit(0)) + 1
    refused = F.when(F.col("_asked") < following, "exists").when(F.col("_asked") > following, "not the next")
    return rows.withColumns({"version": F.coalesce("_asked", following).cast("long"), "refused": refused}).drop("_top", "_asked")


def append_version(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New definitions with the next version of their id; ids that are new start at 1."""
    top = existing.groupBy(key).agg(F.max("version").alias("_top"))
    return new.join(top, key, "left").withColumn("version", F.coalesce("_top", F.lit(0)) + 1).drop("_top")


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(existing.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows with the new one winning per key."""
    both = old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)))
    return latest(both, keys, ["_rank"]).drop("_rank").select(*old.columns)


def reliability(rows: DataFrame) -> DataFrame:
    """Per bin, and over all (bin NULL): n, mean probability, observed rate, Brier score and log loss."""
    error = F.col("p") - F.col("y")
    said = F.greatest(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(LEAST_PROBABILITY))
    return rows.rollup("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.avg("y").alias("rate"), F.avg(error * error).alias("brier"), F.avg(-F.ln(said)).alias("log_loss"))
