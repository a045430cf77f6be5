"""Samples, fits, calibration and controls as distributed table jobs with MLlib."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import clock, ts


def samples(features: DataFrame, bars: DataFrame, names: list[str], horizon: int, step: int, splits: list[tuple[str, int, int]]) -> DataFrame:
    """(symbol, open_time, label_end, target, split, features...) of rows with all features and a label in their split."""
    labelled = bars.select("symbol", "open_time", ts.forward_return(F.col("close"), horizon, step).alias("target")).withColumn("label_end", F.col("open_time") + horizon * step)
    rows = features.select("symbol", "open_time", *names).join(labelled, ["symbol", "open_time"]).na.drop(subset=[*names, "target"])
    return clock.assign(rows, splits, "label_end").where("fate = 'kept'").drop("fate")


def standardised(rows: DataFrame, names: list[str]) -> DataFrame:
    """Features scaled by the TRAIN mean and population deviation, assembled as ``x``; a constant feature becomes 0."""
    train = rows.where("split = 'train'")
    stats = train.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()  # one row
    scaled = rows.withColumns({n: (F.col(n) - stats[f"m_{n}"]) / (stats[f"s_{n}"] or 1.0) for n in names})
    return VectorAssembler(inputCols=names, outputCol="x").transform(scaled)


def ridge(rows: DataFrame, alpha: float):
    """Ridge regression with the penalty of the closed form: the solver scales labels, so alpha / n is rescaled."""
    n, spread = rows.agg(F.count("*"), F.stddev_pop("target")).first()
    return LinearRegression(featuresCol="x", labelCol="target", elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha / n * (spread or 1.0)).fit(rows)


def logistic(rows: DataFrame, c: float):
    n = rows.count()
    rows = rows.withColumn("label", (F.col("target") > 0).cast("double"))
    return LogisticRegression(featuresCol="x", labelCol="label", standardization=False, regParam=1.0 / (c * n)).fit(rows)


def boosted(rows: DataFrame, rounds: int = 10, depth: int = 3, seed: int = 7):
    """Boosted trees with early stopping on VALID rows."""
    rows = rows.where("split in ('train', 'valid')").withColumns({"label": (F.col("target") > 0).cast("double"), "held": F.col("split") == "valid"})
    return GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="held").fit(rows)


def probabilities(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def calibrated(valid: DataFrame, rows: DataFrame) -> DataFrame:
    """Isotonic calibration fitted on VALID only, used on later rows."""
    fitted = IsotonicRegression(featuresCol="p", labelCol="label").fit(valid.drop("prediction").withColumn("label", (F.col("target") > 0).cast("double")))
    return fitted.transform(rows.drop("prediction")).withColumnRenamed("prediction", "calibrated")


def factor(seed: int) -> int:
    """An odd factor of its own for each seed, by which times are spread over 31 bits."""
    return 1_103_515_245 * (2 * seed + 1) % 2**31


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Targets dealt anew within each symbol, by an arithmetic hash of the time: a control that must show no skill."""
    by = lambda k: F.row_number().over(Window.partitionBy("symbol").orderBy(F.expr(f"open_time div 1000000 * {factor(k)} % {2**31}"), "open_time"))
    a = rows.withColumn("_n", by(seed))
    b = rows.select("symbol", "target", by(seed + 1).alias("_n"))
    return a.drop("target").join(b, ["symbol", "_n"]).drop("_n")


def classes(rows: DataFrame, seeds: list[int], layers: list[int]) -> DataFrame:
    """(model, seed, n, accuracy, macro_f1) on TEST rows of a multinomial logistic fit and a small network, fitted on TRAIN;
    rows has x, label (0, 1, ...) and split."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from barloom.operators import reports

    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    out = None
    for seed in seeds:
        fits = {
            "logistic": LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", maxIter=20),
            "network": MultilayerPerceptronClassifier(featuresCol="x", labelCol="label", layers=layers, seed=seed, maxIter=20),
        }
        for name, fit in fits.items():
            said = fit.fit(train).transform(test).select("label", F.col("prediction").alias("predicted"))
            row = reports.classification(said).select(F.lit(name).alias("model"), F.lit(seed).alias("seed"), "n", "accuracy", "macro_f1")
            out = row if out is None else out.unionByName(row)
    return out


def isotonic_return(valid: DataFrame, rows: DataFrame) -> DataFrame:
    """``expected``: the isotonic return for a probability ``p``, fitted on VALID rows alone."""
    fitted = IsotonicRegression(featuresCol="p", labelCol="target").fit(valid.select("p", "target"))
    return fitted.transform(rows.drop("prediction")).withColumnRenamed("prediction", "expected")


def hurdle(expected, cost: float, full: float):
    """An expected return above its cost as a signal in [0, 1], whole at ``full`` above it."""
    return ts.clip((expected - cost) / full, 0.0, 1.0)


def boosted_return(rows: DataFrame, rounds: int = 5, depth: int = 2, seed: int = 7):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="x", labelCol="target", maxIter=rounds, maxDepth=depth, seed=seed).fit(rows.where("split = 'train'"))


def horizon_screen(rows: DataFrame, cost: float) -> DataFrame:
    """By exit (horizon): a return regression on TRAIN, made monotone on VALID; TEST rows whose expected return beats the cost
    trade, and are judged at once and twice the cost."""
    out = None
    for (h,) in sorted(map(tuple, rows.select("horizon").distinct().collect())):  # the few exits that are asked for
        part = rows.where(F.col("horizon") == h)
        score = boosted_return(part).transform(part).withColumnRenamed("prediction", "p")
        test = isotonic_return(score.where("split = 'valid'"), score.where("split = 'test'"))
        active = F.col("expected") > cost
        one = test.groupBy("horizon").agg(F.count("*").alias("n"), F.count_if(active).alias("active"), *[F.avg(F.when(active, F.col("target") - m * cost)).alias(f"net_{m}x") for m in (1, 2)])
        out = one if out is None else out.unionByName(one)
    return out
