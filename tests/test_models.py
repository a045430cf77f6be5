"""Fits on planted data whose answer is known, and controls on data without one."""

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barloom.operators import features, gates, ml, pnl, registry, sizing
from barloom.functions import clock

H = 3_600_000_000


@pytest.fixture(scope="module")
def planted(spark):
    """Three splits of two features: the sign of a + noise makes the target, b means nothing."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        split = "train" if i < 900 else "valid" if i < 1200 else "test"
        rows.append((f"s{i % 3}", i * H, split, a, b, 0.02 * a + rng.gauss(0, 0.004)))
    rows = spark.createDataFrame(rows, "symbol string, open_time long, split string, a double, b double, target double")
    return ml.standardised(rows, ["a", "b"]).cache()


def accuracy(rows):
    return rows.agg(F.avg(((F.col("p") > 0.5) == (F.col("target") > 0)).cast("int"))).first()[0]


def test_direction_fits_find_the_planted_feature(planted):
    train, test = planted.where("split = 'train'"), planted.where("split = 'test'")
    model = ml.logistic(train, 1.0)
    assert accuracy(ml.probabilities(model, test)) > 0.9 and abs(model.coefficients[0]) > 20 * abs(model.coefficients[1])
    boosted = ml.boosted(planted, rounds=8, depth=2)
    assert accuracy(ml.probabilities(boosted, test)) > 0.88 and boosted.featureImportances[0] > 0.9


def test_shuffled_targets_show_no_skill(planted):
    """The same targets in other places: each symbol keeps its own, and a fit on them finds no effect."""
    mixed = ml.shuffled(planted.where("split = 'train'"), 3)
    totals = lambda rows: sorted((r[0], r[1], round(r[2], 9)) for r in rows.groupBy("symbol").agg(F.count("*"), F.sum("target")).collect())
    assert totals(mixed) == totals(planted.where("split = 'train'"))
    assert mixed.join(planted.select("symbol", "open_time", F.col("target").alias("was")), ["symbol", "open_time"]).where("target = was").count() < 30
    model = ml.logistic(mixed, 1.0)
    real = ml.logistic(planted.where("split = 'train'"), 1.0)
    assert abs(model.coefficients[0]) < 0.3 < 3 < real.coefficients[0]


def test_expected_returns_rise_with_the_probability(planted):
    scored = ml.probabilities(ml.boosted(planted, 5, 2), planted.where("split <> 'train'"))
    out = ml.isotonic_return(scored.where("split = 'valid'"), scored.where("split = 'test'")).orderBy("p").select("p", "expected", "target").collect()
    assert all(x["expected"] <= y["expected"] + 1e-12 for x, y in zip(out, out[1:], strict=False))
    top = [r["target"] for r in out if r["expected"] > 0.01]
    assert len(top) > 50 and sum(top) / len(top) > 0.01


def test_horizon_screen_trades_where_there_is_an_edge(planted, spark):
    rng = random.Random(2)
    lost = planted.select("symbol", "open_time", "split", "x", (F.rand(3) * 0.0002 - 0.0001).alias("target"), F.lit(2).alias("horizon"))
    both = planted.select("symbol", "open_time", "split", "x", "target", F.lit(1).alias("horizon")).unionByName(lost)
    got = {r["horizon"]: r for r in ml.horizon_screen(both, 0.001).collect()}
    assert got[1]["active"] > 100 and got[1]["net_2x"] > 0.005 and got[1]["net_1x"] - got[1]["net_2x"] == pytest.approx(0.001)
    assert got[2]["active"] == 0 and got[2]["net_1x"] is None and rng


def test_classes_of_planted_vectors(spark):
    rng = random.Random(4)
    rows = [(float(i % 3), "test" if i % 5 == 0 else "train", [rng.gauss(4.0 if j == i % 3 else 0.0, 1.0) for j in range(6)]) for i in range(600)]
    table = spark.createDataFrame(rows, "label double, split string, v array<double>")
    ready = VectorAssembler(inputCols=[f"c{j}" for j in range(6)], outputCol="x").transform(table.select("label", "split", *[F.col("v")[j].alias(f"c{j}") for j in range(6)]))
    got = ml.classes(ready, [1, 2], [6, 5, 3]).collect()
    assert len(got) == 4 and all(r["n"] == 120 and r["accuracy"] > 0.9 and r["macro_f1"] > 0.9 for r in got)


def test_isotonic_calibration_pools_violators(spark):
    """Fitted on VALID alone; the pooled rates are known by hand."""
    valid = spark.createDataFrame([(0.1, -1.0), (0.2, 1.0), (0.3, -1.0), (0.4, 1.0), (0.4, 1.0)], "p double, target double")
    rows = spark.createDataFrame([(0.0, 1.0), (0.1, 1.0), (0.25, 1.0), (0.35, 1.0), (0.9, 1.0)], "p double, target double")
    got = [r["calibrated"] for r in ml.calibrated(valid, rows).orderBy("p").collect()]
    assert got == [pytest.approx(v) for v in (0.0, 0.0, 0.5, 0.75, 1.0)]


def test_features_see_nothing_that_comes_later(spark):
    rng = random.Random(5)
    rows, price = [], 100.0
    for i in range(420):
        price *= math.exp(rng.gauss(0, 0.01))
        rows.append(("a", i * H, price, price * 1.01, price * 0.99, price * 1.001, 5.0 + i % 7, 500.0 + i, 3 + i % 5, 2.0, 200.0))
    bars = spark.createDataFrame([r for r in rows if r[1] // H not in (50, 51, 300)], "symbol string, open_time long, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double")
    found = features.causality(bars, H, 350 * H).collect()
    assert {r["name"] for r in found} == set(features.names()) and {(r["n"], r["different"]) for r in found} == {(347, 0)}
    features.feature("ahead", 1)(lambda step: F.lead("close").over(features.ts.over()))
    try:
        assert {r["name"]: r["different"] for r in features.causality(bars, H, 350 * H, ["return_1", "ahead"]).collect()} == {"return_1": 0, "ahead": 1}
    finally:
        del features.REGISTRY["ahead"]


def test_splits_keep_the_embargo(spark):
    good = [("train", 0, 10), ("valid", 12, 20)]
    clock.check_splits(good, 2)
    for splits, embargo in ((good, 3), ([("a", 5, 5)], 0), ([("b", 10, 20), ("a", 0, 5)], 0)):
        with pytest.raises(ValueError):
            clock.check_splits(splits, embargo)
    rows = spark.createDataFrame([(0, 1), (9, 1), (9, 3), (11, 1), (12, 2)], "open_time long, reach long")
    got = [(r["split"], r["refused"], r["usable"]) for r in clock.windows(rows, good, F.col("reach"), 2).orderBy("open_time", "reach").collect()]
    assert got == [("train", False, True), ("train", False, False), ("train", True, False), ("outside", False, False), ("valid", False, True)]


def test_versions_that_exist_are_refused(spark):
    known = spark.createDataFrame([("x", 1), ("x", 2)], "id string, version long")
    asked = spark.createDataFrame([("x", None), ("x", 2), ("x", 3), ("x", 9), ("y", None), ("y", 1), ("y", 2)], "id string, version long")
    got = sorted((r["id"], r["version"], r["refused"] or "") for r in registry.register(known, asked).collect())
    assert got == [("x", 2, "exists"), ("x", 3, ""), ("x", 3, ""), ("x", 9, "not the next"), ("y", 1, ""), ("y", 1, ""), ("y", 2, "not the next")]


def test_sizing_in_decimals(spark):
    rows = spark.createDataFrame([(0.123, 7.0, 0), (-0.123, 7.0, 0), (0.1, 10.0, 99), (None, 10.0, 0), (1.0, 3.0, -5)], "s double, price double, held int")
    target = sizing.target_notional(F.col("s"), 100_000, 0.1)
    got = rows.select(target.cast("double"), sizing.rebalance(target, F.col("price"), F.col("held"), 100_000, 0.0005).cast("long")).collect()
    assert [tuple(r) for r in got] == [(1230.0, 175), (-1230.0, -175), (1000.0, 0), (None, None), (10000.0, 3338)]


def test_monthly_stability_counts_defined_months_only(spark):
    rows = spark.createDataFrame([("a", "jan", 0.01), ("a", "jan", 0.03), ("a", "feb", -0.01), ("a", "feb", -0.02), ("a", "mar", 0.01), ("b", "jan", 0.01)], "symbol string, m string, net double")
    got = {r["symbol"]: r for r in pnl.stability(rows, "net", 1.0, ["symbol"], "m").collect()}
    jan, feb = 0.02 / math.sqrt(0.0002), -0.015 / math.sqrt(0.00005)
    assert got["a"]["defined"] == 2 and got["a"]["mean"] == pytest.approx((jan + feb) / 2) and got["a"]["least"] == pytest.approx(feb) and got["a"]["positive"] == 0.5
    assert got["b"]["defined"] == 0 and got["b"]["mean"] is None and got["b"]["positive"] is None


def test_regimes_of_unknown_volatility(spark):
    rows = spark.createDataFrame([("a", v, 1.0, 2.0) for v in (None, 0.5, 1.0, 1.5, 2.5)] + [("a", 1.0, None, None)], "symbol string, v double, q1 double, q2 double")
    assert [r["regime"] for r in gates.regimes(rows, "v").collect()] == ["unknown", "low", "low", "mid", "high", "unknown"]
