"""Boundary rules of the bar library on tiny literal inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from barloom import schema
from barloom.functions import clock, ts
from barloom.operators import cross_section, features, gates, ml, pnl, quality, registry, resample
from barloom.sources import readers, stores

H = ts.HOUR


def series(spark, values, step=H, symbol="a", skip=()):
    rows = [(symbol, i * step, float(v) if v is not None else None) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "symbol string, open_time long, x double")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("open_time").collect()]


def test_zscore_and_rank_examples(spark):
    rows = series(spark, [1, 2, 3, 4])
    assert column(rows.withColumn("v", ts.zscore(F.col("x"), 4, H)))[-1] == pytest.approx(1.161895, abs=1e-6)
    rows = series(spark, [1, 2, 2, 4])
    assert column(rows.withColumn("v", ts.rank(F.col("x"), 3, H)))[2] == pytest.approx(2.5 / 3)


def test_constant_window_has_no_zscore_and_short_windows_are_unknown(spark):
    got = column(series(spark, [7, 7, 7, 8]).withColumn("v", ts.zscore(F.col("x"), 3)))
    assert got[:3] == [None, None, None] and got[3] is not None


def test_windows_never_cross_a_gap_or_a_null(spark):
    assert column(series(spark, range(8), skip=(3,)).withColumn("v", ts.mean(F.col("x"), 2, H))) == [None, 0.5, 1.5, None, 4.5, 5.5, 6.5]
    assert column(series(spark, [1, None, 3, 4]).withColumn("v", ts.mean(F.col("x"), 2, H))) == [None, None, None, 3.5]


def test_argument_rules(spark):
    x = F.col("x")
    for bad in (lambda: ts.mean(x, 0), lambda: ts.std(x, 1), lambda: ts.lag(x, -1), lambda: ts.clip(x, 1, 0)):
        with pytest.raises(ValueError):
            bad()


def test_choice_and_clip_of_unknown(spark):
    rows = spark.createDataFrame([(None, 1.0, 2.0), (1.0, None, 2.0), (0.0, 1.0, None), (0.0, 1.0, 5.0)], "c double, a double, b double")
    got = rows.select(ts.choose(F.col("c"), F.col("a"), F.col("b")).alias("v"), ts.clip(F.col("b"), 0, 3).alias("w")).collect()
    assert [r["v"] for r in got] == [None, None, None, 5.0] and [r["w"] for r in got] == [2.0, 2.0, None, 3.0]


def test_numbers_are_finite(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "t string")
    assert [r[0] for r in rows.select(ts.number(F.col("t"))).collect()] == [1.5, None, None, None, None]


def test_positions_flat_then_unknown(spark):
    rows = spark.createDataFrame([("a", i * H, 10.0 + i, s) for i, s in enumerate([None, 0.5, None, -2.0, 1.0])], "symbol string, open_time long, close double, signal double")
    out = pnl.costs(pnl.positions(rows, H), F.lit(100.0)).orderBy("open_time").collect()
    assert [r["position"] for r in out] == [0.0, 0.5, None, -1.0, 1.0]
    assert [r["held"] for r in out] == [None, 0.0, 0.5, None, -1.0]
    assert [r["turnover"] for r in out] == [0.0, 0.5, None, None, 2.0]
    assert out[1]["gross"] == 0.0 and out[1]["net"] == pytest.approx(-0.005)


def test_metrics_of_tiny_and_constant_returns(spark):
    rows = spark.createDataFrame([("a", 1e-200), ("a", 2e-200), ("b", 0.0), ("b", 0.0), ("c", 1.0)], "symbol string, net double")
    got = {r["symbol"]: r for r in pnl.return_metrics(rows, "net", 100.0).collect()}
    assert got["a"]["sharpe"] == pytest.approx(1.5e-200 / 0.7071067811865476e-200)
    assert got["b"]["sharpe"] is None and got["c"]["vol"] is None


def test_drawdown(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([-1.0, 2.0, -3.0, 1.0])], "symbol string, open_time long, net double")
    out = pnl.drawdown(rows, "net", 1).orderBy("open_time").collect()
    assert [r["drop"] for r in out] == [1.0, 0.0, 3.0, 2.0] and [r["underwater"] for r in out] == [1, 0, 1, 2]


def test_correlation_of_constants_is_unknown(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 1.0, 5.0), ("b", 2.0, 6.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: r["corr"] for r in pnl.correlation(rows, "x", "y", ["k"]).collect()}
    assert got == {"a": None, "b": 1.0, "c": None}


def bars(spark, n=48, skip=(), symbol="a"):
    rows = [(symbol, i * H, 1.0 + i, 3.0 + i, 0.5 + i, 2.0 + i, 5.0, i * H + H - 1, 10.0, 3, 2.0, 4.0) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, schema.BAR)


def test_resample_keeps_complete_periods_only(spark):
    out = resample.resample(bars(spark, skip=(30,)), H, 24 * H).collect()
    assert len(out) == 1 and out[0]["open"] == 1.0 and out[0]["close"] == 25.0 and out[0]["high"] == 26.0 and out[0]["volume"] == 120.0
    with pytest.raises(ValueError):
        resample.resample(bars(spark), 7, 24)


def test_quality_rules(spark):
    b = bars(spark, 6, skip=(2, 3)).withColumn("high", F.when(F.col("open_time") == 0, F.lit(None).cast("double")).otherwise(F.col("high")))
    bad = quality.validate(b).collect()
    assert len(bad) == 1 and "price not above zero" in bad[0]["problem"] and "high below low" in bad[0]["problem"]
    gap = quality.gaps(b, H).collect()
    assert [(r["gap_start"], r["gap_end"], r["missing"]) for r in gap] == [(2 * H, 3 * H, 2)]
    assert quality.duplicates(b.unionByName(b.limit(1)), "symbol", "open_time").count() == 2
    assert quality.off_grid(spark.createDataFrame([(H + 1,), (-H,)], "open_time long"), H).count() == 1
    times = spark.createDataFrame([(1_704_067_200_000,), (1_704_067_200_000_000,), (5,)], "t long")
    assert [r[0] for r in times.select(quality.clock_micros(F.col("t"))).collect()] == [1_704_067_200_000_000] * 2 + [None]


def test_cross_section_needs_all_listed(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, 3.0), ("a", 1, 1.0), ("b", 1, None)], "symbol string, open_time long, x double")
    got = {(r["symbol"], r["open_time"]): r["value"] for r in cross_section.rank(rows, "x").collect()}
    assert got == {("a", 0): 0.5, ("b", 0): 0.5, ("c", 0): 1.0, ("a", 1): None, ("b", 1): None}


def test_features_are_causal_and_masked(spark):
    b = bars(spark, 60)
    names = ["return_6", "volatility_24", "parkinson_24", "hour_sin"]
    cut = features.build(b.where(F.col("open_time") < 40 * H), H, names).collect()
    whole = {r["open_time"]: r for r in features.build(b, H, names).collect()}
    assert all(tuple(r) == tuple(whole[r["open_time"]]) for r in cut)
    assert whole[5 * H]["return_6"] is None and whole[6 * H]["return_6"] is not None
    masked = features.with_masks(features.build(b, H, names)).where(F.col("open_time") == 0).first()
    assert masked["available__return_6"] is False and masked["available__hour_sin"] is True
    assert features.longest() == 169
    with pytest.raises(ValueError):
        features.feature("return_6", 7)(lambda step: F.lit(1))


def test_gate_status(spark):
    kind = "id string, split string, sharpe double, fitness double, turnover double, positive double, stress double"
    rows = [
        ("good", "valid", 2.0, 1.5, 0.2, 0.6, 0.1),
        ("edges", "test", 1.0, 1.0, 0.7, 0.5, 0.0),  # every comparison is strict
        ("train", "train", 2.0, 1.5, 0.2, 0.6, 0.1),
        ("unknown", "valid", None, None, None, None, None),
    ]
    decided = gates.decisions(spark.createDataFrame(rows, kind))
    got = {r["id"]: (r["status"], r["failed"]) for r in gates.status(decided, ["id"]).collect()}
    assert got == {"good": ("EVALUATED", ""), "edges": ("REJECTED", "G1,G2,G3,G5,G6"), "train": ("REJECTED", "G4"), "unknown": ("REJECTED", "G1,G2,G3,G5,G6")}
    reasons = {(r["id"], r["gate"]): r["reason"] for r in decided.collect()}
    assert reasons["edges", "G3"] == "threshold_not_met" and reasons["unknown", "G1"] == "unavailable" and reasons["train", "G4"] == "in_sample" and reasons["good", "G1"] is None


def test_registry_tables(spark):
    old = spark.createDataFrame([("x", 1), ("x", 2)], "id string, version int")
    new = registry.append_version(old, spark.createDataFrame([("x",), ("y",)], "id string"))
    assert {r["id"]: r["version"] for r in new.collect()} == {"x": 3, "y": 1}
    up = registry.upsert(spark.createDataFrame([("x", 1), ("z", 1)], "id string, v int"), spark.createDataFrame([("x", 9)], "id string, v int"), ["id"])
    assert {r["id"]: r["v"] for r in up.collect()} == {"x": 9, "z": 1}
    assert registry.insert_absent(old, spark.createDataFrame([("x", 1), ("q", 1)], "id string, version int"), "id").count() == 1


def test_clock():
    assert clock.to_micros("2024-01-01") == 1_704_067_200_000_000 and clock.to_micros("2024-01-01", end=True) == 1_704_153_599_999_999
    assert clock.to_micros("2024-01-01T00:00:01") == 1_704_067_201_000_000 and clock.to_micros(5) == 5
    with pytest.raises(TypeError):
        clock.to_micros(True)


def test_split_purges_a_label_at_the_edge(spark):
    rows = spark.createDataFrame([(0, 5), (1, 10), (10, 12), (99, 100)], "open_time long, done long")
    got = [(r["split"], r["fate"]) for r in clock.assign(rows, [("train", 0, 10), ("valid", 10, 20)], "done").orderBy("open_time").collect()]
    assert got == [("train", "kept"), ("train", "purged"), ("valid", "kept"), ("outside", "outside")]


def test_store_round_trip_and_pruning(spark, tmp_path):
    year = 366 * 24
    rows = bars(spark, 2).unionByName(bars(spark, 2).withColumn("open_time", F.col("open_time") + F.lit(year * H)))
    path = str(tmp_path / "bars")
    stores.write_bars(rows, path)
    got = stores.load_bars(spark, path, ["a"], 0, 10 * H)
    assert got.count() == 2 and "PartitionFilters: [" in got._jdf.queryExecution().toString() and "year" in got._jdf.queryExecution().toString()
    assert stores.inventory(spark, path).count() == 2 and stores.symbols(spark, path).count() == 1
    stores.write_features(features.build(rows, H, ["hour_sin", "return_1"]), str(tmp_path / "f"))
    assert stores.load_features(spark, str(tmp_path / "f"), ["return_1"]).columns == ["symbol", "open_time", "return_1", "available__return_1"]
    stores.export_csv(rows.limit(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    with pytest.raises(ValueError):
        schema.require(rows.drop("close"), schema.BAR)


def test_zipped_klines(spark, tmp_path):
    line = "1704067200000,1,2,0.5,1.5,10,1704067259999,15,3,4,6,0\n"
    for name, members in (("good", ["a.csv"]), ("bad", ["a.csv", "b.csv"])):
        (tmp_path / name).mkdir()
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for m in members:
                z.writestr(m, line * 3)
        (tmp_path / name / "x.zip").write_bytes(data.getvalue())
    rows = readers.read_zipped_klines(spark, str(tmp_path / "good")).collect()
    assert len(rows) == 3 and rows[0]["trades"] == 3 and rows[0]["file"] == "x.zip"
    with pytest.raises(Exception, match="one file"):
        readers.read_zipped_klines(spark, str(tmp_path / "bad")).collect()


def test_charts(spark):
    docs = spark.createDataFrame([("a", '{"t":[1,2,3],"o":[1,1,5],"h":[2,2,2],"l":[0.5,0.5,0.5],"c":[1,null,1],"v":[1,1,1]}')], "symbol string, body string")
    assert [r["reject_reason"] for r in readers.parse_chart(docs, "body").orderBy("t").collect()] == [None, "missing value", "inconsistent prices"]


def test_interpolation_is_flat_beyond_its_ends(spark):
    from barloom.operators import calibrate

    rows = spark.createDataFrame([(-1.0,), (0.0,), (0.25,), (1.0,), (3.0,), (float("nan"),), (None,)], "p double")
    got = [r[0] for r in rows.select(calibrate.interpolate(rows.p, [(0.0, 1.0), (0.5, 3.0), (1.0, 3.5)])).collect()]
    assert got == [1.0, 1.0, 2.0, 3.5, 3.5, None, None]
    for points in ([], [(0.0, 1.0), (0.0, 2.0)], [(0.0, float("nan"))]):
        with pytest.raises(ValueError):
            calibrate.interpolate(rows.p, points)


def test_auc_matches_pairs(spark):
    import random

    from barloom.operators import reports

    rng = random.Random(3)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(200)]
    got = reports.auc(spark.createDataFrame(rows, "p double, y int"), parts=7).first()[0]
    up, down = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
    assert abs(got - want) < 1e-12


def test_files_that_are_refused(spark, tmp_path):
    from barloom.sources import stores

    rows = spark.createDataFrame([("C1", "IN0000000017"), ("C1", "bad")], "symbol string, isin string")
    assert tuple(readers.check_roster(rows, 2).first()) == (2, 0, 1, 1, 0, False)
    assert stores.write_once(rows, str(tmp_path / "x")) and not stores.write_once(rows, str(tmp_path / "x"))
    eod = spark.createDataFrame([("2024-01-01", "A", "I", "EQ", 1.0, 1.0, 1.0, 5.0), ("2024-01-01", "B", "J", "BE", 1.0, 1.0, 1.0, 5.0)], "day string, symbol string, isin string, series string, high double, low double, close double, volume double")
    assert [r["symbol"] for r in readers.parse_eod(readers.pack_eod(eod)).collect()] == ["A"]


def test_exact_charges_of_one_round_trip(spark):
    from barloom.operators import ledger

    day = "2025-05-05"
    trades = spark.createDataFrame([(day, "b", "S", True, 100.0, 500.0), (day, "s", "S", False, 100.0, 510.0)], "day string, order_id string, security string, buy boolean, quantity double, price double")
    got = ledger.charges(trades).first()
    brokerage, turnover = 15.0 + 15.3, 101_000.0
    assert abs(got["brokerage"] - brokerage) < 1e-9 and got["tax"] == 13.0 and got["flat"]
    total = got["brokerage"] + got["exchange"] + got["fund"] + got["regulator"] + got["service"] + got["stamp"] + got["tax"]
    one = spark.range(1).select(ledger.round_trip_fees(*[ledger.F.lit(x) for x in (100.0, 500.0, 510.0)], ledger.F.lit(day))).first()[0]
    assert abs(total - one) < 1e-9 and abs(got["exchange"] - turnover * 297e-7) < 1e-9


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=80)
    rows = spark.createDataFrame([("train", *map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "split string, a double, b double, target double")
    model = ml.ridge(ml.standardised(rows, ["a", "b"]), 3.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.solve(z.T @ z + 3.0 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-8)


def test_entry_works_without_the_optional_package(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    names = entry.queries()
    assert "G-08" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
    assert set(entry.oracle_sql()) <= set(names)


def test_windows_over_pieces_equal_windows_over_whole_series(spark):
    """A long series is spread over several tasks, with gaps at and around the edges of pieces, and no value changes."""
    b = bars(spark, 900, skip=(49, 50, 99, 133, 300, 301, 450))
    names = ["return_1", "return_24", "distance_48", "volatility_24", "parkinson_24", "volume_z_168", "hour_sin"]
    whole = {tuple(r)[:2]: tuple(r)[2:] for r in features.build(b, H, names, chunk=10_000).collect()}
    pieces = features.build(b, H, names, chunk=169)
    cut = {tuple(r)[:2]: tuple(r)[2:] for r in pieces.collect()}
    assert set(whole) == set(cut) and len(cut) == b.count()
    for key, values in whole.items():
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(values, cut[key], strict=True)), key
    assert sum(v[1] is not None for v in cut.values()) > 300
