"""Scans over pieces against whole-series windows and exact folds."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import scan, ts
from barloom.operators import gates, joins, ledger, pnl, quality, sessions
from barloom.sources import stores

H = 3_600_000_000


@pytest.fixture(scope="module")
def gappy(spark):
    """Two series with gaps (one of more than a piece), unknown values and a null key."""
    rng = random.Random(4)
    rows = []
    for symbol in ("a", "b", None):
        rows += [(symbol, t * H, rng.choice([None, -2.0, -1.0, 0.5, 1.0, 3.0]), float(rng.randint(1, 9))) for t in range(-30, 200) if rng.random() < 0.8 and not 60 <= t < 110]
    return spark.createDataFrame(rows, "symbol string, open_time long, x double, close double").repartition(5).cache()


def test_scans_equal_whole_windows(gappy):
    w = Window.partitionBy("symbol").orderBy("open_time")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x, top = F.col("x"), F.struct("x", "open_time")
    want = gappy.withColumns({"s": F.sum(x).over(upto), "m": F.max(x).over(upto), "t": F.max(F.when(x.isNotNull(), top)).over(upto), "l": F.last(x, True).over(upto), "p": F.lag(x).over(w), "q": F.lag("open_time").over(w)})
    for bars in (1, 7, 24, 10_000):
        got = scan.scanned(gappy, ["symbol"], scan.by_time(H, bars), ["open_time"], sums={"s": x}, maxima={"m": x, "t": F.when(x.isNotNull(), top)}, lasts={"l": x}, before={"p": x, "q": F.col("open_time")})
        assert quality.same_rows(got.select(*want.columns), want).first()["same"], bars


def test_pieces_by_rows_split_a_hot_key(spark):
    rows = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") < 9000, F.col("id") % 50).otherwise(F.col("id")).alias("t"))
    sizes = [r["count"] for r in rows.groupBy(scan.by_rows(rows, "t", 500).alias("p")).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1500
    assert rows.limit(0).groupBy(scan.by_rows(rows.limit(0), "t").alias("p")).count().count() == 0


def test_drawdowns_over_pieces(gappy, monkeypatch):
    w = Window.partitionBy("symbol").orderBy("open_time")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = gappy.where("x is not null").withColumns({"cum": F.sum("x").over(upto), "rn": F.row_number().over(w)})
    rows = rows.withColumn("peak", F.greatest(F.max("cum").over(upto), F.lit(0.0)))
    rows = rows.withColumn("at", F.last(F.when(F.col("cum") >= F.col("peak"), F.col("rn")), True).over(upto))
    want = rows.select("symbol", "open_time", "cum", "peak", (F.col("peak") - F.col("cum")).alias("drop"), (F.col("rn") - F.coalesce("at", F.lit(0))).cast("long").alias("underwater"))
    for bars in (5, 24):
        monkeypatch.setattr(scan.by_time, "__defaults__", (bars, "open_time"))
        got = pnl.drawdown(gappy, "x", H).select(*want.columns)
        assert quality.same_rows(got, want).first()["same"]
        curve = pnl.below_peak(gappy, "close", H).select("symbol", "open_time", "drawdown")
        assert quality.same_rows(curve, gappy.select("symbol", "open_time", (F.col("close") / F.max("close").over(upto) - 1).alias("drawdown"))).first()["same"]


def test_gaps_segments_and_positions_over_pieces(gappy, monkeypatch):
    def outcomes():
        signal = gappy.where("symbol is not null").withColumn("signal", F.when(F.col("open_time") > 20 * H, F.col("x") / 4))
        return [quality.gaps(gappy, H), sessions.segments(gappy, H), pnl.positions(signal, H), pnl.positions(signal, H, 3)]

    monkeypatch.setattr(scan.by_time, "__defaults__", (10_000, "open_time"))
    want = [stores.settle(x) for x in outcomes()]
    monkeypatch.setattr(scan.by_time, "__defaults__", (6, "open_time"))
    for got, expected in zip(outcomes(), want, strict=True):
        assert expected.count() > 0 and quality.same_rows(got.select(*expected.columns), expected).first()["same"]


def test_as_of_takes_a_reference_many_pieces_old(spark):
    rows = spark.createDataFrame([("a", t * H) for t in (0, 5, 50, 500)] + [("b", 3 * H)], "symbol string, open_time long")
    known = spark.createDataFrame([("a", 5 * H, 1.0), ("a", 6 * H, None), ("a", 400 * H, 2.0), ("b", 4 * H, 9.0)], "symbol string, open_time long, v double")
    got = {(r["symbol"], r["open_time"] // H): r["v"] for r in joins.as_of(rows, known, "v", 10 * H).collect()}
    assert got == {("a", 0): None, ("a", 5): 1.0, ("a", 50): 1.0, ("a", 500): 2.0, ("b", 3): None}


def fold(fills):
    """Exact average cost, one fill after the other: rows of quantity, average, gain."""
    q = a = Decimal(0)
    for signed, price in fills:
        s, p = Decimal(repr(signed)), Decimal(repr(price))
        gain, now = Decimal(0), q + s
        if s == 0:
            pass
        elif q == 0 or (q > 0) == (s > 0):
            a = (a * abs(q) + p * abs(s)) / (abs(q) + abs(s))
        else:
            gain = min(abs(s), abs(q)) * (p - a) * (1 if q > 0 else -1)
            a = Decimal(0) if now == 0 else a if (now > 0) == (q > 0) else p
        q = now
        yield float(q), float(a), float(gain)


def test_average_cost_through_zero(spark):
    fills = spark.createDataFrame([(1, t, i, float(s), float(x)) for t, i, s, x in ((1, 1, 10, 100), (2, 2, 5, 106), (3, 3, -20, 110), (3, 3, -20, 110))], "user_id long, t long, event_id long, signed double, price double")
    assert tuple(ledger.book(fills, "user_id", 10.0).first()) == (1, -5.0, pytest.approx(110.0), pytest.approx(120.0), pytest.approx(3.73))
    broken = fills.union(spark.createDataFrame([(1, 3, 3, -20.0, 111.0)], fills.schema))
    with pytest.raises(Exception, match="conflicting reports of fill 1/3"):
        ledger.book(broken, "user_id", 10.0).collect()


@pytest.mark.parametrize("piece_rows", [1, 1_000_000])
def test_books_of_three_hand_checked_trades(spark, piece_rows):
    """Two purchases and a sale through zero, at 10 basis points."""
    fills = spark.createDataFrame([(1, 1, 1, 1.0, 100.02), (1, 4, 2, 1.0, 120.024), (1, 7, 3, -3.0, 109.978)], "account long, t long, event_id long, signed double, price double")
    rows = ledger.replayed(fills, "account", 10.0, piece_rows).orderBy("t").collect()
    want = [(1.0, 100.02, 0.0, -100.02, 0.10002), (2.0, 110.022, 0.0, -220.044, 0.220044), (-1.0, 109.978, -0.088, 109.89, 0.549978)]
    for row, expected in zip(rows, want, strict=True):
        assert [row[c] for c in ("quantity", "average", "realised", "cash", "fees")] == [pytest.approx(v, abs=1e-9) for v in expected]


@pytest.mark.parametrize("piece_rows", [40, 1_000_000])
def test_average_cost_equals_the_exact_fold(spark, piece_rows):
    """A churning account (weights beyond the range of doubles), one that crosses zero often, ties in time, zero fills."""
    rng = random.Random(6)
    accounts = {
        1: [(1.0, 10.0)] + [(v, round(rng.uniform(5, 20), 2)) for _ in range(700) for v in (3.0, -3.0)],
        2: [(float(rng.choice([-3, -1, 0, 1, 2])), round(rng.uniform(90, 110), 2)) for _ in range(300)],
        3: [(0.1, 3.0), (0.2, 4.0), (-0.3, 5.0), (0.7, 2.0)],
        4: [(-2.5, 7.0)],
    }
    rows = [(a, i // 2, i, s, p) for a, fills in accounts.items() for i, (s, p) in enumerate(fills)]
    table = spark.createDataFrame(rows, "account long, t long, event_id long, signed double, price double").repartition(4)
    got = {(r["account"], r["event_id"]): r for r in ledger.progress(table, "account", piece_rows).collect()}
    assert len(got) == len(rows)
    for a, fills in accounts.items():
        for i, (q, average, gain) in enumerate(fold(fills)):
            r = got[a, i]
            assert r["quantity"] == q and r["average"] == pytest.approx(average, rel=1e-9, abs=1e-9) and r["gain"] == pytest.approx(gain, rel=1e-9, abs=1e-7)


def test_quantiles_equal_sorted_values(spark):
    rng = random.Random(8)
    values = {"wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(500)], "ties": [float(rng.randint(0, 3)) for _ in range(400)], "one": [5.0] * 9, "two": [1.0, 2.0], "same": [0.1 + 1e-15 * i for i in range(50)], "ends": [1.7e308, -1.7e308, 0.0, 1.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "symbol string, v double").repartition(6)
    got = {r["symbol"]: r for r in gates.quantiles(rows, "symbol", "v", {"a": (1, 3), "b": (2, 3), "c": (0, 1), "d": (1, 1)}).collect()}
    for k, vs in values.items():
        for name, (a, b) in {"a": (1, 3), "b": (2, 3), "c": (0, 1), "d": (1, 1)}.items():
            s, n = sorted(vs), len(vs)
            low, share = (n - 1) * a // b, ((n - 1) * a % b) / b
            assert got[k][name] == s[low] + (s[min(low + 1, n - 1)] - s[low]) * share, (k, name)
        assert got[k]["distinct"] == min(3, len(set(vs)))
    assert gates.quantiles(rows.limit(0), "symbol", "v", {"a": (1, 2)}).count() == 0


def test_ranks_of_long_windows():
    rng = np.random.default_rng(2)
    x, t = rng.integers(0, 400, 13_000).astype(float), np.arange(13_000) * H
    x[11_900] = np.nan
    got = ts.window_ranks(x, t, 10_000, H)
    for i in (9_998, 9_999, 10_000, 10_500, 11_899, 11_900, 12_999):
        w = x[max(0, i - 9_999) : i + 1]
        want = ((w < x[i]).sum() + ((w == x[i]).sum() + 1) / 2) / 10_000 if len(w) == 10_000 and not np.isnan(w).any() else np.nan
        assert got[i] == want or np.isnan(got[i]) and np.isnan(want)


def test_ranks_over_pieces_equal_collected_frames(gappy):
    known = gappy.where("symbol is not null")
    for n in (1, 5, 12):
        want = known.select("symbol", "open_time", F.col("close"), ts.rank(F.col("close"), n, H).alias("value"))
        got = ts.ranked(known.select("symbol", "open_time", "close"), "close", n, H, chunk=20)
        assert quality.same_rows(got.select(*want.columns), want).first()["same"]


def test_pairs_without_a_join(spark):
    rng = random.Random(3)
    rows = [(f"k{a}", d, 2.0 if a == 7 else rng.gauss(1000, 1)) for a in range(12) for d in range(120) if rng.random() < 0.7]
    table = spark.createDataFrame(rows, "k string, d long, v double").repartition(5)
    got = {(r["one"], r["two"]): r for r in pnl.pair_correlations(table, "k", "d", "v", 50, block=3, days=16).collect()}
    series = {}
    for k, d, v in rows:
        series.setdefault(k, {})[d] = v
    names = sorted(series)
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = sorted(series[a].keys() & series[b].keys())
            if len(shared) >= 50:
                x, y = ([series[k][d] for d in shared] for k in (a, b))
                want[a, b] = (len(shared), None if "k7" in (a, b) else np.corrcoef(x, y)[0, 1])
    assert got.keys() == want.keys() and len(want) > 40
    for pair, (n, corr) in want.items():
        assert got[pair]["n"] == n and got[pair]["corr"] == (None if corr is None else pytest.approx(corr, abs=1e-9))


def test_feature_partitions(spark, tmp_path):
    year = 366 * 24 * H
    frame = spark.createDataFrame([(s, y * year + i * H, float(i)) for s in ("a", "b") for y in (0, 1) for i in range(3)], "symbol string, open_time long, f double")
    path = str(tmp_path / "features")
    stores.write_features(frame, path)
    held = lambda: {r[0] for r in spark.read.parquet(path).where("symbol = 'b'").select("_metadata.file_path").distinct().collect()}
    files = held()
    with pytest.raises(ValueError, match="stale: a/1971"):
        stores.write_features(frame.where(f"symbol = 'a' and open_time < {year}"), path)
    stores.write_features(frame.where("symbol = 'a'").withColumn("f", F.col("f") + 10), path)
    assert {tuple(r) for r in spark.read.parquet(path).groupBy("symbol").agg(F.sum("f")).collect()} == {("a", 66.0), ("b", 6.0)}
    assert held() == files


def test_statistics_come_from_footers(spark, tmp_path):
    rows = spark.createDataFrame([(s, i * H, 1.0) for s in ("a", "b") for i in range(5)], "symbol string, open_time long, close double")
    path = str(tmp_path / "bars")
    stores.write_bars(rows, path)
    for keys in ([], ["symbol"], ["symbol", "year"]):
        found = stores.statistics(spark, path, *keys)
        assert "PushedAggregation: [COUNT(*), MIN(open_time), MAX(open_time)]" in found._jdf.queryExecution().toString()
        assert sorted(map(tuple, found.select("n", "first", "last").collect())) == sorted(map(tuple, rows.groupBy(*keys[:1]).agg(F.count("*"), F.min("open_time"), F.max("open_time")).select("count(1)", "min(open_time)", "max(open_time)").collect()))


def test_a_rewritten_table_is_told_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    before = stores.listing(spark.read.parquet(path))
    assert before == stores.listing(spark.read.parquet(path))
    spark.range(5).write.mode("overwrite").parquet(path)
    assert before != stores.listing(spark.read.parquet(path))
