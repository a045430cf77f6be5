"""Further queries: universes, masks, sizing, stores, selection and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import ts
from barloom.operators import features, pnl, quality, registry, sizing
from barloom.plans.base import DAY, HOUR, bars, query, r, sql, table
from barloom.plans.returns import YEAR
from barloom.sources import stores

_W = "(PARTITION BY symbol ORDER BY open_time)"


@query("P-03", sql("SELECT symbol, open_time, round(CASE WHEN volume > 1 THEN close END + CASE WHEN trades > 2 THEN open END, 6) AS value FROM h"))
def masked(spark, sf_dir):
    a, b = F.when(F.col("volume") > 1, F.col("close")), F.when(F.col("trades") > 2, F.col("open"))
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time", r(ts.finite(a + b), "value"))


@query("P-07", sql(f"SELECT symbol, count(*) FILTER (x IS NOT NULL) AS usable, round(avg((x IS NOT NULL)::INT), 6) AS share, min(open_time) FILTER (x IS NOT NULL) AS first FROM (SELECT symbol, open_time, CASE WHEN open_time - lag(open_time) OVER {_W} = {HOUR} THEN close END AS x FROM h) GROUP BY symbol"))
def usable(spark, sf_dir):
    rows = bars(spark, sf_dir, HOUR).withColumn("x", F.when(ts.contiguous(2, HOUR), F.col("close")))
    known = F.col("x").isNotNull()
    return rows.groupBy("symbol").agg(F.count_if(known).alias("usable"), F.round(F.avg(known.cast("int")), 6).alias("share"), F.min(F.when(known, F.col("open_time"))).alias("first"))


@query("P-08", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-01-01')")
def universe_on(spark, sf_dir):
    active = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.expr("timestamp_ntz'1996-01-01 00:00:00'"))
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(active, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("P-09", sql("SELECT max(first) AS first FROM (SELECT symbol, min(open_time) AS first FROM d GROUP BY symbol)"))
def full_universe(spark, sf_dir):
    return bars(spark, sf_dir, DAY).groupBy("symbol").agg(F.min("open_time").alias("first")).agg(F.max("first").alias("first"))


@query("P-14", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'strong' WHEN o_totalprice > 100000 THEN 'fair' ELSE 'weak' END AS label FROM orders")
def labels(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(p > 300000, "strong").when(p > 100000, "fair").otherwise("weak").alias("label"))


@query("P-16", sql(f"SELECT symbol, open_time FROM h WHERE open_time // {HOUR} % 5 = 0"))
def down_sampled(spark, sf_dir):
    return bars(spark, sf_dir, HOUR).where(F.expr(f"open_time div {HOUR}") % 5 == 0).select("symbol", "open_time")


@query("F-12", "SELECT strftime(m, '%Y-%m-%d') AS first, strftime(least(last_day(m), DATE '2024-04-10'), '%Y-%m-%d') AS last FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-04-30', INTERVAL 1 MONTH) t(m) WHERE m >= (SELECT date_trunc('month', min(ts)) FROM events)")
def months(spark, sf_dir):
    begin = bars(spark, sf_dir, DAY).agg(F.trunc(F.date_from_unix_date(F.expr(f"min(open_time) div {DAY}").cast("int")), "month").alias("b"))
    every = begin.select(F.explode(F.sequence("b", F.lit("2024-04-01").cast("date"), F.expr("interval 1 month"))).alias("m"))
    return every.select(F.col("m").cast("string").alias("first"), F.least(F.last_day("m"), F.lit("2024-04-10").cast("date")).cast("string").alias("last"))


CAPITAL, WEIGHT, THRESHOLD = 100_000, 0.1, 0.0005
_TARGET = f"""SELECT symbol, open_time, close, (close - open) / nullif(open, 0) AS s FROM h WHERE open > 0 AND close > 0"""


@query(
    "F-16",
    sql(
        f"""SELECT symbol, open_time, round(target, 6) + 0.0 AS target, (CASE WHEN abs(target / close - held) * close < {CAPITAL * THRESHOLD} THEN 0 ELSE sign(target / close - held) * floor(abs(target / close - held)) END)::BIGINT AS shares
        FROM (SELECT *, {CAPITAL} * {WEIGHT} * s AS target, (hash_free // 7)::DOUBLE AS held FROM (SELECT *, (open_time // {HOUR}) % 23 AS hash_free FROM t))""",
        t=_TARGET,
    ),
)
def sized(spark, sf_dir):
    """Target notional in decimals and the whole shares to trade towards it; a change below the threshold is not traded."""
    rows = bars(spark, sf_dir, HOUR).where("open > 0 and close > 0").withColumn("signal", ts.ratio(F.col("close") - F.col("open"), F.col("open")))
    rows = rows.withColumn("held", F.expr(f"(open_time div {HOUR}) % 23 div 7"))
    target = sizing.target_notional(F.col("signal"), CAPITAL, WEIGHT)
    out = rows.withColumn("target", target).withColumn("shares", sizing.rebalance(F.col("target"), F.col("close"), F.col("held"), CAPITAL, THRESHOLD))
    return out.select("symbol", "open_time", r(F.col("target").cast("double"), "target"), F.col("shares").cast("long").alias("shares"))


@query("Q-03", sql(f"SELECT symbol, open_time + {DAY} AS gap_start, nxt - {DAY} AS gap_end, (nxt - open_time) // {DAY} - 1 AS missing FROM (SELECT symbol, open_time, lead(open_time) OVER {_W} AS nxt FROM d WHERE volume >= 3 AND open_time // {DAY} % 4 <> 0) WHERE nxt - open_time > {DAY}"))
def daily_gaps(spark, sf_dir):
    return quality.gaps(bars(spark, sf_dir, DAY).where((F.col("volume") >= 3) & (F.expr(f"open_time div {DAY}") % 4 != 0)), DAY)


@query("W-15", sql(f"SELECT symbol, open_time, round(CASE WHEN lead(open_time) OVER {_W} // {DAY} = open_time // {DAY} THEN lead(close) OVER {_W} / nullif(lead(open) OVER {_W}, 0) - 1 END, 6) + 0.0 AS label FROM h"))
def next_bar(spark, sf_dir):
    w = ts.over()
    same = F.lead(F.expr(f"open_time div {DAY}")).over(w) == F.expr(f"open_time div {DAY}")
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time", r(F.when(same, ts.ratio(F.lead("close").over(w), F.lead("open").over(w)) - 1), "label"))


@query("T-04", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_evidence(spark, sf_dir):
    return registry.latest(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("T-06", sql("SELECT symbol, arg_max(open_time, open_time) AS open_time, arg_max(close, open_time) AS close FROM h GROUP BY symbol"))
def latest_bar(spark, sf_dir):
    last = bars(spark, sf_dir, HOUR).groupBy("symbol").agg(F.max("open_time").alias("last"), F.max_by("close", "open_time").alias("close"))
    return last.withColumnRenamed("last", "open_time")


@query("J-11", "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, n_name FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def registry_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    out = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1).cast("long")).alias("o_orderkey"), "n_name")


@query("J-14", sql(f"SELECT symbol, count(*) AS n, round(avg(x - y), 6) + 0.0 AS mean FROM (SELECT symbol, open_time, close AS x FROM d) JOIN (SELECT symbol, open_time // {DAY} * {DAY} AS open_time, avg(close) AS y FROM h GROUP BY ALL) USING (symbol, open_time) GROUP BY symbol"))
def common_days(spark, sf_dir):
    slow = bars(spark, sf_dir, DAY).select("symbol", "open_time", F.col("close").alias("x"))
    fast = bars(spark, sf_dir, HOUR).groupBy("symbol", (F.expr(f"open_time div {DAY}") * DAY).alias("open_time")).agg(F.avg("close").alias("y"))
    return slow.join(fast, ["symbol", "open_time"]).groupBy("symbol").agg(F.count("*").alias("n"), r(F.avg(F.col("x") - F.col("y")), "mean"))


@query(
    "G-01",
    """WITH top AS (SELECT o_custkey AS id, count(*) AS top FROM orders GROUP BY ALL),
      asked AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 2 END AS v FROM customer)
    SELECT id, coalesce(v, coalesce(top, 0) + 1)::BIGINT AS version, CASE WHEN v < coalesce(top, 0) + 1 THEN 'exists' WHEN v > coalesce(top, 0) + 1 THEN 'not the next' END AS refused FROM asked LEFT JOIN top USING (id)""",
)
def versions(spark, sf_dir):
    """Definitions that ask for the next version or name one; an existing one is refused."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.row_number().over(w).cast("long").alias("version"))
    kind = F.col("c_custkey") % 4
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(kind == 1, 1).when(kind == 2, 5).when(kind == 3, 2).alias("version"))
    return registry.register(known, asked).select("id", "version", "refused")


@query(
    "G-07",
    sql(
        f"SELECT signal_id, symbol, count(x) AS n, round(sum(x), 6) + 0.0 AS total FROM (SELECT signal_id, symbol, CASE WHEN rn > 1 THEN lag(s) OVER z END * CASE WHEN open_time - lag(open_time) OVER z = {HOUR} AND close > 0 AND lag(close) OVER z > 0 THEN close / lag(close) OVER z - 1 END AS x FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, symbol ORDER BY open_time) AS rn FROM (SELECT symbol, open_time, close, signal_id, CASE signal_id WHEN 'up' THEN 0.5 ELSE -0.5 END AS s FROM h CROSS JOIN (VALUES ('up'), ('down')) v(signal_id))) WINDOW z AS (PARTITION BY signal_id, symbol ORDER BY open_time)) GROUP BY ALL"
    ),
)
def many_signals(spark, sf_dir):
    rows = features.signals(bars(spark, sf_dir, HOUR), [("up", "0.5"), ("down", "-0.5")])
    out = pnl.return_metrics(pnl.positions(rows, HOUR, 1, 1.0, "signal_id", "symbol"), "gross", YEAR, "signal_id", "symbol")
    return out.select("signal_id", "symbol", "n", r("total", "total"))


@query("K-02", sql("SELECT symbol, open_time, round(CASE WHEN volume > 0 THEN taker_buy_base / volume END, 6) AS taker_ratio, volume > 0 AS available FROM h"))
def feature_store(spark, sf_dir):
    """A store of features written whole, and then one symbol's partitions again: the others stay as they are."""
    path = stores.shared_root(spark, "features")
    frame = stores.settle(features.build(bars(spark, sf_dir, HOUR), HOUR, ["taker_ratio"]))
    stores.write_features(frame.withColumn("taker_ratio", F.when(F.col("symbol") != "click", F.col("taker_ratio"))), path)
    stores.write_features(frame.where("symbol = 'click'"), path)
    return stores.load_features(spark, path, ["taker_ratio"]).select("symbol", "open_time", r("taker_ratio", "taker_ratio"), F.col("available__taker_ratio").alias("available"))


@query("A-36", sql("SELECT symbol, year(make_timestamp(open_time))::INT AS year, count(*) AS n, min(open_time) AS first, max(open_time) AS last FROM h GROUP BY ALL"))
def inventory(spark, sf_dir):
    """Rows, first and last time of every partition of a store, from the files' own statistics."""
    path = stores.session_store(spark, "bars", table(spark, sf_dir, "events"), lambda: bars(spark, sf_dir, HOUR))
    return stores.inventory(spark, path)
