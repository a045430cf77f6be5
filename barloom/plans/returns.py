"""P&L, metrics, information-coefficient and selection queries (W-22..26, A-*, G-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import ts
from barloom.operators import gates, joins, pnl, quality, reports, resample, sessions
from barloom.plans.base import DAY, HOUR, bars, query, r, sql, ticks

_W = "(PARTITION BY symbol ORDER BY open_time)"
_F12 = "(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
BPS = {"click": 5.0, "error": 8.0, "purchase": 10.0, "signup": 12.0, "view": 4.0}
YEAR = 24 * 365.0

_SIGNAL = f"SELECT *, least(greatest(CASE WHEN coalesce((open_time - lag(open_time, 11) OVER {_W} = 11 * {HOUR}) AND open_time % {HOUR} = 0, false) THEN (close - avg(close) OVER {_F12}) / nullif(stddev_samp(close) OVER {_F12}, 0) END / 3, -1.0), 1.0) AS signal FROM h"
_FIXED = "SELECT *, CASE WHEN (close - avg(close) OVER " + _F12 + ") IS NULL THEN NULL ELSE signal END AS sig FROM sg"
_POS = dict(
    sg=_SIGNAL,
    p0=f"SELECT *, row_number() OVER {_W} AS rn FROM (SELECT * REPLACE (CASE WHEN z IS NULL THEN NULL ELSE signal END AS signal) FROM (SELECT *, CASE WHEN coalesce((open_time - lag(open_time, 11) OVER {_W} = 11 * {HOUR}), false) AND stddev_samp(close) OVER {_F12} > 0 THEN 1 END AS z FROM sg))",
    p1="SELECT *, min(rn) FILTER (signal IS NOT NULL) OVER (PARTITION BY symbol) AS first FROM p0",
    p2="SELECT *, CASE WHEN first IS NULL OR rn < first THEN 0.0 ELSE signal END AS position FROM p1",
    p3=f"SELECT *, CASE WHEN rn > 1 THEN lag(position) OVER {_W} END AS held, CASE WHEN open_time - lag(open_time) OVER {_W} = {HOUR} AND close > 0 AND lag(close) OVER {_W} > 0 THEN close / lag(close) OVER {_W} - 1 END AS ret FROM p2",
    p4="SELECT *, held * ret AS gross, CASE WHEN rn = 1 THEN abs(position) ELSE abs(position - held) END AS turnover, CASE symbol WHEN 'click' THEN 5.0 WHEN 'error' THEN 8.0 WHEN 'purchase' THEN 10.0 WHEN 'signup' THEN 12.0 WHEN 'view' THEN 4.0 END AS bps FROM p3",
    p5="SELECT *, turnover * bps / 10000 AS cost, gross - turnover * bps / 10000 AS net FROM p4",
)


def z_signal(spark, sf_dir):
    return bars(spark, sf_dir, HOUR).withColumn("signal", ts.clip(ts.zscore(F.col("close"), 12, HOUR) / 3, -1.0, 1.0))


def bps():
    """Cost per symbol from a small fixed table."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in BPS.items() for x in kv]), F.col("symbol"))


def simulated(spark, sf_dir):
    return pnl.costs(pnl.positions(z_signal(spark, sf_dir), HOUR), bps())


@query("W-22", sql("SELECT symbol, open_time, round(position, 6) + 0.0 AS position FROM p2", **{k: _POS[k] for k in ("sg", "p0", "p1", "p2")}))
def lagged_positions(spark, sf_dir):
    return pnl.positions(z_signal(spark, sf_dir), HOUR).select("symbol", "open_time", r("position", "position"))


@query("W-23", sql("SELECT symbol, open_time, round(held, 6) + 0.0 AS held, round(ret, 6) + 0.0 AS ret, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover FROM p4", **{k: v for k, v in _POS.items() if k != "p5"}))
def period_returns(spark, sf_dir):
    return pnl.positions(z_signal(spark, sf_dir), HOUR).select("symbol", "open_time", *[r(c, c) for c in ("held", "ret", "gross", "turnover")])


@query("W-24", sql("SELECT symbol, open_time, round(cost, 8) + 0.0 AS cost, round(net, 6) + 0.0 AS net FROM p5", **_POS))
def net_returns(spark, sf_dir):
    return simulated(spark, sf_dir).select("symbol", "open_time", (F.round("cost", 8) + 0.0).alias("cost"), r("net", "net"))


@query("J-16", sql("SELECT symbol, open_time, bps FROM p4", **{k: v for k, v in _POS.items() if k != "p5"}))
def symbol_costs(spark, sf_dir):
    rates = spark.createDataFrame(list(BPS.items()), "symbol string, bps double")  # one row a symbol of the fee table
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time").join(joins.small(rates), "symbol")


_DD = dict(
    _POS,
    c0=f"SELECT symbol, open_time, net, sum(net) OVER {_W} AS cum, row_number() OVER {_W} AS n FROM p5 WHERE net IS NOT NULL",
    c1=f"SELECT *, greatest(max(cum) OVER {_W}, 0.0) AS peak FROM c0",
)


@query("W-25", sql("SELECT symbol, open_time, round(cum, 6) + 0.0 AS cum, round(peak, 6) + 0.0 AS peak, round(peak - cum, 6) + 0.0 AS drop FROM c1", **_DD))
def drawdowns(spark, sf_dir):
    return pnl.drawdown(simulated(spark, sf_dir), "net", HOUR).select("symbol", "open_time", *[r(c, c) for c in ("cum", "peak", "drop")])


@query("W-26", sql(f"SELECT symbol, open_time, round(close / max(close) OVER {_W} - 1, 6) + 0.0 AS drawdown FROM d"))
def equity_drawdown(spark, sf_dir):
    return pnl.below_peak(bars(spark, sf_dir, DAY), "close", DAY).select("symbol", "open_time", r("drawdown", "drawdown"))


_METRICS = "count(x) AS n, round(sum(x), 6) + 0.0 AS total, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS vol, round(avg(x) / nullif(stddev_samp(x), 0), 6) + 0.0 AS sharpe"
_ROUNDED = ["total", "mean", "vol", "sharpe"]


def _metrics(rows, value, *keys):
    return pnl.return_metrics(rows, value, YEAR, *keys).select(*keys, "n", *[r(c, c) for c in _ROUNDED])


@query("A-10", sql(f"SELECT symbol, {_METRICS} FROM (SELECT symbol, net AS x FROM p5) GROUP BY symbol", **_POS))
def metrics(spark, sf_dir):
    return _metrics(simulated(spark, sf_dir), "net", "symbol")


@query("G-08", sql(f"SELECT symbol, {_METRICS} FROM (SELECT symbol, CASE WHEN rn > 1 THEN net - CASE WHEN rn = 2 THEN lag(cost) OVER {_W} ELSE 0 END END AS x FROM p5) GROUP BY symbol", **_POS))
def evaluation(spark, sf_dir):
    """Bars, features, signal, positions, costs and metrics per symbol in one plan."""
    return _metrics(pnl.boundary(simulated(spark, sf_dir)), "net", "symbol")


@query("A-11", sql(f"SELECT symbol, open_time, round(CASE WHEN rn > 1 THEN net - CASE WHEN rn = 2 THEN lag(cost) OVER {_W} ELSE 0 END END, 6) + 0.0 AS net FROM p5", **_POS))
def entry_boundary(spark, sf_dir):
    return pnl.boundary(simulated(spark, sf_dir)).select("symbol", "open_time", r("net", "net"))


_DAYS = f"open_time // {DAY} * {DAY}"


@query("A-12", sql(f"SELECT symbol, {_DAYS} AS day, round(CASE WHEN count(turnover) = count(*) THEN sum(turnover) END, 6) AS turnover, round(CASE WHEN count(turnover) = count(*) THEN avg(turnover) END, 6) AS mean_turnover, round(CASE WHEN count(held) = count(*) AND count(ret) = count(*) THEN avg((sign(held) = sign(ret))::INT) END, 6) AS hit_rate FROM p5 GROUP BY ALL", **_POS))
def turnover(spark, sf_dir):
    """Turnover and hit rate of each symbol and day, unknown unless every period of it is known."""
    day = (F.expr(f"open_time div {DAY}") * DAY).alias("day")
    return pnl.diagnostics(simulated(spark, sf_dir), F.col("symbol"), day).select("symbol", "day", *[r(c, c) for c in ("turnover", "mean_turnover", "hit_rate")])


@query("A-20", sql(f"SELECT symbol, multiplier, {_METRICS} FROM (SELECT symbol, m AS multiplier, gross - turnover * bps * m / 10000 AS x FROM p4 CROSS JOIN (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0), (3.0)) v(m)) GROUP BY ALL", **_POS))
def cost_sweep(spark, sf_dir):
    rows = pnl.sweep(pnl.positions(z_signal(spark, sf_dir), HOUR), bps())
    return _metrics(rows, "net", "symbol", "multiplier")


@query("A-21", sql("SELECT symbol, round(sum(gross), 6) + 0.0 AS gross, round(sum(cost), 6) + 0.0 AS cost, round(sum(net), 6) + 0.0 AS net, round(sum(gross) / nullif(sum(turnover), 0) * 10000, 4) + 0.0 AS bps_per_turnover FROM p5 GROUP BY symbol", **_POS))
def edge_versus_cost(spark, sf_dir):
    per = ts.ratio(F.sum("gross"), F.sum("turnover")) * 10_000
    return simulated(spark, sf_dir).groupBy("symbol").agg(*[r(F.sum(c), c) for c in ("gross", "cost", "net")], (F.round(per, 4) + 0.0).alias("bps_per_turnover"))


_DAILY = dict(_POS, dy=f"SELECT symbol, open_time // {DAY} * {DAY} AS day, sum(net) AS total, count(net) AS n FROM p5 GROUP BY ALL")


@query("A-05", sql("SELECT symbol, day, round(total, 6) + 0.0 AS total, n, 24::BIGINT AS expected, n < 24 AS has_gaps FROM dy", **_DAILY))
def daily_returns(spark, sf_dir):
    return pnl.daily(simulated(spark, sf_dir), "net", HOUR).select("symbol", "day", r("total", "total"), "n", "expected", "has_gaps")


@query("A-06", sql(f"SELECT symbol, strftime(make_timestamp(open_time), '%Y-%m') AS month, any_value(24 * day(last_day(make_timestamp(open_time))))::BIGINT AS expected, {_METRICS} FROM (SELECT symbol, open_time, net AS x FROM p5) GROUP BY symbol, strftime(make_timestamp(open_time), '%Y-%m')", **_POS))
def monthly_metrics(spark, sf_dir):
    month = F.date_from_unix_date(F.expr(f"open_time div {DAY}").cast("int"))
    rows = simulated(spark, sf_dir).withColumns({"month": F.date_format(month, "yyyy-MM"), "days": F.dayofmonth(F.last_day(month))})
    sizes = rows.groupBy("symbol", "month").agg((F.max("days") * 24).cast("long").alias("expected"))
    return _metrics(rows, "net", "symbol", "month").join(sizes, ["symbol", "month"])


_VOL = f"SELECT symbol, open_time, close, round(CASE WHEN count(close) OVER {_F12} = 12 THEN stddev_samp(close) OVER {_F12} END, 9) AS v FROM h"
_CUT = f"SELECT symbol, quantile_cont(v, 1/3) AS q1, quantile_cont(v, 2/3) AS q2 FROM v WHERE v IS NOT NULL AND open_time < 1705276800000000 GROUP BY symbol"


def _volatility(spark, sf_dir):
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time", "close", F.round(ts.std(F.col("close"), 12), 9).alias("v"))


@query("A-07", sql("SELECT symbol, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM c", v=_VOL, c=_CUT))
def regime_cuts(spark, sf_dir):
    return gates.terciles(_volatility(spark, sf_dir), "v", 1705276800000000).select("symbol", r("q1", "q1"), r("q2", "q2"))


_NETTED = dict(_POS, nt=f"SELECT symbol, open_time, CASE WHEN rn > 1 THEN net - CASE WHEN rn = 2 THEN lag(cost) OVER {_W} ELSE 0 END END AS x FROM p5")
#: The end of the stretch that regimes are fitted on and the start of the one they are used on.
FITTED = 1705276800000000


@query(
    "A-08",
    sql(
        f"""SELECT n.symbol, CASE WHEN v IS NULL OR q1 IS NULL THEN 'unknown' WHEN v <= q1 THEN 'low' WHEN v <= q2 THEN 'mid' ELSE 'high' END AS regime, {_METRICS}
        FROM nt n LEFT JOIN v ON v.symbol = n.symbol AND v.open_time = n.open_time - {HOUR} LEFT JOIN c ON c.symbol = n.symbol WHERE n.open_time >= {FITTED} GROUP BY ALL""",
        **_NETTED,
        v=_VOL,
        c=_CUT,
    ),
)
def regime_metrics(spark, sf_dir):
    """Net returns by the volatility that was known at the close before each, in regimes fitted on an earlier stretch."""
    known = _volatility(spark, sf_dir).select("symbol", "open_time", "v")
    cuts = gates.terciles(known, "v", FITTED)  # one row a symbol
    net = pnl.boundary(simulated(spark, sf_dir)).where(F.col("open_time") >= FITTED).select("symbol", "open_time", "net")
    rows = net.join(known.withColumn("open_time", F.col("open_time") + HOUR), ["symbol", "open_time"], "left").join(cuts, "symbol", "left")
    return _metrics(gates.regimes(rows, "v"), "net", "symbol", "regime")


_SHARPES = " UNION ALL ".join(
    f"SELECT symbol, '{name}' AS period, avg(x) / nullif(stddev_samp(x), 0) * sqrt({YEAR}) AS s FROM nt WHERE x IS NOT NULL GROUP BY symbol, {part}"
    for name, part in (("month", "date_trunc('month', make_timestamp(open_time))"), ("week", f"open_time // {7 * DAY}"))
)


@query("A-09", sql("SELECT symbol, period, count(s) AS defined, round(avg(s), 4) + 0.0 AS mean, round(min(s), 4) + 0.0 AS least, round(avg((s > 0)::INT) FILTER (s IS NOT NULL), 6) AS positive FROM w GROUP BY symbol, period", **_NETTED, w=_SHARPES))
def stability_summary(spark, sf_dir):
    """Annual Sharpe of net returns by month, and by week, over the periods where it is defined."""
    rows = pnl.boundary(simulated(spark, sf_dir)).select("symbol", "open_time", "net")
    month = F.trunc(F.date_from_unix_date(F.expr(f"open_time div {DAY}").cast("int")), "month").cast("string")
    parts = F.explode(F.array(F.struct(F.lit("month").alias("period"), month.alias("part")), F.struct(F.lit("week").alias("period"), F.expr(f"open_time div {7 * DAY}").cast("string").alias("part"))))
    rows = rows.select("symbol", "net", parts.alias("p")).select("symbol", "net", "p.*")
    out = pnl.stability(rows, "net", YEAR, ["symbol", "period"], "part")
    return out.select("symbol", "period", "defined", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean", "least")], r("positive", "positive"))


_IC = dict(f=f"SELECT symbol, open_time, close, volume, CASE WHEN lead(open_time) OVER {_W} - open_time = {DAY} THEN lead(close) OVER {_W} / nullif(close, 0) - 1 END AS y FROM d")


def _ic_rows(spark, sf_dir):
    return bars(spark, sf_dir, DAY).select("symbol", "open_time", "close", "volume", ts.forward_return(F.col("close"), 1, DAY).alias("y"))


@query("A-13", sql("SELECT symbol, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS corr FROM (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2 AS ry FROM d) GROUP BY symbol"))
def rank_correlation(spark, sf_dir):
    return pnl.correlation(bars(spark, sf_dir, DAY), "volume", "close", ["symbol"], spearman=True).select("symbol", "n", r("corr", "corr"))


_MONTH_OF = "year(make_timestamp({0})) * 100 + month(make_timestamp({0}))"


@query(
    "A-15",
    sql(
        """SELECT 'time' AS kind, open_time AS period, n, round(corr, 6) + 0.0 AS value, NULL::DOUBLE AS ratio FROM t
        UNION ALL SELECT 'month', month, n, round(value, 6) + 0.0, NULL FROM mo
        UNION ALL SELECT 'all', -1, count(corr), round(avg(corr), 6) + 0.0, (SELECT round(avg(value) / nullif(stddev_samp(value), 0), 6) + 0.0 FROM mo) FROM t""",
        **_IC,
        t=f"SELECT open_time, {_MONTH_OF.format('open_time')} AS month, {_MONTH_OF.format(f'(open_time + {DAY})')} AS done, count(*) AS n, CASE WHEN count(DISTINCT close) > 1 AND count(DISTINCT y) > 1 THEN corr(close, y) END AS corr FROM f WHERE close IS NOT NULL AND y IS NOT NULL GROUP BY open_time HAVING count(*) >= 5",
        mo="SELECT month, count(*) AS n, avg(corr) AS value FROM t WHERE corr IS NOT NULL AND month = done GROUP BY month",
    ),
)
def cross_section_ic(spark, sf_dir):
    """The correlation across symbols at each time, its mean by month, over all, and the ratio of the months' mean to their
    deviation."""
    month = lambda t: F.date_format(F.timestamp_micros(t), "yyyyMM").cast("long")
    out = reports.cross_section_ic(_ic_rows(spark, sf_dir), "close", "y", month(F.col("open_time")), month(F.col("open_time") + DAY), 5)
    return out.select("kind", F.coalesce("period", F.lit(-1)).alias("period"), "n", r("value", "value"), r("ratio", "ratio"))


_M = dict(_POS, m="SELECT symbol, count(net) AS n, sum(net) AS total, avg(net) AS mean, avg(net) * 8760 AS annual, avg(net) / nullif(stddev_samp(net), 0) AS sharpe, avg(turnover) AS turnover, count(*) - count(net) AS unknown FROM p5 GROUP BY symbol")


def _measured(spark, sf_dir):
    rows = simulated(spark, sf_dir)
    extra = rows.groupBy("symbol").agg(F.avg("turnover").alias("turnover"), F.count_if(F.col("net").isNull()).alias("unknown"))
    return pnl.return_metrics(rows, "net", YEAR).join(extra, "symbol")


@query("A-16", sql("SELECT symbol, round(sharpe * sqrt(8760) * sqrt(abs(annual) / greatest(turnover, 0.125)), 4) + 0.0 AS fitness FROM m", **_M))
def fitness(spark, sf_dir):
    return _measured(spark, sf_dir).select("symbol", (F.round(pnl.fitness(F.col("annual_sharpe"), F.col("annual"), F.col("turnover")), 4) + 0.0).alias("fitness"))


_BARS = ["open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]


@query(
    "A-01",
    sql(f"SELECT symbol, open_time // {DAY} * {DAY} AS open_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume, round(sum(quote_volume), 6) AS quote_volume, sum(trades)::BIGINT AS trades FROM h GROUP BY symbol, open_time // {DAY} HAVING count(*) = 24"),
)
def resampled(spark, sf_dir):
    return resample.resample(bars(spark, sf_dir, HOUR), HOUR, DAY).select("symbol", "open_time", "open", "high", "low", "close", "volume", r("quote_volume", "quote_volume"), "trades")


@query(
    "J-01",
    sql(
        f"SELECT symbol, open_time, field, round(l, 6) AS \"left\", round(rr, 6) AS \"right\" FROM (SELECT a.symbol, a.open_time, unnest(['open', 'high', 'low', 'close', 'volume', 'quote_volume', 'trades', 'taker_buy_base', 'taker_buy_quote']) AS field, unnest([{', '.join(f'a.{c}::DOUBLE' for c in _BARS)}]) AS l, unnest([{', '.join(f'b.{c}::DOUBLE' for c in _BARS)}]) AS rr FROM d a JOIN (SELECT * REPLACE (CASE WHEN open_time // {DAY} % 7 = 0 THEN volume + 1 ELSE volume END AS volume) FROM d) b USING (symbol, open_time)) WHERE abs(l - rr) > 1e-9 * abs(rr)"
    ),
)
def bar_comparison(spark, sf_dir):
    direct = bars(spark, sf_dir, DAY)
    again = resample.resample(bars(spark, sf_dir, HOUR), HOUR, DAY, complete=False).withColumn("volume", F.when(F.expr(f"open_time div {DAY}") % 7 == 0, F.col("volume") + 1).otherwise(F.col("volume")))
    return resample.compare(direct, again).select("symbol", "open_time", "field", r("left", "left"), r("right", "right"))


@query("J-02", sql("SELECT count(*) AS n FROM h JOIN (SELECT symbol, open_time FROM d) k USING (symbol, open_time)"))
def shared_keys(spark, sf_dir):
    k = ["symbol", "open_time"]
    return bars(spark, sf_dir, HOUR).select(*k).join(bars(spark, sf_dir, DAY).select(*k), k).agg(F.count("*").alias("n"))


@query("A-25", sql(f"SELECT symbol, round(avg(y) FILTER (y > 0), 6) AS up, round(avg(y) FILTER (y <= 0), 6) + 0.0 AS down, count(*) FILTER (y > 0) AS n_up, count(*) FILTER (y <= 0) AS n_down FROM f GROUP BY symbol", **_IC))
def payoffs(spark, sf_dir):
    y = F.col("y")
    return _ic_rows(spark, sf_dir).groupBy("symbol").agg(r(F.avg(F.when(y > 0, y)), "up"), r(F.avg(F.when(y <= 0, y)), "down"), F.count_if(y > 0).alias("n_up"), F.count_if(y <= 0).alias("n_down"))


_ORB = dict(
    s=f"SELECT *, open_time // {DAY} * {DAY} AS day, open_time % {DAY} // {HOUR} AS slot FROM h",
    o="SELECT symbol, day, max(high) FILTER (slot < 3) AS rh, min(low) FILTER (slot < 3) AS rl FROM s GROUP BY ALL",
    e="SELECT symbol, day, min(slot) AS entry FROM s JOIN o USING (symbol, day) WHERE slot >= 3 AND close > rh GROUP BY ALL",
    x='SELECT symbol, day, min(slot) AS "exit" FROM s JOIN o USING (symbol, day) JOIN e USING (symbol, day) WHERE slot > entry AND close <= rl GROUP BY ALL',
)


@query("O-02", sql('SELECT symbol, day, entry, coalesce("exit", -1) AS "exit" FROM e LEFT JOIN x USING (symbol, day)', **_ORB))
def opening_breakout(spark, sf_dir):
    return sessions.breakout(bars(spark, sf_dir, HOUR), HOUR, 3).withColumn("exit", F.coalesce("exit", F.lit(-1)))


@query("O-05", sql('SELECT symbol, open_time, (entry IS NOT NULL AND slot >= entry AND ("exit" IS NULL OR slot < "exit"))::INT AS target FROM s LEFT JOIN e USING (symbol, day) LEFT JOIN x USING (symbol, day)', **_ORB))
def expanded_target(spark, sf_dir):
    b = bars(spark, sf_dir, HOUR)
    return sessions.expand(sessions.breakout(b, HOUR, 3), b, HOUR).select("symbol", "open_time", "target")


@query("P-11", sql(f"SELECT symbol, open_time // {DAY} * {DAY} AS day, CASE WHEN count(*) FILTER (s >= 9 AND s < 16) <> 7 THEN 'incomplete' WHEN count(*) FILTER (s >= 9 AND s < 16 AND NOT volume > 0) > 0 THEN 'no volume' ELSE 'full' END AS status FROM (SELECT *, open_time % {DAY} // {HOUR} AS s FROM h) GROUP BY ALL"))
def full_sessions(spark, sf_dir):
    return sessions.full_sessions(bars(spark, sf_dir, HOUR), HOUR, 9, 16)


def _digested(*columns: str) -> str:
    """Sums and xors of the first 60 bits of MD5 digests, by column and of whole rows, in SQL."""
    text = {"row": f"concat_ws('|', {', '.join(columns)})"} | {c: c for c in columns}
    return " UNION ALL ".join(f"SELECT '{n}' AS part, count(*) AS n, (sum(d) % 1000000007)::BIGINT AS total, bit_xor(d) AS mixed FROM (SELECT ('0x' || substr(md5({c}), 1, 15))::BIGINT AS d FROM x)" for n, c in text.items())


@query("A-38", sql(_digested("event_id", "symbol", "t", "cents"), x="SELECT event_id::VARCHAR AS event_id, symbol, t::VARCHAR AS t, (round(price * 10000)::BIGINT)::VARCHAR AS cents FROM ticks"))
def digests(spark, sf_dir):
    """Digests of the ticks, whole and by column, that don't depend on the order of rows."""
    rows = ticks(spark, sf_dir).select(F.col("event_id").cast("string"), "symbol", F.col("t").cast("string"), F.round(F.col("price") * 10000).cast("long").cast("string").alias("cents"))
    return quality.order_free_digests(rows)
