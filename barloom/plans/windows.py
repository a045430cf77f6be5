"""Window, feature, cross-section and scalar queries (W-*, F-*, X-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import scan, ts
from barloom.operators import cross_section, features, intraday, pnl, sessions
from barloom.plans.base import DAY, HOUR, bars, query, r, sql, ticks

_W = "(PARTITION BY symbol ORDER BY open_time)"
_CONTIG = f"coalesce((open_time - lag(open_time, {{n}}) OVER {_W} = {{n}} * {HOUR}) AND open_time % {HOUR} = 0, false)"


def _frame(n: int, key: str = "symbol") -> str:
    return f"(PARTITION BY {key} ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _feature(name: str, make, oracle_value: str, least: int, source: str = "h", step: int = HOUR):
    """A query of one windowed value per bar, known only on a full and contiguous window of ``least`` bars."""
    gate = "true" if least <= 1 else _CONTIG.format(n=least - 1)
    oracle = sql(f"SELECT symbol, open_time, round(CASE WHEN {gate} THEN {oracle_value} END, 6) + 0.0 AS value FROM {source}")

    @query(name, oracle)
    def run(spark, sf_dir):
        rows = bars(spark, sf_dir, step)
        if least <= 1:
            return rows.select("symbol", "open_time", r(make(), "value"))
        # pieces of ten days: each series is cut into several here too
        return ts.chunked(rows, step, least, {"value": make()}, chunk=240).select("symbol", "open_time", r("value", "value"))


def close():
    return F.col("close")


_feature("W-01", lambda: ts.lag(close(), 3, HOUR), f"lag(close, 3) OVER {_W}", 4)
_feature("W-03", lambda: ts.log_return(close(), 6, HOUR), f"CASE WHEN close > 0 AND lag(close, 6) OVER {_W} > 0 THEN ln(close / lag(close, 6) OVER {_W}) END", 7)
_feature("W-04", lambda: ts.mean(close(), 12, HOUR), f"avg(close) OVER {_frame(12)}", 12)
_feature("W-05", lambda: ts.std(close(), 12, HOUR), f"stddev_samp(close) OVER {_frame(12)}", 12)
_feature("W-06", lambda: ts.zscore(close(), 12, HOUR), f"(close - avg(close) OVER {_frame(12)}) / nullif(stddev_samp(close) OVER {_frame(12)}, 0)", 12)
@query("W-07", sql(f"SELECT symbol, open_time, round(CASE WHEN coalesce(open_time - lag(open_time, 47) OVER {_W} = 47 * {HOUR}, false) THEN (len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2) / 48 END, 6) + 0.0 AS value FROM (SELECT *, list(close) OVER {_frame(48)} AS l FROM h)"))
def percentile_ranks(spark, sf_dir):
    """Trailing percentile rank over two days, by sorted blocks of pieces of ten days."""
    return ts.ranked(bars(spark, sf_dir, HOUR), "close", 48, HOUR, chunk=240).select("symbol", "open_time", r("value", "value"))


_feature("W-08", lambda: ts.ratio(close(), ts.mean(close(), 12, HOUR)) - 1, f"close / nullif(avg(close) OVER {_frame(12)}, 0) - 1", 12)
_feature("W-10", lambda: ts.parkinson(12, HOUR), f"sqrt(avg(pow(ln(high / low), 2)) OVER {_frame(12)} / (4 * ln(2)))", 12)
_GK = "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"
_feature("W-11", lambda: ts.garman_klass(12, HOUR), f"CASE WHEN avg({_GK}) OVER {_frame(12)} >= 0 THEN sqrt(avg({_GK}) OVER {_frame(12)}) END", 12)
_feature("W-13", lambda: ts.warm(close(), 24), f"CASE WHEN row_number() OVER {_W} > 24 THEN close END", 1)
_feature("W-14", lambda: ts.forward_return(close(), 4, HOUR), f"CASE WHEN lead(open_time, 4) OVER {_W} - open_time = 4 * {HOUR} THEN lead(close, 4) OVER {_W} / nullif(close, 0) - 1 END", 1)
_feature("W-30", lambda: F.when(ts.full(close(), 5), F.percentile(close(), 0.5).over(ts.last_n(5))), f"CASE WHEN count(close) OVER {_frame(5)} = 5 THEN quantile_cont(close, 0.5) OVER {_frame(5)} END", 1)
_feature("W-32", lambda: ts.steps_on_time(6, HOUR).cast("double"), f"sum(on_time) OVER {_frame(5)}", 1, f"(SELECT *, (open_time - lag(open_time) OVER {_W} = {HOUR})::INT AS on_time FROM h)")
_feature("F-03", lambda: ts.clip(close() / 10 - 1, -0.5, 0.5), "least(greatest(close / 10 - 1, -0.5), 0.5)", 1)
_feature("F-02", lambda: ts.sign(close() - F.col("open")), "sign(close - open)", 1)
_feature("F-04", lambda: ts.choose(F.when(F.col("volume") > 1, F.signum(close() - F.col("open"))), close(), -close()), "CASE WHEN volume > 1 THEN CASE WHEN sign(close - open) <> 0 THEN close ELSE -close END END", 1)
_feature("F-01", lambda: ts.ratio(close() - F.col("open"), F.col("high") - F.col("low")), "(close - open) / nullif(high - low, 0)", 1)
_feature("F-05", lambda: ts.bound(F.ln(close()) - 2), "least(greatest(ln(close) - 2, -1.0), 1.0)", 1)
_feature("F-06", lambda: F.sqrt(F.abs(close() - F.col("open"))) + F.sin(close()) + F.floor(close()), "sqrt(abs(close - open)) + sin(close) + floor(close)", 1)


@query("W-02", sql(f"SELECT symbol, open_time, {_CONTIG.format(n=5)} AS ok FROM h"))
def contiguity(spark, sf_dir):
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time", ts.contiguous(6, HOUR).alias("ok"))


_RET = f"SELECT *, CASE WHEN {_CONTIG.format(n=1)} AND close > 0 AND lag(close) OVER {_W} > 0 THEN ln(close / lag(close) OVER {_W}) END AS lr FROM h"


@query("W-09", sql(f"SELECT symbol, open_time, round(CASE WHEN count(lr) OVER {_frame(24)} = 24 THEN stddev_samp(lr) OVER {_frame(24)} END, 6) + 0.0 AS value FROM r", r=_RET))
def realised_volatility(spark, sf_dir):
    rows = bars(spark, sf_dir, HOUR).withColumn("lr", ts.log_return(close(), 1, HOUR))
    return rows.select("symbol", "open_time", r(ts.std(F.col("lr"), 24), "value"))


@query(
    "F-07",
    sql(
        f"""SELECT symbol, open_time, round(sin(2 * pi() * hh / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hh / 24), 6) + 0.0 AS hour_cos,
      round(sin(2 * pi() * dd / 7), 6) + 0.0 AS day_sin, round(cos(2 * pi() * dd / 7), 6) + 0.0 AS day_cos
      FROM (SELECT *, (open_time % {DAY}) // {HOUR} AS hh, (open_time // {DAY} + 3) % 7 AS dd FROM h)"""
    ),
)
def clock_features(spark, sf_dir):
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time", *[r(c, n) for n, c in features.clock().items()])


@query(
    "F-08",
    sql("SELECT symbol, open_time, round(quote_volume, 6) AS dollar_volume, round(taker_buy_base / nullif(volume, 0), 6) AS taker_ratio, round(quote_volume / nullif(trades, 0), 6) AS trade_size FROM h"),
)
def activity(spark, sf_dir):
    a = features.activity()
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time", *[r(a[n], n) for n in ("dollar_volume", "taker_ratio", "trade_size")])


@query(
    "F-09",
    sql(f"SELECT symbol, open_time, round((close - open) / nullif(open, 0), 6) + 0.0 AS body, round((high - low) / nullif(open, 0), 6) + 0.0 AS span, round((close - low) / nullif(high - low, 0), 6) + 0.0 AS location, (open_time % {DAY}) // {HOUR} AS slot FROM h"),
)
def shape(spark, sf_dir):
    a = features.shape(HOUR)
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time", *[r(a[n], n) for n in ("body", "span", "location")], a["slot"].alias("slot"))


@query("F-10", sql("SELECT symbol, open_time, strftime(make_timestamp(open_time), '%Y-%m-%d %H:%M:%S') AS utc, strftime(make_timestamp(open_time + 19800000000), '%H:%M') AS india, strftime(make_timestamp(open_time), '%Y-%m') AS month FROM h"))
def times(spark, sf_dir):
    utc = F.timestamp_micros("open_time")
    zone = spark.conf.get("spark.sql.session.timeZone")
    local = lambda z: F.convert_timezone(F.lit(zone), F.lit(z), utc.cast("timestamp_ntz"))
    return bars(spark, sf_dir, HOUR).select(
        "symbol", "open_time", F.date_format(local("UTC"), "yyyy-MM-dd HH:mm:ss").alias("utc"), F.date_format(local("Asia/Kolkata"), "HH:mm").alias("india"), F.date_format(local("UTC"), "yyyy-MM").alias("month")
    )


@query("F-11", "SELECT d::DATE::VARCHAR AS day, CASE WHEN day(d) = 13 THEN 'special' ELSE 'normal' END AS kind FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(d) WHERE d::DATE IN (SELECT ts::DATE FROM events) AND ((isodow(d) < 6 AND day(d) <> 26) OR day(d) = 13)")
def calendar(spark, sf_dir):
    seen = ticks(spark, sf_dir).select((F.expr(f"t div {DAY}")).cast("int").alias("n")).distinct()
    days = sessions.calendar(spark, "2024-01-01", "2024-01-30", holidays=["2024-01-26"], specials=["2024-01-13"])
    return days.join(seen, F.unix_date("day") == F.col("n"), "left_semi").withColumn("day", F.col("day").cast("string"))


@query("F-15", "SELECT o_orderkey, (round_even(round(o_totalprice * 100)::BIGINT / 1000, 0))::BIGINT AS even_tens, round(o_totalprice, 0)::BIGINT AS half_up, trunc(o_totalprice)::BIGINT AS toward_zero FROM orders")
def rounding(spark, sf_dir):
    from barloom.plans.base import table

    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.bround(F.round(F.col("o_totalprice") * 100).cast("long").cast("decimal(18,0)") / 1000, 0).cast("long").alias("even_tens"), F.round(price, 0).cast("long").alias("half_up"), (F.signum(price) * F.floor(F.abs(price))).cast("long").alias("toward_zero")
    )


@query("F-13", "SELECT count(*) FILTER (regexp_full_match(c_name, 'Customer#[0-9]{9}')) AS good, count(*) FILTER (NOT regexp_full_match(c_name, 'Customer#[0-9]{9}')) AS bad, count(*) FILTER (regexp_full_match(c_mktsegment, '[A-Z]+')) AS upper FROM customer")
def patterns(spark, sf_dir):
    from barloom.plans.base import table

    name = F.col("c_name").rlike("^Customer#[0-9]{9}$")
    return table(spark, sf_dir, "customer").agg(F.count_if(name).alias("good"), F.count_if(~name).alias("bad"), F.count_if(F.col("c_mktsegment").rlike("^[A-Z]+$")).alias("upper"))


@query("F-18", sql("SELECT symbol, open_time, round(sign(g) * greatest(abs(g) - 0.05, 0), 6) + 0.0 AS edge FROM (SELECT symbol, open_time, close / nullif(open, 0) - 1 AS g FROM h)"))
def edge(spark, sf_dir):
    g = ts.ratio(close(), F.col("open")) - 1
    return bars(spark, sf_dir, HOUR).select("symbol", "open_time", r(pnl.edge_after_cost(g, 0.05), "edge"))


@query("F-20", "SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS k FROM events WHERE CAST(props->>'$.k' AS INT) BETWEEN 10 AND 19 GROUP BY ALL")
def json_paths(spark, sf_dir):
    return ticks(spark, sf_dir).where("k between 10 and 19").groupBy(F.col("symbol").alias("event_type")).agg(F.count("*").alias("n"), F.sum(F.col("k").cast("long")).alias("k"))


@query(
    "W-16",
    sql(
        f"SELECT symbol, open_time, (sum(broken::INT) OVER {_W})::BIGINT AS segment FROM b",
        b=f"SELECT *, coalesce(open_time - lag(open_time) OVER {_W} <> {HOUR} OR open_time // {DAY} <> lag(open_time) OVER {_W} // {DAY}, true) AS broken FROM h",
    ),
)
def segments(spark, sf_dir):
    return sessions.segments(bars(spark, sf_dir, HOUR), HOUR).select("symbol", "open_time", "segment")


_SEG = dict(
    b=f"SELECT *, coalesce(open_time - lag(open_time) OVER {_W} <> {HOUR} OR open_time // {DAY} <> lag(open_time) OVER {_W} // {DAY}, true) AS broken FROM h",
    s=f"SELECT *, (sum(broken::INT) OVER {_W})::BIGINT AS segment FROM b",
)
_S3 = "(PARTITION BY symbol, segment ORDER BY open_time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("W-17", sql(f"SELECT symbol, open_time, round(CASE WHEN count(close) OVER {_S3} = 3 THEN stddev_pop(close) OVER {_S3} END, 6) + 0.0 AS vol3, round(CASE WHEN count(volume) OVER {_S3} = 3 THEN volume / nullif(avg(volume) OVER {_S3}, 0) END, 6) + 0.0 AS rel_volume FROM s", **_SEG))
def segment_windows(spark, sf_dir):
    rows = sessions.segments(bars(spark, sf_dir, HOUR), HOUR)
    w = ts.last_n(3, ts.over("symbol", "segment"))
    known = F.count("close").over(w) == 3
    return rows.select("symbol", "open_time", r(F.when(known, F.stddev_pop("close").over(w)), "vol3"), r(F.when(known, ts.ratio(F.col("volume"), F.avg("volume").over(w))), "rel_volume"))


_PREF = "SELECT *, (symbol <> 'error' OR open_time >= 1704931200000000) AS listed FROM d"


@query(
    "W-20",
    sql(
        "SELECT symbol, open_time, round(CASE WHEN n = e THEN (rk + (ties - 1) / 2) / n END, 6) + 0.0 AS value FROM (SELECT *, rank() OVER (PARTITION BY open_time ORDER BY close) AS rk, count(*) OVER (PARTITION BY open_time, close) AS ties, count(close) OVER (PARTITION BY open_time) AS n, count(*) OVER (PARTITION BY open_time) AS e FROM l WHERE listed)",
        l=_PREF,
    ),
)
def cross_rank(spark, sf_dir):
    rows = cross_section.listed(bars(spark, sf_dir, DAY), cross_section.listing(spark))
    return cross_section.rank(rows, "close").select("symbol", "open_time", r("value"  , "value"))


@query("W-21", sql("SELECT symbol, open_time, round(close - avg(close) OVER (PARTITION BY open_time), 6) + 0.0 AS value FROM l WHERE listed", l=_PREF))
def cross_demean(spark, sf_dir):
    rows = cross_section.listed(bars(spark, sf_dir, DAY), cross_section.listing(spark))
    return cross_section.demean(rows, "close").select("symbol", "open_time", r("value", "value"))


@query("J-06", sql("SELECT symbol, open_time, close FROM l WHERE listed", l=_PREF))
def listing_join(spark, sf_dir):
    return cross_section.listed(bars(spark, sf_dir, DAY), cross_section.listing(spark)).select("symbol", "open_time", "close")


@query(
    "W-18",
    sql(f"SELECT symbol, open_time + {HOUR} AS gap_start, nxt - {HOUR} AS gap_end, (nxt - open_time) // {HOUR} - 1 AS missing FROM (SELECT symbol, open_time, lead(open_time) OVER {_W} AS nxt FROM h) WHERE nxt - open_time > {HOUR}"),
)
def gap_runs(spark, sf_dir):
    from barloom.operators import quality

    return quality.gaps(bars(spark, sf_dir, HOUR), HOUR)


@query("W-19", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def keep_first(spark, sf_dir):
    from barloom.operators import quality
    from barloom.plans.base import table

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return quality.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("W-27", sql(f"SELECT symbol, open_time, round(sum((high + low + close) / 3 * volume) OVER x / nullif(sum(volume) OVER x, 0), 6) + 0.0 AS vwap FROM h WINDOW x AS (PARTITION BY symbol, open_time // {DAY} ORDER BY open_time)"))
def vwap(spark, sf_dir):
    return sessions.vwap(bars(spark, sf_dir, HOUR)).select("symbol", "open_time", r("vwap", "vwap"))


@query(
    "W-29",
    sql(
        f"""SELECT symbol, day, round(rvol, 6) AS rvol, rk FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rvol DESC, symbol) AS rk FROM
          (SELECT symbol, day, CASE WHEN count(v) OVER z = 3 THEN v / nullif(avg(v) OVER z, 0) END AS rvol FROM (SELECT symbol, open_time // {DAY} * {DAY} AS day, sum(volume) FILTER (open_time % {DAY} < 6 * {HOUR}) AS v FROM h GROUP BY ALL)
            WINDOW z AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE rvol IS NOT NULL) WHERE rk <= 20"""
    ),
)
def top_volume(spark, sf_dir):
    """The 20 symbols of each day whose opening volume is largest against the sessions before."""
    rows = intraday.slots(bars(spark, sf_dir, HOUR), HOUR)
    return intraday.busiest(intraday.opening_volume(rows, 6, 3), 20).select("symbol", "day", r("rvol", "rvol"), "rk")


@query("W-31", sql(f"SELECT symbol, open_time, CASE WHEN s = 1 AND coalesce(p, 0) = 0 THEN 'entry' WHEN s = 0 AND p = 1 THEN 'exit' WHEN s = 1 THEN 'hold' ELSE 'flat' END AS state FROM (SELECT *, lag(s) OVER {_W} AS p FROM (SELECT *, (close > open)::INT AS s FROM h))"))
def state_changes(spark, sf_dir):
    rows = bars(spark, sf_dir, HOUR).withColumn("s", (close() > F.col("open")).cast("int"))
    return sessions.state_changes(rows, "s").select("symbol", "open_time", "state")


_IDENTITY = dict(
    e=f"SELECT symbol, open_time AS day, symbol || '-' || (open_time // {DAY} // 10) AS isin, round(high / low, 6) AS high_ratio, CASE WHEN open_time // {DAY} % 9 IN (4, 5) THEN 1.2 ELSE 1.0 END AS low_ratio FROM d",
    i="SELECT *, least(high_ratio, low_ratio) > 1.05 OR greatest(high_ratio, low_ratio) < 0.95 AS shifted FROM e",
    g0="SELECT *, coalesce((isin <> lag(isin) OVER w OR shifted <> lag(shifted) OVER w)::INT, 1) AS chg FROM i WINDOW w AS (PARTITION BY symbol ORDER BY day)",
    g1="SELECT *, (sum(chg) OVER (PARTITION BY symbol ORDER BY day))::BIGINT AS g FROM g0",
)


@query("W-33", sql("SELECT symbol, g, any_value(isin) AS isin, any_value(shifted) AS shifted, min(day) AS first, max(day) AS last, count(*) AS n, min(least(high_ratio, low_ratio)) AS low, max(greatest(high_ratio, low_ratio)) AS high FROM g1 GROUP BY symbol, g", **_IDENTITY))
def identity_runs(spark, sf_dir):
    """Stretches of days with one identity (ISIN, and whether prices are shifted against the reference)."""
    day = F.expr(f"open_time div {DAY}")
    isin = F.concat("symbol", F.lit("-"), F.expr(f"open_time div {DAY} div 10").cast("string"))
    rows = bars(spark, sf_dir, DAY).select("symbol", "open_time", isin.alias("isin"), F.round(ts.quotient(F.col("high"), F.col("low")), 6).alias("high_ratio"), F.when((day % 9).isin(4, 5), 1.2).otherwise(1.0).alias("low_ratio"))
    return sessions.identity_runs(rows, DAY).select("symbol", "g", "isin", "shifted", "first", "last", "n", "low", "high")


@query("W-34", sql(f"SELECT symbol, open_time, row_number() OVER {_W} AS seq, coalesce(open_time - lag(open_time) OVER {_W} > {HOUR}, false) AS after_gap FROM h"))
def sequence(spark, sf_dir):
    rows = scan.scanned(bars(spark, sf_dir, HOUR), ["symbol"], scan.by_time(HOUR, 240), ["open_time"], sums={"seq": F.lit(1).cast("long")}, before={"last": F.col("open_time")})
    return rows.select("symbol", "open_time", "seq", F.coalesce(F.col("open_time") - F.col("last") > HOUR, F.lit(False)).alias("after_gap"))


def _known(n: int, column: str, value: str) -> str:
    """``value`` where the last n values of a column are known and one step apart."""
    return f"CASE WHEN {_CONTIG.format(n=n - 1)} AND count({column}) OVER {_frame(n)} = {n} THEN {value} END"


_REGISTERED = (
    {f"return_{n}": f"CASE WHEN {_CONTIG.format(n=n)} AND close > 0 AND lag(close, {n}) OVER {_W} > 0 THEN ln(close / lag(close, {n}) OVER {_W}) END" for n in (1, 6, 24)}
    | {f"distance_{n}": _known(n, "close", f"close / nullif(avg(close) OVER {_frame(n)}, 0) - 1") for n in (12, 48, 168)}
    | {f"volatility_{n}": f"CASE WHEN count(ret) OVER {_frame(n)} = {n} THEN stddev_samp(ret) OVER {_frame(n)} END" for n in (24, 168)}
    | {"parkinson_24": _known(24, "pk", f"sqrt(avg(pk) OVER {_frame(24)} / (4 * ln(2)))"), "garman_klass_24": _known(24, "gk", f"CASE WHEN avg(gk) OVER {_frame(24)} >= 0 THEN sqrt(avg(gk) OVER {_frame(24)}) END")}
    | {f"{n}_z_168": _known(168, c, f"({c} - avg({c}) OVER {_frame(168)}) / nullif(stddev_samp({c}) OVER {_frame(168)}, 0)") for n, c in (("volume", "volume"), ("dollar", "quote_volume"), ("taker", "tk"), ("trades", "trades"))}
    | {"dollar_volume": "CASE WHEN quote_volume >= 0 THEN quote_volume END", "taker_ratio": "tk", "trade_size": "CASE WHEN trades > 0 THEN quote_volume / trades END"}
    | {f"hour_{f}": f"{f}((open_time % {DAY} // {HOUR}) * 2 * pi() / 24)" for f in ("sin", "cos")}
    | {f"day_{f}": f"{f}(((open_time // {DAY} + 3) % 7) * 2 * pi() / 7)" for f in ("sin", "cos")}
)


@query(
    "X-01",
    sql(
        f"SELECT symbol, open_time, {', '.join(f'round({v}, 6) + 0.0 AS {n}' for n, v in _REGISTERED.items())} FROM x",
        x=f"SELECT *, CASE WHEN {_CONTIG.format(n=1)} AND close > 0 AND lag(close) OVER {_W} > 0 THEN ln(close / lag(close) OVER {_W}) END AS ret, CASE WHEN volume > 0 THEN taker_buy_base / volume END AS tk, pow(ln(high / low), 2) AS pk, {_GK} AS gk FROM h",
    ),
)
def all_features(spark, sf_dir):
    """All registered features of every hourly bar, over pieces of four weeks."""
    rows = features.build(bars(spark, sf_dir, HOUR), HOUR, chunk=672)
    return rows.select("symbol", "open_time", *[r(c, c) for c in features.names()])


@query(
    "X-03",
    sql(
        "SELECT symbol, open_time, signal_id, round(CASE signal_id WHEN 'flow' THEN least(greatest(2 * (taker_buy_base / nullif(volume, 0)) - 1, -1.0), 1.0) WHEN 'reversal' THEN least(greatest(-(close / nullif(open, 0) - 1), -1.0), 1.0) ELSE least(greatest(sign(close - open) * 0.5, -1.0), 1.0) END, 6) + 0.0 AS signal FROM h CROSS JOIN (VALUES ('flow'), ('reversal'), ('candle')) v(signal_id)"
    ),
)
def formulas(spark, sf_dir):
    return features.signals(bars(spark, sf_dir, HOUR), features.FORMULAS).select("symbol", "open_time", "signal_id", r("signal", "signal"))
