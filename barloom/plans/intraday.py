"""Intraday queries: session rules, screens, round trips, scoreboards, charges and ledgers (O-*, A-22, A-23, A-32..A-40, Q-07, Q-09, W-28, W-35, X-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import ts
from barloom.operators import features, intraday, ledger
from barloom.plans.base import DAY, HOUR, bars, query, r, sql, table, ticks
from barloom.plans.judging import EDGE
from barloom.sources import stores

_D = "(PARTITION BY symbol ORDER BY day)"
_DAYNO = f"(day // {DAY})"
#: Sessions of hourly bars in SQL: s has day and slot, o one row a session.
_S = dict(
    s=f"SELECT *, open_time // {DAY} * {DAY} AS day, open_time % {DAY} // {HOUR} AS slot FROM h",
    o0="SELECT symbol, day, arg_min(open, slot) AS first_open, arg_max(close, slot) AS last_close, count(*) AS bars, sum(volume) AS volume FROM s GROUP BY ALL",
    o=f"SELECT *, lag(last_close) OVER {_D} AS prev_close FROM o0",
)
N = 3


def slots(spark, sf_dir):
    return intraday.slots(bars(spark, sf_dir, HOUR), HOUR)


_NOISE = dict(
    _S,
    nz=f"""SELECT *, CASE WHEN count(mv) OVER z = {N} THEN avg(mv) OVER z END AS noise FROM (SELECT s.*, first_open, prev_close, abs(close / first_open - 1) AS mv FROM s JOIN o USING (symbol, day))
      WINDOW z AS (PARTITION BY symbol, slot ORDER BY day ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING)""",
    bd=f"""SELECT *, greatest(greatest(first_open, prev_close) * (1 + noise), vwap) AS bound FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER v / sum(volume) OVER v AS vwap FROM nz
      WINDOW v AS (PARTITION BY symbol, day ORDER BY slot)) WHERE prev_close IS NOT NULL AND noise IS NOT NULL AND slot % 2 = 1 AND slot <= 21""",
    en="SELECT symbol, day, min(slot) AS entry FROM bd WHERE slot <= 17 AND close > bound GROUP BY ALL",
    ex='SELECT symbol, day, min(slot) AS "exit" FROM bd JOIN en USING (symbol, day) WHERE slot > entry AND close <= bound GROUP BY ALL',
)


@query("O-03", sql('SELECT symbol, day, entry, coalesce("exit", 22) AS "exit" FROM en LEFT JOIN ex USING (symbol, day)', **_NOISE))
def noise_breakout(spark, sf_dir):
    return intraday.noise_breakout(slots(spark, sf_dir), N, 1, 2, 17, 22).select("symbol", "day", "entry", "exit")


@query("W-28", sql(f"""SELECT symbol, day, prev_close, atr, rvol, noise FROM
  (SELECT symbol, day, round(prev_close, 6) AS prev_close, round(CASE WHEN count(tr) OVER z = {N} THEN avg(tr) OVER z END, 6) AS atr, round(CASE WHEN count(v) OVER z = {N} THEN v / nullif(avg(v) OVER z, 0) END, 6) AS rvol
    FROM (SELECT *, greatest(hi - lo, abs(hi - prev_close), abs(lo - prev_close)) AS tr FROM o JOIN (SELECT symbol, day, max(high) AS hi, min(low) AS lo, sum(volume) FILTER (slot < 6) AS v FROM s GROUP BY ALL) USING (symbol, day))
    WINDOW z AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING))
  LEFT JOIN (SELECT symbol, day, round(avg(noise), 6) AS noise FROM nz GROUP BY ALL) USING (symbol, day)""", **_NOISE))
def session_setup(spark, sf_dir):
    """Each session's previous close, true range and opening volume against the sessions before, and its mean noise by slot."""
    rows = slots(spark, sf_dir)
    days = intraday.sessions(rows).select("symbol", "day", "prev_close")
    w = ts.over("symbol", by="day").rowsBetween(-N, -1)
    high_low = rows.groupBy("symbol", "day").agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    before = F.col("prev_close")
    # greatest skips the unknown previous close of a first session
    true_range = F.greatest(F.col("hi") - F.col("lo"), F.abs(F.col("hi") - before), F.abs(F.col("lo") - before))
    days = days.join(high_low, ["symbol", "day"]).withColumn("tr", true_range)
    days = days.withColumn("atr", F.when(F.count("tr").over(w) == N, F.avg("tr").over(w)))
    noise = intraday.noise(rows.join(intraday.sessions(rows).select("symbol", "day", "first_open"), ["symbol", "day"]), N)
    noise = noise.groupBy("symbol", "day").agg(F.avg("noise").alias("noise"))
    out = days.join(intraday.opening_volume(rows, 6, N), ["symbol", "day"]).join(noise, ["symbol", "day"], "left")
    return out.select("symbol", "day", *[F.round(c, 6).alias(c) for c in ("prev_close", "atr", "rvol", "noise")])


@query("O-04", sql("SELECT symbol, day, (early > prev_close)::INT AS target FROM o JOIN (SELECT symbol, day, arg_max(close, slot) AS early FROM s WHERE slot < 6 GROUP BY ALL) USING (symbol, day) WHERE prev_close IS NOT NULL", **_S))
def closing_momentum(spark, sf_dir):
    rows = intraday.opening_close(slots(spark, sf_dir), 6).where("prev_close is not null")
    return rows.select("symbol", "day", (F.col("early") > F.col("prev_close")).cast("int").alias("target"))


_A, _B, _M = 2, 3, 5


@query(
    "A-40",
    sql(
        f"""SELECT symbol, day, round(ca / o - 1, 6) + 0.0 AS early, round(cb / o - 1, 6) + 0.0 AS half, round(cn / o - 1, 6) + 0.0 AS whole, round(cn / cl - 1, 6) + 0.0 AS last_leg, round(cn / cb - 1, 6) + 0.0 AS second_half,
          round((h - l) / o, 6) AS span, round((cn - l) / (h - l), 6) + 0.0 AS location, round(spread, 6) + 0.0 AS spread, round(late / soon, 6) AS volume_ratio, round(rises, 6) AS rises FROM
        (SELECT symbol, day, count(*) AS k, max(open) FILTER (i = 1) AS o, max(close) FILTER (i = {_A}) AS ca, max(close) FILTER (i = {_B}) AS cb, max(close) FILTER (i = {_M}) AS cn, max(close) FILTER (i = {_M - _A}) AS cl,
          max(high) AS h, min(low) AS l, stddev_pop(lg) AS spread, avg(volume) FILTER (i > {_M - _A}) AS late, avg(volume) FILTER (i <= {_A}) AS soon, avg((st > 0)::INT) AS rises FROM
          (SELECT *, row_number() OVER y AS i, close - lag(close) OVER y AS st, ln(close) - ln(lag(close) OVER y) AS lg FROM s WINDOW y AS (PARTITION BY symbol, day ORDER BY slot)) WHERE i <= {_M} GROUP BY ALL)
        WHERE k = {_M} AND h > l""",
        **_S,
    ),
)
def opening_features(spark, sf_dir):
    out = intraday.opening_features(slots(spark, sf_dir), _A, _B, _M)
    return out.select("symbol", "day", *[r(c, c) for c in out.columns if c not in ("symbol", "day")])


_TRIP = dict(
    _S,
    t0="""SELECT symbol, day, max(close) FILTER (slot = 6) AS c, max(open) FILTER (slot = 7) AS entry, max(open) FILTER (slot = 18) AS leave, any_value(prev_close) AS prev_close
      FROM s JOIN o USING (symbol, day) GROUP BY symbol, day""",
    t1="SELECT *, coalesce(c > prev_close, false) AS active, unnest([1, 2]) AS multiplier FROM t0 WHERE c IS NOT NULL AND entry IS NOT NULL AND leave IS NOT NULL",
    t2="SELECT *, CASE WHEN active THEN floor(50000 / c) ELSE 0 END AS q, entry * (1 + 0.0005 * multiplier) AS buy, leave * (1 - 0.0005 * multiplier) AS sell FROM t1",
    t3="""SELECT *, CASE WHEN q > 0 THEN multiplier * ((least(q * buy * 0.0003, 20) + least(q * sell * 0.0003, 20) + (q * buy + q * sell) * (297e-7 + 10e-7 + 10e-7)) * 1.18 + q * buy * 0.00003
      + round(round(q * round((buy + sell) / 2, 2) * 0.00025, 2), 0)) ELSE 0 END AS fees, q * (leave - entry) AS gross, q * (buy - entry + leave - sell) AS slippage FROM t2""",
    t4="SELECT *, gross - slippage - fees AS net FROM t3",
)


def trips(spark, sf_dir):
    return intraday.round_trips(slots(spark, sf_dir), 6, 18, F.col("close") > F.col("prev_close"))


@query("O-06", sql("SELECT symbol, day, multiplier, active, q AS quantity, round(gross, 3) + 0.0 AS gross, round(slippage, 3) + 0.0 AS slippage, round(fees, 3) + 0.0 AS fees, round(net, 3) + 0.0 AS net FROM t4", **_TRIP))
def round_trips(spark, sf_dir):
    return trips(spark, sf_dir).select("symbol", "day", "multiplier", "active", "quantity", *[(F.round(c, 3) + 0.0).alias(c) for c in ("gross", "slippage", "fees", "net")])


@query(
    "A-35",
    sql(
        f"""SELECT symbol, multiplier, days, active, mean_bps, sharpe, days >= 20 AND active >= 10 AND raw > 0 AND steady AS passed FROM
        (SELECT symbol, multiplier, count(DISTINCT day) AS days, count(*) FILTER (active) AS active, avg(net / 100000) * 10000 AS raw, round(avg(net / 100000) * 10000, 4) + 0.0 AS mean_bps,
          round(avg(net / 100000) / nullif(stddev_samp(net / 100000), 0) * sqrt(252), 4) + 0.0 AS sharpe FROM t4 GROUP BY ALL)
        JOIN (SELECT symbol, multiplier, bool_and(total > 0) AS steady FROM (SELECT symbol, multiplier, day // (10 * {DAY}) AS part, sum(net / 100000) AS total FROM t4 GROUP BY ALL) GROUP BY ALL) USING (symbol, multiplier)""",
        **_TRIP,
    ),
)
def scoreboard(spark, sf_dir):
    board = intraday.scoreboard(trips(spark, sf_dir), 100_000.0, F.expr(f"day div {10 * DAY}"), 20, 10, "symbol")
    return board.select("symbol", "multiplier", "days", "active", (F.round("mean_bps", 4) + 0.0).alias("mean_bps"), (F.round("sharpe", 4) + 0.0).alias("sharpe"), "passed")


@query(
    "O-07",
    sql(
        f"""SELECT symbol, day, round(100000 * exp(sum(ln(1 + coalesce(net / 1000000, 0))) OVER {_D}), 3) AS capital, net IS NULL AS flat FROM
        (SELECT symbol, unnest(range(a, b + 1, {DAY})) AS day FROM (SELECT symbol, min(day) AS a, max(day) AS b FROM t4 WHERE multiplier = 1 GROUP BY symbol))
        LEFT JOIN (SELECT symbol, day, net FROM t4 WHERE multiplier = 1) USING (symbol, day)""",
        **_TRIP,
    ),
)
def compounded(spark, sf_dir):
    results = trips(spark, sf_dir).where("multiplier = 1").select("symbol", "day", (F.col("net") / 1_000_000).alias("r"))
    return intraday.compounded(results, 100_000.0).select("symbol", "day", F.round("capital", 3).alias("capital"), "flat")


_TRADES = """SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, 'b' || l_orderkey AS order_id, l_partkey AS security, true AS buy, l_quantity AS q, l_extendedprice / l_quantity AS p FROM lineitem
  UNION ALL SELECT strftime(l_shipdate, '%Y-%m-%d'), 's' || l_orderkey, l_partkey, false, l_quantity - CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END, l_extendedprice / l_quantity * 1.0137 FROM lineitem WHERE l_quantity > 1"""


@query(
    "A-23",
    f"""WITH t AS ({_TRADES}), o AS (SELECT day, order_id, least(sum(q * p) * 0.0003, 20) AS b, sum(q * p) AS v, sum(q * p) FILTER (buy) AS bv FROM t GROUP BY ALL),
      c AS (SELECT day, security, round((sum(q) - coalesce(sum(q) FILTER (buy), 0)) * round(sum(q * p) / sum(q), 2) * 0.00025, 2) AS tax, coalesce(sum(q) FILTER (buy), 0) = coalesce(sum(q) FILTER (NOT buy), 0) AS flat FROM t GROUP BY ALL),
      d AS (SELECT day, sum(b) AS brokerage, sum(v) AS turnover, sum(coalesce(bv, 0)) * 0.00003 AS stamp, sum(v) * 10e-7 AS regulator, count(*) AS orders,
        sum(v) * CASE WHEN day >= '1995-06-17' THEN 306.99e-7 ELSE 297e-7 END AS exchange, sum(v) * CASE WHEN day >= '1995-06-17' THEN 0.01e-7 ELSE 10e-7 END AS fund FROM o GROUP BY day)
    SELECT d.day, round(brokerage, 3) AS brokerage, round(exchange, 3) AS exchange, round(fund, 3) AS fund, round(regulator, 3) AS regulator, round((brokerage + exchange + fund + regulator) * 0.18, 3) AS service,
      round(stamp, 3) AS stamp, tax, orders, flat FROM d JOIN (SELECT day, round(round(sum(tax), 2), 0) AS tax, bool_and(flat) AS flat FROM c GROUP BY day) USING (day)""",
)
def charges(spark, sf_dir):
    """Every line bought and sold on its day, some a unit short; rates that change on a day."""
    line = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_orderkey", F.col("l_partkey").alias("security"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    short = F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)
    sides = F.array(
        F.struct(F.concat(F.lit("b"), "l_orderkey").alias("order_id"), F.lit(True).alias("buy"), F.col("q").alias("quantity"), F.col("p").alias("price")),
        F.struct(F.concat(F.lit("s"), "l_orderkey").alias("order_id"), F.lit(False).alias("buy"), (F.col("q") - short).alias("quantity"), (F.col("p") * 1.0137).alias("price")),
    )
    trades = line.select("day", "security", "q", F.explode(sides).alias("t")).select("day", "security", "q", "t.*").where("buy or q > 1")
    rates = [(ledger.RATES[0][0], *ledger.RATES[0][1:]), ("1995-06-17", *ledger.RATES[1][1:])]
    out = ledger.charges(trades, rates)
    return out.select("day", *[F.round(c, 3).alias(c) for c in ("brokerage", "exchange", "fund", "regulator", "service", "stamp")], "tax", "orders", "flat")


_FILLS = f"SELECT user_id, symbol, t // {HOUR} * {HOUR} AS open_time, CASE WHEN symbol = 'purchase' THEN 1 ELSE -1 END * (k + 1)::DOUBLE AS signed, price * 1.001 AS price FROM ticks WHERE symbol IN ('purchase', 'click')"


@query(
    "A-22",
    sql(
        """SELECT user_id, round(-sum(signed * open), 2) + 0.0 AS gross, round(sum(signed * (price - open)), 2) + 0.0 AS slippage, round(sum(abs(signed * price) * 0.001), 2) + 0.0 AS fees, round(sum(abs(signed) * price), 2) AS notional,
        round((sum(abs(signed * price) * 0.001) + sum(signed * (price - open))) / sum(abs(signed) * price) * 10000, 2) + 0.0 AS drag_bps FROM f JOIN h USING (symbol, open_time) GROUP BY user_id""",
        f=_FILLS,
    ),
)
def cost_attribution(spark, sf_dir):
    """Fills of every user against the opens of their hours."""
    side = F.when(F.col("symbol") == "purchase", 1).otherwise(-1)
    fills = ticks(spark, sf_dir).where("symbol in ('purchase', 'click')").select(
        "user_id", "symbol", (F.expr(f"t div {HOUR}") * HOUR).alias("open_time"), (side * (F.col("k") + 1)).cast("double").alias("signed"), (F.col("price") * 1.001).alias("price")
    )
    opens = bars(spark, sf_dir, HOUR).select("symbol", "open_time", F.col("open").alias("opening"))
    out = ledger.attribution(fills, opens, "user_id", F.abs(F.col("signed") * F.col("price")) * 0.001)
    return out.select("user_id", *[(F.round(c, 2) + 0.0).alias(c) for c in ("gross", "slippage", "fees", "notional", "drag_bps")])


_OFFICIAL = f"""SELECT symbol, open_time AS day, CASE WHEN open_time // {DAY} % 9 = 0 THEN high * 1.1 ELSE high END AS high, CASE WHEN open_time // {DAY} % 9 = 0 THEN low * 1.1 WHEN open_time // {DAY} % 7 = 2 THEN low * 0.9 ELSE low END AS low, volume * 1.5 AS volume,
  'IN' || symbol || CASE WHEN open_time // {DAY} % 13 = 4 THEN '2' ELSE '1' END AS isin, symbol = 'purchase' AND open_time // {DAY} % 2 = 0 AS capital FROM d WHERE open_time // {DAY} % 11 <> 3"""


def official(spark, sf_dir):
    """A daily reference with other prices on some days, another ISIN on some, days without one and capital actions."""
    n = F.expr(f"open_time div {DAY}")
    rows = bars(spark, sf_dir, DAY).where(n % 11 != 3)
    low = F.when(n % 9 == 0, F.col("low") * 1.1).when(n % 7 == 2, F.col("low") * 0.9).otherwise(F.col("low"))
    isin = F.concat(F.lit("IN"), "symbol", F.when(n % 13 == 4, "2").otherwise("1"))
    return rows.select(
        "symbol", F.col("open_time").alias("day"), F.when(n % 9 == 0, F.col("high") * 1.1).otherwise(F.col("high")).alias("high"), low.alias("low"), (F.col("volume") * 1.5).alias("volume"),
        isin.alias("isin"), ((F.col("symbol") == "purchase") & (n % 2 == 0)).alias("capital"),
    )


@query(
    "A-32",
    sql(
        """SELECT symbol, day, CASE WHEN abs(h - high) > 0.002 * abs(high) OR abs(l - low) > 0.002 * abs(low) THEN 'off scale' ELSE 'ok' END AS status, least(h / high, l / low) > 1.05 OR greatest(h / high, l / low) < 0.95 AS shifted
        FROM q JOIN (SELECT symbol, day, max(high) AS h, min(low) AS l FROM s GROUP BY ALL) USING (symbol, day)""",
        **_S,
        q=_OFFICIAL,
    ),
)
def price_screens(spark, sf_dir):
    from barloom.operators import joins

    told, rows = official(spark, sf_dir), slots(spark, sf_dir)
    close = joins.price_screen(rows, told.withColumnRenamed("day", "open_time"), 0.002).select("symbol", F.col("open_time").alias("day"), "status")
    return close.join(intraday.scale_shift(rows, told), ["symbol", "day"])


@query(
    "A-33",
    sql(
        """SELECT symbol, string_agg(DISTINCT isin, ',' ORDER BY isin) AS isins, round(max(greatest(abs(h / high - 1), abs(l / low - 1))), 6) AS worst, round(min(v / volume), 6) AS least_volume, round(max(v / volume), 6) AS most_volume
        FROM q JOIN (SELECT symbol, day, max(high) AS h, min(low) AS l, sum(volume) AS v FROM s GROUP BY ALL) USING (symbol, day) GROUP BY symbol""",
        **_S,
        q=_OFFICIAL,
    ),
)
def certification(spark, sf_dir):
    out = intraday.certification(slots(spark, sf_dir), official(spark, sf_dir))
    return out.select("symbol", "isins", *[F.round(c, 6).alias(c) for c in ("worst", "least_volume", "most_volume")])


@query(
    "Q-07",
    sql(
        f"""SELECT symbol, day, CASE WHEN q.high IS NULL THEN 'NO_DAILY_IDENTITY_REFERENCE' WHEN capital THEN 'UNRESOLVED_CAPITAL_ACTION_UNITS'
          WHEN abs(h - q.high) > 0.002 * abs(q.high) OR abs(l - q.low) > 0.002 * abs(q.low) THEN 'SCALE_MISMATCH' WHEN isin <> 'IN' || symbol || '1' THEN 'UNVERIFIED_ISIN_CONTINUITY'
          WHEN n <> {_DAYNO} % 3 + 4 AND n <> 24 THEN 'INCOMPLETE_SESSION' WHEN idle > 0 THEN 'ZERO_VOLUME_SESSION' ELSE 'PASS_SCALE_SCREEN' END AS status
        FROM (SELECT symbol, day, max(high) AS h, min(low) AS l, count(*) AS n, count(*) FILTER (open_time // {HOUR} % 37 = 0) AS idle FROM s GROUP BY ALL) LEFT JOIN q USING (symbol, day)""",
        **_S,
        q=_OFFICIAL,
    ),
)
def session_screen(spark, sf_dir):
    """Statuses of all symbol-days; sessions count as whole with the slots of their day's calendar, or with all 24."""
    rows = slots(spark, sf_dir).withColumns({"isin": F.concat(F.lit("IN"), "symbol", F.lit("1")), "volume": F.when(F.expr(f"open_time div {HOUR}") % 37 == 0, 0.0).otherwise(F.col("volume"))})
    sizes = rows.groupBy("symbol", "day").agg(F.count("*").alias("n"))
    slots_of = F.expr(f"day div {DAY}") % 3 + 4
    # a full day of 24 slots is a special session of its symbol
    special = sizes.where("n = 24").select("symbol", "day")
    calendar = sizes.select("day").distinct().withColumn("slots", slots_of)
    usual = intraday.screen(rows.join(special, ["symbol", "day"], "left_anti"), official(spark, sf_dir), calendar, 0.002)
    return usual.unionByName(intraday.screen(rows.join(special, ["symbol", "day"], "left_semi"), official(spark, sf_dir), calendar.withColumn("slots", F.lit(24)), 0.002))


_BOOK = "SELECT user_id, t, event_id, CASE symbol WHEN 'purchase' THEN 1 ELSE -1 END * (k + 1)::DOUBLE AS signed, price FROM ticks WHERE symbol IN ('purchase', 'click')"
FIELDS = ["quantity", "average", "realised", "cash", "fees"]


@query(
    "Q-09",
    sql(
        f"""SELECT coalesce(e.user_id, r.user_id) AS user_id, coalesce(e.event_id, r.event_id) AS event_id, CASE WHEN r.event_id IS NULL THEN 'not recorded' WHEN e.event_id IS NULL THEN 'no replay' ELSE field END AS problem,
          CASE WHEN r.event_id IS NOT NULL AND e.event_id IS NOT NULL THEN round(ev, 3) + 0.0 END AS expected, CASE WHEN r.event_id IS NOT NULL AND e.event_id IS NOT NULL THEN round(rv, 3) + 0.0 END AS recorded
        FROM e FULL JOIN r ON e.user_id = r.user_id AND e.event_id = r.event_id,
          LATERAL (SELECT unnest({FIELDS}) AS field, unnest([e.quantity, e.average, e.realised, e.cash, e.fees]) AS ev, unnest([r.quantity, r.average, r.realised, r.cash, r.fees]) AS rv) x
        WHERE (r.event_id IS NULL OR e.event_id IS NULL) AND field = 'quantity' OR abs(ev - rv) > 0.0005""",
        f=_BOOK,
        n="SELECT user_id AS account, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn, signed AS s, price AS p FROM f",
        z="""SELECT account, rn, s AS q, p AS a, 0.0::DOUBLE AS g, -s * p AS cash, abs(s * p) * 0.001 AS fee FROM n WHERE rn = 1
          UNION ALL SELECT n.account, n.rn, q + s,
            CASE WHEN q = 0 OR sign(q) = sign(s) THEN (a * abs(q) + p * abs(s)) / (abs(q) + abs(s)) WHEN q + s = 0 THEN 0 WHEN sign(q + s) = sign(q) THEN a ELSE p END,
            g + CASE WHEN q = 0 OR sign(q) = sign(s) THEN 0 ELSE least(abs(s), abs(q)) * (p - a) * sign(q) END, cash - s * p, fee + abs(s * p) * 0.001
          FROM z JOIN n ON n.account = z.account AND n.rn = z.rn + 1""",
        e="SELECT z.account AS user_id, id AS event_id, q AS quantity, a AS average, g AS realised, cash, fee AS fees FROM z JOIN n ON n.account = z.account AND n.rn = z.rn WHERE id % 5 = 0",
        r="""SELECT user_id, CASE WHEN event_id % 45 = 0 THEN event_id + 1000000000 ELSE event_id END AS event_id, quantity, average + CASE WHEN event_id % 55 = 0 THEN 1 ELSE 0 END AS average,
          realised - CASE WHEN event_id % 65 = 0 THEN 3 ELSE 0 END AS realised, cash + CASE WHEN event_id % 35 = 0 THEN 1 ELSE 0 END AS cash, fees + CASE WHEN event_id % 25 = 0 THEN 2 ELSE 0 END AS fees FROM e""",
    ).replace("WITH ticks", "WITH RECURSIVE ticks", 1),
)
def checkpoints(spark, sf_dir):
    """Recorded books of every fifth fill against a replay of all fills at average cost, both ways round."""
    side = F.when(F.col("symbol") == "purchase", 1).otherwise(-1)
    fills = ticks(spark, sf_dir).where("symbol in ('purchase', 'click')").select("user_id", "t", "event_id", (side * (F.col("k") + 1)).cast("double").alias("signed"), "price")
    replayed = ledger.replayed(fills, "user_id", 10.0).where("event_id % 5 = 0").select("user_id", "event_id", *FIELDS)
    replayed = stores.settle(replayed)
    wrong = lambda every, by: F.when(F.col("event_id") % every == 0, by).otherwise(0)
    recorded = replayed.withColumns({"average": F.col("average") + wrong(55, 1), "realised": F.col("realised") - wrong(65, 3), "cash": F.col("cash") + wrong(35, 1), "fees": F.col("fees") + wrong(25, 2)})
    recorded = recorded.withColumn("event_id", F.when(F.col("event_id") % 45 == 0, F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id")))
    out = ledger.reconcile(replayed, recorded, ["user_id", "event_id"], FIELDS, 5e-4)
    return out.select("user_id", "event_id", "problem", (F.round("expected", 3) + 0.0).alias("expected"), (F.round("recorded", 3) + 0.0).alias("recorded"))


@query(
    "X-06",
    sql(
        """SELECT symbol, open_time, CASE WHEN lag(close, 2) OVER y IS NOT NULL THEN (close > lag(close, 2) OVER y)::INT::DOUBLE END AS trend, CASE WHEN lag(close, 2) OVER y IS NOT NULL THEN (close < lag(close, 2) OVER y)::INT::DOUBLE END AS contrarian, 1.0::DOUBLE AS "long"
        FROM s WINDOW y AS (PARTITION BY symbol, day ORDER BY slot)""",
        **_S,
    ),
)
def templates(spark, sf_dir):
    return intraday.templates(slots(spark, sf_dir), 2).select("symbol", "open_time", "trend", "contrarian", "long")


@query(
    "W-35",
    sql(
        f"""SELECT symbol, open_time, n, round(first, 5) + 0.0 AS first, round(last, 5) + 0.0 AS last FROM (SELECT symbol, open_time, count(*) OVER z AS n, first(x) OVER z AS first, x AS last, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS l
          FROM (SELECT symbol, open_time, (close - m) / nullif(sd, 0) AS x FROM h LEFT JOIN (SELECT symbol, avg(close) AS m, stddev_pop(close) AS sd FROM h WHERE open_time < {EDGE} GROUP BY symbol) USING (symbol))
          WINDOW z AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) WHERE n = 100 AND l > 10"""
    ),
)
def window_arrays(spark, sf_dir):
    """Windows of 100 closes scaled by TRAIN alone, without those whose horizon of ten bars is cut."""
    rows = features.normalised(bars(spark, sf_dir, HOUR).select("symbol", "open_time", "close"), "close", F.col("open_time") < EDGE)
    rows = features.window_arrays(rows, "close", 100, 10)
    return rows.select("symbol", "open_time", F.size("values").cast("long").alias("n"), (F.round(F.col("values")[0], 5) + 0.0).alias("first"), (F.round(F.element_at("values", -1), 5) + 0.0).alias("last"))
