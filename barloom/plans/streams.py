"""Streaming queries (R-*, K-09, S-18): messages made from the tables, with every fault that a feed has, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.plans.base import DAY, HOUR, bars, query, r, sql, table
from barloom.sources import stores
from barloom.streaming import closed_bars as cb

_HX = f"(open_time // {HOUR})"
#: Messages in SQL: symbol, hx, seq (order of arrival), open_time, close, status.
_FEED = dict(
    b=f"SELECT symbol, {_HX} AS hx, open_time, close FROM h",
    m="""SELECT symbol, hx, CASE WHEN hx % 31 = 0 THEN (hx + 5) * 10 + 3 ELSE hx * 10 END AS seq, CASE WHEN hx % 37 = 0 THEN open_time + 5000000 ELSE open_time END AS open_time, close,
        CASE WHEN hx % 50 = 0 THEN 'malformed' ELSE 'closed' END AS status FROM b
      UNION ALL SELECT symbol, hx, hx * 10 - 1, open_time, close, 'open' FROM b WHERE hx % 17 = 0
      UNION ALL SELECT symbol, hx, hx * 10 + 1, open_time, close, 'closed' FROM b WHERE hx % 23 = 0
      UNION ALL SELECT symbol, hx, hx * 10 + 2, open_time, close + 1, 'closed' FROM b WHERE hx % 29 = 0""",
    a0=f"""SELECT *, max(open_time) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
      first(close) OVER (PARTITION BY symbol, open_time ORDER BY seq) AS f FROM m WHERE status = 'closed' AND open_time % {HOUR} = 0""",
    a1=f"""SELECT *, CASE WHEN seen IS NULL OR open_time - seen = {HOUR} THEN 'ACCEPTED' WHEN open_time > seen THEN 'GAP' WHEN open_time < seen THEN 'OUT_OF_ORDER' WHEN close = f THEN 'DUPLICATE' ELSE 'CONFLICT' END AS event FROM a0""",
    a2=f"SELECT *, CASE WHEN event = 'GAP' THEN (open_time - seen) // {HOUR} - 1 ELSE 0 END AS missing FROM a1",
)
PARTS = 3


def messages(spark, sf_dir):
    """(body, seq, part): closed bars, some malformed, late, off the grid, doubled or contradicted, and updates in progress."""
    hx = F.expr(f"open_time div {HOUR}")
    rows = bars(spark, sf_dir, HOUR).withColumns({"hx": hx, "closed": F.lit(True), "bad": F.lit(False)})
    shifted = F.when(F.col("hx") % 37 == 0, 5_000_000).otherwise(0)
    usual = rows.withColumns({
        "seq": F.when(F.col("hx") % 31 == 0, (F.col("hx") + 5) * 10 + 3).otherwise(F.col("hx") * 10), "bad": F.col("hx") % 50 == 0,
        "open_time": F.col("open_time") + shifted, "close_time": F.col("close_time") + shifted,
    })
    update = rows.where("hx % 17 = 0").withColumns({"seq": F.col("hx") * 10 - 1, "closed": F.lit(False)})
    again = rows.where("hx % 23 = 0").withColumn("seq", F.col("hx") * 10 + 1)
    other = rows.where("hx % 29 = 0").withColumns({"seq": F.col("hx") * 10 + 2, "close": F.col("close") + 1, "high": F.greatest("high", F.col("close") + 1)})
    sent = usual.unionByName(update).unionByName(again).unionByName(other)
    body = cb.encode(sent.withColumn("_", F.lit(0)), "1h", F.col("closed"), keep=["seq", "bad"])
    body = body.withColumn("arrived", F.col("seq") * (HOUR // 10) + HOUR)
    part = F.least(F.expr(f"(seq - 10 * {1704067200000000 // HOUR}) div 2400"), F.lit(PARTS - 1))
    return body.select(F.when(F.col("bad"), F.concat(F.lit("{broken"), F.substring("body", 1, 20))).otherwise(F.col("body")).alias("body"), "seq", "arrived", part.alias("part"))


def _source(spark, root):
    return spark.readStream.schema("body string, seq long, arrived long").parquet(f"{root}/in")


_RUNS: dict[tuple[str, str], str] = {}
#: A symbol that has had no fresh close for so long is silent.
SILENCE = HOUR // 2


def followed(spark, sf_dir):
    """The folder of a feed followed to its end: its messages come in three parts, and the stream is stopped and started again
    from its checkpoint in between. Once a session and path."""
    key = (spark.sparkContext.applicationId, stores.listing(table(spark, sf_dir, "events")))
    if key not in _RUNS:
        root = stores.shared_root(spark, "streams")
        feed = stores.settle(messages(spark, sf_dir))
        for part in range(PARTS):
            feed.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/in")
            cb.follow(_source(spark, root), root, HOUR, SILENCE // 1000, state_partitions=2).write.mode("append").parquet(f"{root}/progress")
        _RUNS[key] = root
    return _RUNS[key]


def _told(spark, sf_dir):
    return cb.sunk(spark, followed(spark, sf_dir), "events").where("event <> 'HALT'")


def _kept(spark, sf_dir):
    return cb.sunk(spark, followed(spark, sf_dir), "bars")


@query("R-01", sql("SELECT status, count(*) AS n, round(sum(CASE WHEN status <> 'malformed' THEN close END), 4) AS total FROM m GROUP BY status", **_FEED))
def decoded(spark, sf_dir):
    rows = cb.decode(messages(spark, sf_dir).drop("part"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("status") != "malformed", F.col("close"))), 4).alias("total"))


@query("R-02", sql(f"SELECT symbol, count(*) AS n, count(*) FILTER (open_time % {HOUR} = 0) AS good FROM m WHERE status = 'closed' GROUP BY symbol", **_FEED))
def contracted(spark, sf_dir):
    rows = cb.decode(messages(spark, sf_dir).drop("part")).where("status = 'closed'")
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(cb.contract(HOUR)).alias("good"))


@query("R-03", sql("SELECT symbol, open_time, seq, event, missing FROM a2 WHERE event <> 'ACCEPTED'", **_FEED))
def watermarks(spark, sf_dir):
    """All events of the high-water marks over three runs of the stream."""
    return _told(spark, sf_dir).where("event in ('GAP', 'DUPLICATE', 'CONFLICT', 'OUT_OF_ORDER')").select("symbol", "open_time", "seq", "event", "missing")


@query("R-08", sql("SELECT symbol, count(*) FILTER (event = 'OUT_OF_ORDER') AS late, max(open_time) FILTER (event IN ('ACCEPTED', 'GAP')) AS mark FROM a2 GROUP BY symbol", **_FEED))
def late_rows(spark, sf_dir):
    """Late rows are told, and the last mark is that of the accepted bars alone."""
    late = _told(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("event") == "OUT_OF_ORDER").alias("late"))
    marks = _kept(spark, sf_dir).groupBy("symbol").agg(F.max("open_time").alias("mark"))
    return marks.join(late, "symbol", "left").select("symbol", F.coalesce("late", F.lit(0).cast("long")).alias("late"), "mark")


@query("K-09", sql("SELECT 'bars' AS sink, count(*) AS n FROM a2 WHERE event IN ('ACCEPTED', 'GAP') UNION ALL SELECT 'events', (SELECT count(*) FROM m) - (SELECT count(*) FROM a2 WHERE event = 'ACCEPTED')", **_FEED))
def two_sinks(spark, sf_dir):
    each = [rows.agg(F.lit(name).alias("sink"), F.count("*").alias("n")) for name, rows in (("bars", _kept(spark, sf_dir)), ("events", _told(spark, sf_dir)))]
    return each[0].unionByName(each[1])


@query(
    "R-06",
    sql(
        f"""SELECT x.symbol, coalesce(accepted, 0) AS accepted, coalesce(elapsed, 0) AS elapsed, coalesce(updates, 0) AS updates, coalesce(gaps, 0) AS gaps, coalesce(missing, 0)::BIGINT AS missing, coalesce(rejected, 0) + coalesce(refused, 0) AS rejected FROM
        (SELECT symbol, count(*) FILTER (event IN ('ACCEPTED', 'GAP')) AS accepted, max(open_time) FILTER (event IN ('ACCEPTED', 'GAP')) - min(open_time) FILTER (event IN ('ACCEPTED', 'GAP')) + {HOUR} AS elapsed,
          count(*) FILTER (event = 'GAP') AS gaps, sum(missing) AS missing, count(*) FILTER (event IN ('DUPLICATE', 'CONFLICT', 'OUT_OF_ORDER')) AS rejected FROM a2 GROUP BY symbol) x
        LEFT JOIN (SELECT symbol, count(*) FILTER (status = 'open') AS updates, count(*) FILTER (status = 'closed' AND open_time % {HOUR} <> 0) AS refused FROM m GROUP BY symbol) y ON x.symbol = y.symbol""",
        **_FEED,
    ),
)
def stream_summary(spark, sf_dir):
    return cb.summary(_kept(spark, sf_dir), _told(spark, sf_dir))


_PART = f"least((seq - 10 * {1704067200000000 // HOUR}) // 2400, {PARTS - 1})"
_ARRIVED = f"seq * {HOUR // 10} + {HOUR}"


@query(
    "R-07",
    sql(
        f"""SELECT DISTINCT symbol, mark, expires FROM (SELECT k.p, symbol, max_by(open_time, seq) AS mark, max({_ARRIVED}) + {SILENCE} AS expires
          FROM k JOIN a2 ON {_PART} <= k.p WHERE event IN ('ACCEPTED', 'GAP') GROUP BY ALL) JOIN (SELECT k.p, max({_ARRIVED}) - 1000000 AS clock FROM k JOIN m ON {_PART} <= k.p GROUP BY ALL) USING (p) WHERE expires <= clock""",
        **_FEED,
        k=f"SELECT DISTINCT {_PART} AS p FROM m",
    ),
)
def stale_symbols(spark, sf_dir):
    """One HALT for each silence, by the timers of the stream's state: no message of the symbol itself is needed."""
    halts = cb.sunk(spark, followed(spark, sf_dir), "events").where("event = 'HALT'")
    return halts.select("symbol", F.col("open_time").alias("mark"), F.col("arrived").alias("expires"))


@query("R-10", sql(f"SELECT symbol, open_time, CASE WHEN open_time - lag(open_time, 1) OVER w = {HOUR} AND close > 0 AND lag(close) OVER w > 0 THEN round(ln(close / lag(close) OVER w), 6) + 0.0 END AS return_1 FROM a2 WHERE event IN ('ACCEPTED', 'GAP') WINDOW w AS (PARTITION BY symbol ORDER BY open_time) QUALIFY open_time >= 1706140800000000", **_FEED))
def live_features(spark, sf_dir):
    """The last days' bars as they came, with the stored ones before them as history."""
    rows = _kept(spark, sf_dir).drop("event", "missing", "seq", "arrived", "event_time")
    edge = 1706140800000000
    new, stored = rows.where(F.col("open_time") >= edge), rows.where(F.col("open_time") < edge)
    return cb.live_features(new, stored, HOUR, ["return_1", "taker_ratio"]).select("symbol", "open_time", r("return_1", "return_1"))


@query("R-11", sql("SELECT symbol, (open_time + 3600000000) // 60000000 * 60000000 AS minute, close AS price FROM m WHERE status = 'open' AND close > 0", **_FEED))
def last_prices(spark, sf_dir):
    return cb.observed_prices(cb.decode(messages(spark, sf_dir).drop("part")))


@query("S-18", sql("SELECT CASE WHEN status = 'malformed' THEN NULL ELSE symbol END AS symbol, status, count(*) AS n FROM m GROUP BY ALL", **_FEED))
def stream_source(spark, sf_dir):
    """The feed read as a stream and counted by the file sink's rows."""
    root = stores.shared_root(spark, "streams")
    messages(spark, sf_dir).drop("part").write.parquet(f"{root}/in")
    cb.drain(cb.decode(_source(spark, root)).select("symbol", "status"), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").groupBy("symbol", "status").agg(F.count("*").alias("n"))


@query("R-04", sql("SELECT DISTINCT symbol, open_time FROM m WHERE status = 'closed'", **_FEED))
def replayed_closes(spark, sf_dir):
    """Closed bars once each, however often they are sent, by the stream's own de-duplication within the watermark."""
    root = stores.shared_root(spark, "streams")
    messages(spark, sf_dir).drop("part").write.parquet(f"{root}/in")
    rows = cb.decode(_source(spark, root)).where("status = 'closed'")
    cb.drain(cb.once(rows, "30 days").select("symbol", "open_time"), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


@query("R-05", sql(f"""SELECT symbol, open_time, round(close, 6) AS close, volume FROM (SELECT symbol, open_time // {2 * HOUR} * {2 * HOUR} AS open_time, arg_max(close, open_time) AS close, sum(volume) AS volume, count(*) AS n FROM h GROUP BY symbol, open_time // {2 * HOUR})
  WHERE n = 2 AND open_time + {4 * HOUR} <= (SELECT max(open_time) FROM h)"""))
def stream_resampled(spark, sf_dir):
    """Complete two-hour bars of the stream; windows that the final watermark has not passed stay open."""
    root = stores.shared_root(spark, "streams")
    cb.encode(bars(spark, sf_dir, HOUR), "1h").write.parquet(f"{root}/in")
    rows = cb.decode(spark.readStream.schema("body string").parquet(f"{root}/in"))
    cb.drain(cb.resample(rows, HOUR, 2 * HOUR), f"{root}/out", f"{root}/state")
    out = spark.read.schema("symbol string, open_time long, open double, high double, low double, close double, volume double").parquet(f"{root}/out")
    return out.select("symbol", "open_time", r("close", "close"), "volume")


@query("R-09", sql(f"SELECT symbol, open_time // {DAY} AS day, count(*) AS n, 0::BIGINT AS early FROM h GROUP BY ALL"))
def replayed(spark, sf_dir):
    """History replayed as a stream in order of close time, then symbol, in batches; ``early`` counts rows that come in a later
    batch than a row that closes after them."""
    root = stores.shared_root(spark, "streams")
    cb.replay(bars(spark, sf_dir, HOUR), root, pieces=6)
    rows = cb.replayed(spark, root)
    return rows.groupBy("symbol", F.expr(f"open_time div {DAY}").alias("day")).agg(F.count("*").alias("n"), F.count_if("early").alias("early"))
