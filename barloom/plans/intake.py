"""Intake queries: raw files, readers, exports, versions and the build of a store (S-*, K-*, Q-04, Q-06, P-10, P-15, J-10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import clock, ts
from barloom.operators import build, features, joins, labels, quality, registry
from barloom.plans.base import DAY, HOUR, bars, query, r, sql, table
from barloom.schema import KLINE
from barloom.sources import readers, stores

_MONTH = "strftime(make_timestamp(open_time), '%Y-%m')"
_HX = f"(open_time // {HOUR})"
#: Hourly bars as a source would send them: even days in milliseconds, some wrong closes, refused clocks and repeated rows.
_RAW = f"""SELECT symbol, {_MONTH} AS month, {_HX} AS hx, open_time AS us, 0 AS again,
    CASE WHEN {_HX} % 97 = 5 THEN 1 WHEN open_time // {DAY} % 2 = 0 THEN open_time // 1000 ELSE open_time END AS open_time,
    open, high, low, CASE WHEN {_HX} % 50 = 0 THEN high + 1 ELSE close END AS close, volume FROM h"""
_SENT = "SELECT * FROM raw UNION ALL SELECT * REPLACE (1 AS again, close + 1 AS close) FROM raw WHERE hx % 40 = 3"


def _hour():
    return F.expr(f"open_time div {HOUR}")


def raw_rows(spark, sf_dir):
    """Rows of the twelve file columns with symbol, month and seq (the order of lines)."""
    rows = bars(spark, sf_dir, HOUR)
    month = F.date_format(F.date_from_unix_date(F.expr(f"open_time div {DAY}").cast("int")), "yyyy-MM")
    rows = rows.withColumns({"month": month, "hx": _hour(), "seq": F.col("open_time"), "ignore": F.lit(0.0)})
    milli = F.expr(f"open_time div {DAY}") % 2 == 0
    sent = rows.withColumns({
        "close": F.when(F.col("hx") % 50 == 0, F.col("high") + 1).otherwise(F.col("close")),
        "close_time": F.when(milli, F.expr("close_time div 1000")).otherwise(F.col("close_time")),
        "open_time": F.when(F.col("hx") % 97 == 5, F.lit(1)).when(milli, F.expr("open_time div 1000")).otherwise(F.col("open_time")),
    })
    again = sent.where("hx % 40 = 3").withColumns({"close": F.col("close") + 1, "seq": F.col("seq") + 1})
    return sent.unionByName(again).select("symbol", "month", "seq", *[f.name for f in KLINE.fields])


def archives(spark, sf_dir):
    return readers.pack_klines(raw_rows(spark, sf_dir), "1h")


@query("S-01", sql("SELECT symbol || '-1h-' || month || '.zip' AS file, open_time, round(close, 6) AS close, volume FROM sent", raw=_RAW, sent=_SENT))
def zipped_klines(spark, sf_dir):
    return readers.parse_zipped_klines(archives(spark, sf_dir)).select("file", "open_time", r("close", "close"), "volume")


@query("S-02", sql("SELECT symbol, month, count(*) AS n, round(sum(close), 4) AS total FROM sent GROUP BY ALL", raw=_RAW, sent=_SENT))
def all_months(spark, sf_dir):
    rows = readers.history(archives(spark, sf_dir))
    return rows.groupBy("symbol", "month").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


_BAD = "NOT (open > 0 AND high > 0 AND low > 0 AND close > 0) OR close NOT BETWEEN low AND high"


@query(
    "Q-06",
    sql(
        f"""SELECT c.symbol, c.read, c.refused, c.files, c.written, c.problems, coalesce(g.gap_runs, 0) AS gap_runs, coalesce(g.missing, 0)::BIGINT AS missing,
          c.read - c.refused - c.written AS repeated
        FROM (SELECT symbol, count(*) AS read, count(*) FILTER (open_time = 1) AS refused, count(DISTINCT month) AS files,
            count(*) FILTER (again = 0 AND open_time <> 1) AS written, count(*) FILTER (open_time <> 1 AND ({_BAD})) AS problems FROM sent GROUP BY symbol) c
        LEFT JOIN (SELECT symbol, count(*) AS gap_runs, sum((nxt - us) // {HOUR} - 1)::BIGINT AS missing
          FROM (SELECT symbol, us, lead(us) OVER (PARTITION BY symbol ORDER BY us) AS nxt FROM raw WHERE open_time <> 1) WHERE nxt - us > {HOUR} GROUP BY symbol) g
        ON c.symbol = g.symbol""",
        raw=_RAW,
        sent=_SENT,
    ),
)
def built(spark, sf_dir):
    """Files to a store of bars with its reports, and the counters of each symbol."""
    return build.build(readers.history(archives(spark, sf_dir)).drop("month", "ignore"), HOUR, stores.shared_root(spark, "builds"))


_SHIFTED = f"SELECT symbol, CASE WHEN {_HX} % 60 = 7 THEN open_time + 5 ELSE open_time END AS open_time, open, high, low, CASE WHEN {_HX} % 50 = 0 THEN high + 1 ELSE close END AS close FROM h"


def _shifted(spark, sf_dir):
    close = F.when(_hour() % 50 == 0, F.col("high") + 1).otherwise(F.col("close"))
    rows = bars(spark, sf_dir, HOUR).withColumn("close", close)
    return rows.withColumn("open_time", F.when(_hour() % 60 == 7, F.col("open_time") + 5).otherwise(F.col("open_time")))


_PROBLEM = """concat_ws(', ', CASE WHEN NOT (open > 0 AND high > 0 AND low > 0 AND close > 0) THEN 'price not above zero' END,
  CASE WHEN open NOT BETWEEN low AND high THEN 'open outside range' END, CASE WHEN close NOT BETWEEN low AND high THEN 'close outside range' END)"""


@query(
    "Q-04",
    sql(
        f"""SELECT symbol, open_time, problem, strftime(make_timestamp(open_time), '%Y-%m-%d %H:%M:%S') AS utc
        FROM (SELECT symbol, open_time, {_PROBLEM} AS problem FROM s UNION ALL SELECT symbol, open_time, 'off grid' FROM s WHERE open_time % {HOUR} <> 0) WHERE problem <> ''""",
        s=_SHIFTED,
    ),
)
def combined_report(spark, sf_dir):
    return quality.report(_shifted(spark, sf_dir), HOUR)


@query(
    "F-14",
    """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(', ', CASE WHEN l_quantity > 45 THEN 'large quantity' END, CASE WHEN l_discount > 0.08 THEN 'high discount' END,
      CASE WHEN l_tax = 0 THEN 'no tax' END) AS problem FROM lineitem""",
)
def broken_rules(spark, sf_dir):
    rules = [("large quantity", "l_quantity > 45"), ("high discount", "l_discount > 0.08"), ("no tax", "l_tax = 0")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quality.problems(rules).alias("problem"))


@query(
    "K-03",
    sql(
        f"""SELECT 'validation' AS report, count(*) AS n, 'symbol,open_time,problem,utc' AS columns FROM (SELECT 1 FROM s WHERE {_PROBLEM} <> '' UNION ALL SELECT 1 FROM s WHERE open_time % {HOUR} <> 0)
        UNION ALL SELECT 'gaps', 0, 'symbol,gap_start,gap_end,missing' FROM (SELECT count(*) FROM s)""",
        s=_SHIFTED,
    ),
)
def written_reports(spark, sf_dir):
    """Both reports are there after a run that has no gap to report."""
    rows = _shifted(spark, sf_dir)
    lonely = rows.groupBy("symbol").agg(F.min("open_time").alias("open_time"))
    root = stores.shared_root(spark, "reports")
    stores.write_reports(root, validation=quality.report(rows, HOUR), gaps=quality.gaps(lonely, HOUR))
    back = {name: spark.read.parquet(f"{root}/{name}") for name in ("validation", "gaps")}
    each = [b.agg(F.lit(name).alias("report"), F.count("*").alias("n"), F.lit(",".join(b.columns)).alias("columns")) for name, b in back.items()]
    return each[0].unionByName(each[1])


@query("K-04", "SELECT count(*) AS n, 'refused' AS second FROM orders WHERE o_orderstatus = 'F'")
def exclusive_creation(spark, sf_dir):
    rows, path = table(spark, sf_dir, "orders"), f"{stores.shared_root(spark, 'once')}/result"
    stores.write_once(rows.where("o_orderstatus = 'F'"), path)
    second = "written" if stores.write_once(rows, path) else "refused"
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.lit(second).alias("second"))


@query("K-05", sql("SELECT symbol, open_time, round(close, 6) AS close FROM h"))
def csv_export(spark, sf_dir):
    path = f"{stores.shared_root(spark, 'exports')}/csv"
    stores.export_csv(bars(spark, sf_dir, HOUR).select("symbol", "open_time", "close"), path)
    return spark.read.schema("symbol string, open_time long, close double").option("header", True).csv(path).withColumn("close", r("close"))


@query("K-08", sql("SELECT symbol, open_time, round(close, 6) AS close FROM h"))
def record_export(spark, sf_dir):
    path = f"{stores.shared_root(spark, 'exports')}/json"
    stores.export_records(bars(spark, sf_dir, HOUR).select("symbol", "open_time", "close"), path)
    return spark.read.schema("symbol string, open_time long, close double").json(path).withColumn("close", r("close"))


@query("K-06", "SELECT c_custkey AS symbol, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS venue FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def upserted(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("venue"))
    return registry.upsert(rows.where("symbol % 3 <> 0"), rows.where("symbol % 2 = 0").withColumn("venue", F.lit("new")), ["symbol"])


@query("K-07", "SELECT page_id, sha256(html) AS id FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0)")
def inserted_if_absent(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("id"))
    return registry.insert_absent(rows.where("page_id % 3 = 0"), rows, "id").select("page_id", "id")


@query("S-04", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_us(date_trunc('day', o_orderdate)) WHEN 1 THEN epoch_us(date_trunc('day', o_orderdate)) + 45296000000 WHEN 2 THEN 1700000000000000 + o_orderkey ELSE -1 END AS low,
  CASE o_orderkey % 4 WHEN 0 THEN epoch_us(date_trunc('day', o_orderdate)) + 86399999999 WHEN 1 THEN epoch_us(date_trunc('day', o_orderdate)) + 45296000000 WHEN 2 THEN 1700000000000000 + o_orderkey ELSE -1 END AS high FROM orders""")
def bounds(spark, sf_dir):
    """Days, moments and digits as text to the microseconds that they bound."""
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    digits = (F.lit(1_700_000_000_000_000) + F.col("o_orderkey")).cast("string")
    text = F.when(kind == 0, day).when(kind == 1, F.concat(day, F.lit("T12:34:56"))).when(kind == 2, digits).otherwise("soon")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    found = {name: F.coalesce(clock.micros_of(F.col("text"), end), F.lit(-1)) for name, end in (("low", False), ("high", True))}
    return rows.select("o_orderkey", *[x.alias(name) for name, x in found.items()])


@query("S-07", sql("SELECT symbol, open_time, round(CASE WHEN volume > 0 THEN taker_buy_base / volume END, 6) AS taker_ratio, volume > 0 AS available__taker_ratio FROM h WHERE symbol IN ('click', 'view') AND open_time BETWEEN 1704844800000000 AND 1705276799999999"))
def feature_range(spark, sf_dir):
    make = lambda: features.with_masks(features.build(bars(spark, sf_dir, HOUR), HOUR, ["taker_ratio"]))
    path = stores.session_store(spark, "features", table(spark, sf_dir, "events"), make)
    low, high = clock.to_micros("2024-01-10"), clock.to_micros("2024-01-14", end=True)
    return stores.load_range(spark, path, ["taker_ratio"], ["click", "view"], low, high).withColumn("taker_ratio", r("taker_ratio"))


@query(
    "S-09",
    sql(
        f"""SELECT symbol, CASE WHEN {_HX} % 11 = 0 THEN 'missing value' WHEN {_HX} % 13 = 0 THEN 'negative volume' ELSE 'kept' END AS reason, count(*) AS n FROM h GROUP BY ALL"""
    ),
)
def chart_documents(spark, sf_dir):
    rows = bars(spark, sf_dir, HOUR).withColumn("day", F.expr(f"open_time div {DAY}"))
    close, volume = F.when(_hour() % 11 != 0, F.col("close")), F.when(_hour() % 13 == 0, F.lit(-1.0)).otherwise(F.col("volume"))
    one = F.struct(F.col("open_time").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), close.alias("c"), volume.alias("v"))
    docs = rows.groupBy("symbol", "day").agg(F.collect_list(one).alias("b"))
    # nulls stay in the arrays of the document
    body = F.to_json(F.struct(*[F.col(f"b.{k}").alias(k) for k in "tohlcv"]), {"ignoreNullFields": "false"})
    parsed = readers.parse_chart(docs.select("symbol", body.alias("body")), "body")
    return parsed.groupBy("symbol", F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "S-11",
    """SELECT day, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) - count(DISTINCT o_custkey) AS repeated
      FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority <> '1-URGENT') GROUP BY day""",
)
def end_of_day(spark, sf_dir):
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("C"), "o_custkey").alias("symbol"),
        F.concat(F.lit("IN"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("7")).alias("isin"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "BE").otherwise("EQ").alias("series"),
        (price * 1.01).alias("high"), (price * 0.99).alias("low"), price.alias("close"), F.col("o_orderkey").cast("double").alias("volume"),
    )
    kept = readers.parse_eod(readers.pack_eod(rows))
    repeated = F.count("isin") - F.count_distinct("isin")
    return kept.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"), repeated.alias("repeated"))


_SUBJECTS = {"1-URGENT": "Interim Dividend - Rs 5", "2-HIGH": "Bonus 1:1", "3-MEDIUM": "DIVIDEND - special"}


@query(
    "S-12",
    """SELECT 'C' || o_custkey AS symbol, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'dividend' ELSE 'other' END AS kind, count(*) AS n
      FROM orders WHERE o_orderdate BETWEEN '1995-01-01' AND '1996-12-31 23:59:59' GROUP BY ALL""",
)
def corporate_events(spark, sf_dir):
    subject = F.lit("Annual General Meeting")
    for priority, text in _SUBJECTS.items():
        subject = F.when(F.col("o_orderpriority") == priority, text).otherwise(subject)
    one = F.struct(F.concat(F.lit("C"), "o_custkey").alias("symbol"), subject.alias("subject"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("exDate"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(one)).alias("body"))
    return readers.parse_events(docs, "body", "1995-01-01", "1996-12-31").groupBy("symbol", "kind").agg(F.count("*").alias("n"))


@query(
    "S-14",
    """SELECT count(*) AS n, count(*) FILTER (c_custkey % 50 = 0) AS bad_symbol, count(*) FILTER (c_custkey % 60 = 0) AS bad_isin, 0::BIGINT AS repeated_symbol,
      count(*) FILTER (c_custkey % 70 = 1) - 1 AS repeated_isin, false AS passed FROM customer""",
)
def roster(spark, sf_dir):
    """A constituent list as a CSV file with wrong symbols, wrong ISINs and one ISIN used again."""
    key = F.col("c_custkey")
    symbol = F.concat(F.when(key % 50 == 0, "cust").otherwise("CUST"), key)
    number = F.lpad(F.when(key % 70 == 1, F.lit(1)).otherwise(key).cast("string"), 9, "0")
    isin = F.concat(F.when(key % 60 == 0, "XX").otherwise("IN"), number, F.lit("7"))
    path = f"{stores.shared_root(spark, 'rosters')}/csv"
    table(spark, sf_dir, "customer").select(symbol.alias("symbol"), isin.alias("isin")).write.option("header", True).csv(path)
    return readers.check_roster(spark.read.schema("symbol string, isin string").option("header", True).csv(path), 150)


@query(
    "S-16",
    """SELECT file, CASE WHEN rn <= floor(total * 0.8) THEN 'first' ELSE 'last' END AS part, count(*) AS n
      FROM (SELECT strftime(o_orderdate, '%Y-%m') AS file, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m'), o_orderdate, o_orderkey) AS rn, count(*) OVER () AS total FROM orders)
      GROUP BY ALL""",
)
def chronological_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("file", F.date_format("o_orderdate", "yyyy-MM"))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("o_orderdate", "o_orderkey")) - 1)
    return readers.first_share(rows, "file", "position", 0.8).groupBy("file", "part").agg(F.count("*").alias("n"))


@query("S-17", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def journal(spark, sf_dir):
    path = f"{stores.shared_root(spark, 'journals')}/json"
    line = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("event"), line.alias("body")).write.json(path)
    lines = spark.read.schema("event string, body struct<key: long, value: double>").json(path)
    return lines.where("event = 'F' and body.value > 100000").select("body.key", "body.value")


@query("S-19", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def read_back(spark, sf_dir):
    rows, root = table(spark, sf_dir, "orders"), stores.shared_root(spark, "versions")
    for version, status in ((1, "O"), (2, "F")):
        stores.write_version(rows.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice"), root, version)
    return stores.read_version(spark, root, 2)


@query("P-10", "SELECT o_orderkey, o_orderdate < DATE '1992-01-01' + (c_custkey % 2000)::INT AS before FROM orders JOIN customer ON o_custkey = c_custkey")
def before_inclusion(spark, sf_dir):
    """Rows of a security from before the day on which it was included."""
    included = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")).alias("included"))
    return table(spark, sf_dir, "orders").join(included, "o_custkey").select("o_orderkey", (F.col("o_orderdate") < F.col("included")).alias("before"))


@query(
    "P-15",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 6 = 2 THEN 'synthetic' WHEN o_orderkey % 6 = 0 THEN 'nse_cash' WHEN o_orderkey % 6 = 1 THEN 'binance_spot'
      WHEN o_orderkey % 6 = 3 THEN 'bybit_spot' WHEN o_orderkey % 7 = 0 THEN 'custom' ELSE 'Unspecified' END AS market FROM orders""",
)
def market_labels(spark, sf_dir):
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("NSE equities", "Binance spot", "Synthetic walk", "ByBit spot", "other")])
    source = F.get(names, (key % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.market(source, key % 9 == 0, F.when(key % 7 == 0, "custom")).alias("market"))


@query(
    "J-10",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_custkey % 40 = 0 THEN 'ambiguous' WHEN o_custkey % 40 = 1 THEN 'symbol' ELSE 'isin' END
      WHEN o_custkey % 40 = 0 THEN 'ambiguous' ELSE 'symbol' END AS matched, CASE WHEN o_custkey % 40 <> 0 THEN c_acctbal END AS reference
      FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def official_reference(spark, sf_dir):
    """By ISIN where the row has one that the reference knows, else by symbol; only a single match counts."""
    key = F.col("c_custkey")
    official = table(spark, sf_dir, "customer").select(
        F.when(key % 40 != 1, F.concat(F.lit("IN"), key)).alias("isin"), F.concat(F.lit("C"), key).alias("symbol"), F.col("c_acctbal").alias("reference"), F.explode(F.when(key % 40 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    )
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("IN"), "o_custkey")).alias("isin"), F.concat(F.lit("C"), "o_custkey").alias("symbol")
    )
    return joins.reference(rows, official.drop("copy"), ["isin", "symbol"], "reference").select("o_orderkey", "matched", "reference")


@query("T-08", sql("SELECT open_time, symbol, round(close, 6) AS close FROM h ORDER BY open_time, symbol"))
def total_order(spark, sf_dir):
    """A range exchange on the order's keys; only for a sink that needs it."""
    return bars(spark, sf_dir, HOUR).select("open_time", "symbol", r("close", "close")).orderBy("open_time", "symbol")


@query(
    "X-02",
    sql(
        "SELECT symbol, name, warmup, greatest(n - warmup, 0) AS usable FROM (SELECT symbol, count(*) AS n FROM h GROUP BY symbol) CROSS JOIN (VALUES "
        + ", ".join(f"('{x.name}', {x.warmup}::BIGINT)" for x in features.listed())
        + ") v(name, warmup)"
    ),
)
def feature_list(spark, sf_dir):
    """Every registered feature with its warm-up and how many rows of each symbol lie behind it."""
    each = F.array(*[F.struct(F.lit(x.name).alias("name"), F.lit(x.warmup).cast("long").alias("warmup")) for x in features.listed()])
    sizes = bars(spark, sf_dir, HOUR).groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", "n", F.explode(each).alias("f"))
    return sizes.select("symbol", "f.name", "f.warmup", F.greatest(F.col("n") - F.col("f.warmup"), F.lit(0)).alias("usable"))


@query(
    "X-04",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 3 THEN CASE WHEN NOT l_discount <= l_tax THEN 'bounds out of order' END WHEN 7 THEN 'unknown helper'
      ELSE CASE WHEN l_partkey % 10 = 0 THEN 'no whole number' WHEN l_quantity - 3 < CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 1 END THEN 'window too small' END END AS fault FROM lineitem""",
)
def argument_rules(spark, sf_dir):
    """Calls of the helpers as data, judged by the helpers' own rules."""
    names = F.array(*[F.lit(x) for x in ("lag", "mean", "clip", "std", "zscore", "rank", "median")])
    rows = table(spark, sf_dir, "lineitem").withColumn("name", F.coalesce(F.get(names, F.col("l_linenumber") - 1), F.lit("none")))
    n = F.col("l_quantity") - 3 + F.when(F.col("l_partkey") % 10 == 0, 0.5).otherwise(0.0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", ts.argument_fault(F.col("name"), n, F.col("l_discount"), F.col("l_tax")).alias("fault"))
