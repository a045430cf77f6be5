"""Source, sink, quality, join, set, top-k, registry and report queries (S-*, K-*, Q-*, P-*, J-*, U-*, T-*, G-*, A-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import clock, ts
from barloom.operators import features, joins, ledger, quality, registry
from barloom.plans.base import DAY, HOUR, bars, query, r, sql, table, ticks
from barloom.sources import readers, stores

_W = "(PARTITION BY symbol ORDER BY open_time)"
_STAMP = "(epoch_us({}))"


def _store(spark, sf_dir):
    """The hourly bars of the tables as a partitioned store in the shared folder, written once a session and path."""
    return stores.session_store(spark, "bars", table(spark, sf_dir, "events"), lambda: bars(spark, sf_dir, HOUR))


@query("S-03", sql("SELECT symbol, open_time, close FROM h WHERE symbol IN ('click', 'view') AND open_time BETWEEN 1704844800000000 AND 1705276799999999 ORDER BY open_time, symbol"))
def pruned_scan(spark, sf_dir):
    rows = stores.load_bars(spark, _store(spark, sf_dir), ["click", "view"], clock.to_micros("2024-01-10"), clock.to_micros("2024-01-14", end=True))
    return rows.select("symbol", "open_time", "close").orderBy("open_time", "symbol")


@query("K-01", sql("SELECT symbol, count(*) AS n, round(sum(close), 4) AS total FROM h GROUP BY symbol"))
def stored_bars(spark, sf_dir):
    return spark.read.parquet(_store(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query("S-05", sql("SELECT DISTINCT symbol FROM h"))
def stored_symbols(spark, sf_dir):
    return stores.symbols(spark, _store(spark, sf_dir))


@query("S-06", sql("SELECT symbol, min(open_time) AS first FROM h GROUP BY symbol"))
def first_times(spark, sf_dir):
    return stores.statistics(spark, _store(spark, sf_dir), "symbol").select("symbol", "first")


@query("S-10", sql("SELECT symbol, open_time, round(close, 6) AS close, CASE WHEN volume < 3 THEN 'thin' ELSE 'kept' END AS status FROM h"))
def candle_arrays(spark, sf_dir):
    candle = F.array(*[F.col(c).cast("string") for c in ("open_time", "open", "high", "low", "close", "volume")])
    docs = bars(spark, sf_dir, HOUR).groupBy("symbol", F.expr(f"open_time div {DAY}").alias("day")).agg(F.to_json(F.collect_list(candle)).alias("body"))
    return readers.parse_candles(docs, "body").select("symbol", "open_time", r("close", "close"), F.when(F.col("volume") < 3, "thin").otherwise("kept").alias("status"))


@query("S-08", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-17'")
def pushed_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.expr("timestamp_ntz'1995-06-17 00:00:00'")).select("o_orderkey")


@query("Q-01", sql("SELECT symbol, open_time, concat_ws(', ', CASE WHEN NOT (open > 0 AND high > 0 AND low > 0 AND close > 0) THEN 'price not above zero' END, CASE WHEN open NOT BETWEEN low AND high THEN 'open outside range' END, CASE WHEN close NOT BETWEEN low AND high THEN 'close outside range' END) AS problem FROM b WHERE NOT (open > 0 AND high > 0 AND low > 0 AND close > 0) OR open NOT BETWEEN low AND high OR close NOT BETWEEN low AND high", b=f"SELECT * REPLACE (CASE WHEN open_time // {HOUR} % 50 = 0 THEN high + 1 ELSE close END AS close) FROM h"))
def bad_bars(spark, sf_dir):
    rows = bars(spark, sf_dir, HOUR).withColumn("close", F.when(F.expr(f"open_time div {HOUR}") % 50 == 0, F.col("high") + 1).otherwise(F.col("close")))
    return quality.validate(rows).select("symbol", "open_time", "problem")


_TEN = "SELECT symbol, t AS open_time FROM ticks"


@query("Q-02", sql("SELECT symbol, open_time FROM t WHERE open_time % 1000 <> 0", t=_TEN))
def off_grid(spark, sf_dir):
    return quality.off_grid(ticks(spark, sf_dir).select("symbol", F.col("t").alias("open_time")), 1000)


@query("Q-05", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return quality.not_unique(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("A-03", sql("SELECT count(*) AS n, min(open_time) AS first, max(open_time) AS last FROM h"))
def snapshot_stats(spark, sf_dir):
    return stores.statistics(spark, _store(spark, sf_dir))


@query("A-04", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("A-41", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def cardinality(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("A-42", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def manifest_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("F-19", "SELECT page_id, sha256(html) AS sha FROM pages")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("Q-08", "SELECT 'file' || page_id AS path, CASE WHEN page_id % 50 = 3 THEN 'removed' ELSE 'changed' END AS status FROM pages WHERE page_id % 50 IN (3, 7)")
def snapshot_check(spark, sf_dir):
    old = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("file"), "page_id").alias("path"), F.sha2("html", 256).alias("sha"))
    new = old.where("page_id % 50 <> 3").withColumn("sha", F.when(F.col("page_id") % 50 == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha")))
    return quality.snapshot_changes(old.drop("page_id"), new.drop("page_id"))


@query("Q-12", sql("SELECT name, count(*) AS n, 0::BIGINT AS different FROM h CROSS JOIN (VALUES " + ", ".join(f"('{n}')" for n in features.names()) + ") v(name) WHERE open_time < 1705276800000000 GROUP BY name"))
def causality(spark, sf_dir):
    """Every registered feature on a prefix of the history against the same feature on all of it: where the two differ."""
    return features.causality(bars(spark, sf_dir, HOUR), HOUR, 1705276800000000)


@query("P-02", "SELECT o_orderkey, TRY_CAST(nullif(substr(o_orderpriority, 1, 1), '5') AS DOUBLE) AS number, TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders")
def coerced(spark, sf_dir):
    first = F.nullif(F.substring("o_orderpriority", 1, 1), F.lit("5"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ts.number(first).alias("number"), ts.number(F.col("o_orderstatus")).alias("status"))


@query("P-04", sql(f"SELECT symbol, count(*) FILTER (open_time % {HOUR} = 0 AND close_time + 1 = open_time + {HOUR}) AS complete, count(*) AS n FROM h GROUP BY symbol"))
def complete_bars(spark, sf_dir):
    ok = (F.col("open_time") % HOUR == 0) & (F.col("close_time") + 1 == F.col("open_time") + HOUR)
    return bars(spark, sf_dir, HOUR).groupBy("symbol").agg(F.count_if(ok).alias("complete"), F.count("*").alias("n"))


_LOCAL = f"(open_time + 19800000000) // {DAY}"
#: Special sessions: local days since 1970 with their first and last minute; one is a Saturday, one shortens a weekday.
SPECIAL = [(19736, 825, 885), (19739, 600, 720)]


@query(
    "P-05",
    sql(
        f"""SELECT symbol, open_time, s.day IS NOT NULL AS special FROM h LEFT JOIN (VALUES {", ".join(map(str, SPECIAL))}) s(day, lo, hi) ON s.day = {_LOCAL}
        WHERE CASE WHEN s.day IS NULL THEN isodow(make_timestamp(open_time + 19800000000)) < 6 AND ((open_time + 19800000000) % {DAY}) // 60000000 BETWEEN 555 AND 929
          ELSE ((open_time + 19800000000) % {DAY}) // 60000000 >= lo AND ((open_time + 19800000000) % {DAY}) // 60000000 < hi END AND open_time % 60000000 = 0"""
    ),
)
def session_bars(spark, sf_dir):
    """Bars of the usual sessions and, in place of a day's usual one, of its special session."""
    special = spark.createDataFrame(SPECIAL, "day long, lo int, hi int")
    return clock.session_bars(bars(spark, sf_dir, HOUR), special).select("symbol", "open_time", "special")


@query("P-06", sql("SELECT symbol, open_time FROM h WHERE low <= least(open, close) + 1e-9 AND high + 1e-9 >= greatest(open, close)"))
def consistent(spark, sf_dir):
    return bars(spark, sf_dir, HOUR).where((F.col("low") <= F.least("open", "close") + 1e-9) & (F.col("high") + 1e-9 >= F.greatest("open", "close"))).select("symbol", "open_time")


_SPLIT = [("train", 1704067200000000, 1705276800000000), ("valid", 1705276800000000, 1706140800000000), ("test", 1706140800000000, 1706659200000000)]


@query("P-13", sql("SELECT symbol, split, count(*) FILTER (done < hi) AS kept, count(*) FILTER (done >= hi) AS purged FROM (SELECT symbol, open_time, open_time + 4 * 3600000000 AS done FROM h) JOIN (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _SPLIT) + ") s(split, lo, hi) ON open_time >= lo AND open_time < hi GROUP BY ALL"))
def purged_splits(spark, sf_dir):
    rows = bars(spark, sf_dir, HOUR).withColumn("done", F.col("open_time") + 4 * HOUR)
    return clock.assign(rows, _SPLIT, "done").where("split <> 'outside'").groupBy("symbol", "split").agg(F.count_if(F.col("fate") == "kept").alias("kept"), F.count_if(F.col("fate") == "purged").alias("purged"))


#: Splits with a day between each two, kept free for labels that reach over an edge.
APART = [("train", 1704067200000000, 1705190400000000), ("valid", 1705276800000000, 1706054400000000), ("test", 1706140800000000, 1706659200000000)]
HORIZONS = (1, 4, 24, 48)


@query(
    "P-12",
    sql(
        f"""SELECT symbol, split, horizon, horizon * {HOUR} > {DAY} AS refused, count(*) AS n, count(*) FILTER (horizon * {HOUR} <= {DAY} AND open_time + horizon * {HOUR} < hi) AS usable
        FROM h JOIN (VALUES {", ".join(map(str, APART))}) s(split, lo, hi) ON open_time >= lo AND open_time < hi CROSS JOIN (VALUES {", ".join(f"({x}::BIGINT)" for x in HORIZONS)}) v(horizon) GROUP BY ALL"""
    ),
)
def split_windows(spark, sf_dir):
    """Bars of half-open windows for labels of several horizons; one that is longer than the embargo is refused."""
    rows = bars(spark, sf_dir, HOUR).select("symbol", "open_time", F.explode(F.array(*[F.lit(h).cast("long") for h in HORIZONS])).alias("horizon"))
    rows = clock.windows(rows, APART, F.col("horizon") * HOUR, DAY).where("split <> 'outside'")
    return rows.groupBy("symbol", "split", "horizon").agg(F.bool_or("refused").alias("refused"), F.count("*").alias("n"), F.count_if("usable").alias("usable"))


@query("J-03", sql(f"SELECT a.symbol, a.open_time, b.close AS day_close FROM h a LEFT JOIN d b USING (symbol, open_time)"))
def exact_alignment(spark, sf_dir):
    d = bars(spark, sf_dir, DAY).select("symbol", "open_time", F.col("close").alias("day_close"))
    return joins.align(bars(spark, sf_dir, HOUR).select("symbol", "open_time"), d)


@query("J-04", sql("SELECT symbol, open_time FROM h WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.symbol = h.symbol AND d.open_time = h.open_time)"))
def absent_times(spark, sf_dir):
    k = ["symbol", "open_time"]
    return bars(spark, sf_dir, HOUR).select(*k).join(bars(spark, sf_dir, DAY).select(*k), k, "left_anti")


@query("J-05", sql("SELECT symbol, open_time FROM h WHERE EXISTS (SELECT 1 FROM d WHERE d.symbol = h.symbol AND d.open_time = h.open_time)"))
def restricted(spark, sf_dir):
    k = ["symbol", "open_time"]
    return bars(spark, sf_dir, HOUR).select(*k).join(bars(spark, sf_dir, DAY).select(*k), k, "left_semi")


MEMBERS = [("click", 1704067200000000, 1704931200000000, 1704067200000000, "a"), ("click", 1704931200000000, 1706659200000000, 1705017600000000, "b"), ("view", 1704499200000000, 1705276800000000, 1704844800000000, "a")]
_MEMBERS = f"(VALUES {', '.join(map(str, MEMBERS))}) m(symbol, lo, hi, listed, grp)"


@query("J-07", sql(f"SELECT symbol, open_time, grp, open_time >= listed AS tradable FROM d JOIN {_MEMBERS} USING (symbol) WHERE open_time >= lo AND open_time < hi"))
def memberships(spark, sf_dir):
    """Membership by day, and whether the member was listed by then."""
    m = spark.createDataFrame(MEMBERS, "symbol string, lo long, hi long, listed long, grp string")
    return joins.interval(bars(spark, sf_dir, DAY), m).select("symbol", "open_time", "grp", (F.col("open_time") >= F.col("listed")).alias("tradable"))


@query("J-08", sql(f"SELECT symbol, open_time, CASE WHEN open_time - lag(open_time) OVER {_W} = {HOUR} THEN lag(close > open) OVER {_W} END AS rising_before FROM h"))
def lagged_regime(spark, sf_dir):
    rows = bars(spark, sf_dir, HOUR).withColumn("rising", F.col("close") > F.col("open"))
    return rows.select("symbol", "open_time", ts.lag(F.col("rising"), 1, HOUR).alias("rising_before"))


@query("J-09", sql("SELECT h.symbol, h.open_time, x.close AS known FROM h ASOF LEFT JOIN (SELECT symbol, close, open_time + 86400000000 AS available FROM d) x ON h.symbol = x.symbol AND h.open_time >= x.available"))
def as_of(spark, sf_dir):
    daily = bars(spark, sf_dir, DAY).select("symbol", (F.col("open_time") + DAY).alias("open_time"), F.col("close").alias("known"))
    return joins.as_of(bars(spark, sf_dir, HOUR).select("symbol", "open_time"), daily, "known")


@query("J-12", "SELECT o_orderkey, o_orderstatus, l_linenumber, p_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT'")
def order_fills(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderstatus")
    line, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("o_orderkey", "o_orderstatus", "l_linenumber", "p_name")


@query("J-13", "SELECT page_id AS key, CASE WHEN page_id % 40 = 1 THEN 'only left' ELSE 'differs' END AS status FROM pages WHERE page_id % 40 IN (1, 2)")
def reconciled(spark, sf_dir):
    left = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.length("url").alias("value"))
    right = left.where("key % 40 <> 1").withColumn("value", F.when(F.col("key") % 40 == 2, F.col("value") + 1).otherwise(F.col("value")))
    return joins.reconcile(left, right, "key", "value")


_AUDIT = dict(
    cal=f"SELECT unnest(range(1704067200000000, 1706659200000000, {DAY})) AS day",
    ex=f"SELECT symbol, day FROM (SELECT DISTINCT symbol FROM h) CROSS JOIN cal WHERE day // {DAY} % 7 <> 2",
    obs=f"SELECT symbol, open_time // {DAY} * {DAY} AS day, count(*) AS n FROM h WHERE open_time // {DAY} % 11 <> 3 GROUP BY ALL",
)


@query("J-17", sql("SELECT coalesce(ex.symbol, obs.symbol) AS symbol, coalesce(ex.day, obs.day) AS day, CASE WHEN obs.day IS NULL THEN 'missing' WHEN ex.day IS NULL THEN 'unexpected' ELSE 'incomplete' END AS status, coalesce(n, 0) AS n FROM ex FULL JOIN obs ON ex.symbol = obs.symbol AND ex.day = obs.day WHERE obs.day IS NULL OR ex.day IS NULL OR n <> 24", **_AUDIT))
def calendar_audit(spark, sf_dir):
    """Days that are missing, that the calendar doesn't have, or whose bars are not complete."""
    day = F.expr(f"open_time div {DAY}")
    rows = bars(spark, sf_dir, HOUR).where(day % 11 != 3).select("symbol", (day * DAY).alias("day"))
    calendar = spark.range(1704067200000000, 1706659200000000, DAY).select(F.col("id").alias("day")).where(F.expr(f"day div {DAY}") % 7 != 2).withColumn("slots", F.lit(24))
    every = bars(spark, sf_dir, HOUR).select("symbol").distinct()
    return joins.calendar_audit(rows, every, calendar)


@query("U-02", sql("SELECT symbol, open_time FROM h INTERSECT SELECT symbol, open_time FROM d"))
def key_intersection(spark, sf_dir):
    k = ["symbol", "open_time"]
    return bars(spark, sf_dir, HOUR).select(*k).intersect(bars(spark, sf_dir, DAY).select(*k))


@query("U-03", sql("SELECT symbol, open_time FROM h EXCEPT SELECT symbol, open_time FROM d"))
def key_difference(spark, sf_dir):
    k = ["symbol", "open_time"]
    return bars(spark, sf_dir, HOUR).select(*k).subtract(bars(spark, sf_dir, DAY).select(*k))


@query("U-01", "SELECT source, count(*) AS n FROM (SELECT 'orders' AS source FROM orders UNION ALL SELECT 'lineitem' FROM lineitem) GROUP BY source")
def union_all(spark, sf_dir):
    each = [table(spark, sf_dir, t).select(F.lit(t).alias("source")) for t in ("orders", "lineitem")]
    return each[0].unionByName(each[1]).groupBy("source").agg(F.count("*").alias("n"))


@query("U-05", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct()


@query("T-01", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_version(spark, sf_dir):
    return registry.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("T-02", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


@query("T-05", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey")


@query("T-07", sql("SELECT symbol, open_time, round(abs(close - open), 6) AS size FROM h ORDER BY abs(close - open) DESC, symbol, open_time LIMIT 1"))
def largest_move(spark, sf_dir):
    size = F.abs(F.col("close") - F.col("open"))
    return bars(spark, sf_dir, HOUR).orderBy(size.desc(), "symbol", "open_time").limit(1).select("symbol", "open_time", r(size, "size"))


@query("G-02", "SELECT o_custkey, count(*) AS used, greatest(2 - count(*), 0) AS remaining, count(*) >= 2 AS refused FROM orders GROUP BY ALL")
def access_budget(spark, sf_dir):
    return registry.budget(table(spark, sf_dir, "orders"), ["o_custkey"], 2)


@query("G-03", "SELECT o_custkey, o_orderkey, before, o_orderstatus AS state FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL AND (before, o_orderstatus) NOT IN (('O', 'P'), ('P', 'F'), ('O', 'F'), ('O', 'O'), ('P', 'P'), ('F', 'F'))")
def illegal_transitions(spark, sf_dir):
    allowed = [("O", "P"), ("P", "F"), ("O", "F"), ("O", "O"), ("P", "P"), ("F", "F")]
    return registry.illegal(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", allowed).select("o_custkey", "o_orderkey", "before", F.col("o_orderstatus").alias("state"))


@query("G-05", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'untested' WHEN best >= 400000 THEN 'selected' ELSE 'rejected' END AS outcome FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY ALL) ON c_custkey = o_custkey")
def outcomes(spark, sf_dir):
    tests = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    both = table(spark, sf_dir, "customer").select("c_custkey").join(tests, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.when(F.col("n").isNull(), "untested").when(F.col("best") >= 400000, "selected").otherwise("rejected").alias("outcome"))


@query("A-30", "SELECT o_orderpriority AS grp, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def pooled(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup(F.col("o_orderpriority").alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    "A-26",
    "SELECT coalesce(bin, -1) AS bin, count(*) AS n, round(avg(p), 6) AS mean, round(avg(y), 6) AS rate, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN greatest(p, 2.220446049250313e-16) ELSE greatest(1 - p, 2.220446049250313e-16) END)), 6) + 0.0 AS log_loss FROM (SELECT least(floor(l_discount * 10 * 10 / 1.0), 9)::BIGINT AS bin, l_discount * 10 AS p, (l_returnflag = 'R')::INT AS y FROM (SELECT l_returnflag, least(l_discount, 0.1) AS l_discount FROM lineitem)) GROUP BY GROUPING SETS ((bin), ())",
)
def reliability(spark, sf_dir):
    """Ten equal bins of a probability, and all of them (bin -1): mean, rate, Brier score and log loss."""
    p = F.least("l_discount", F.lit(0.1)) * 10
    rows = table(spark, sf_dir, "lineitem").select(p.alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.least(F.floor(F.least("l_discount", F.lit(0.1)) * 10 * 10 / 1.0), F.lit(9)).cast("long").alias("bin"))
    return registry.reliability(rows).select(F.coalesce("bin", F.lit(-1)).alias("bin"), "n", r("mean", "mean"), r("rate", "rate"), r("brier", "brier"), r("log_loss", "log_loss"))


@query(
    "A-34",
    sql(
        f"""SELECT open_time, string_agg(symbol, ',' ORDER BY symbol) AS members, string_agg(symbol, ',' ORDER BY symbol) FILTER (open_time >= listed) AS tradable, string_agg(symbol, ',' ORDER BY symbol) FILTER (open_time < listed) AS unlisted
        FROM (SELECT DISTINCT open_time FROM d) JOIN {_MEMBERS} ON open_time >= lo AND open_time < hi GROUP BY open_time"""
    ),
)
def universe_days(spark, sf_dir):
    """Each day's members, those that can be traded, and those that are not yet listed."""
    days = bars(spark, sf_dir, DAY).select("open_time").distinct()
    m = spark.createDataFrame(MEMBERS, "symbol string, lo long, hi long, listed long, grp string")
    found = joins.universe(days, m)
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return found.select("open_time", *[text(c).alias(c) for c in ("members", "tradable", "unlisted")])


_FILLS = "SELECT user_id, t, event_id, CASE symbol WHEN 'purchase' THEN 1 ELSE -1 END * (k + 1)::DOUBLE AS signed, price FROM ticks WHERE symbol IN ('purchase', 'click')"


def _fills(spark, sf_dir):
    side = F.when(F.col("symbol") == "purchase", 1).otherwise(-1)
    return ticks(spark, sf_dir).where("symbol in ('purchase', 'click')").select("user_id", "t", "event_id", (side * (F.col("k") + 1)).cast("double").alias("signed"), "price")


@query("W-36", sql("SELECT user_id, event_id, round(sum(signed) OVER w, 6) + 0.0 AS quantity, round(-sum(signed * price) OVER w, 4) + 0.0 AS cash, round(sum(abs(signed * price)) OVER w * 0.001, 6) + 0.0 AS fees FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)", f=_FILLS))
def replay(spark, sf_dir):
    rows = ledger.running(_fills(spark, sf_dir), ["user_id"], ["t", "event_id"], 10.0)
    return rows.select("user_id", "event_id", r("quantity", "quantity"), (F.round("cash", 4) + 0.0).alias("cash"), r("fees", "fees"))


@query(
    "O-01",
    sql(
        """SELECT account, round(q, 6) + 0.0 AS quantity, round(a, 6) + 0.0 AS average, round(g, 3) + 0.0 AS realised, round(fees, 5) + 0.0 AS fees FROM
        (SELECT *, row_number() OVER (PARTITION BY account ORDER BY rn DESC) AS back FROM z) JOIN (SELECT user_id AS account, sum(abs(signed * price)) * 0.001 AS fees FROM f GROUP BY ALL) USING (account) WHERE back = 1""",
        f=_FILLS,
        n="SELECT user_id AS account, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn, signed AS s, price AS p FROM f",
    ).replace("WITH ticks", "WITH RECURSIVE ticks", 1).replace(
        "SELECT account, round(q, 6)",
        """, z AS (SELECT account, rn, s AS q, p AS a, 0.0::DOUBLE AS g FROM n WHERE rn = 1
          UNION ALL SELECT n.account, n.rn, q + s,
            CASE WHEN q = 0 OR sign(q) = sign(s) THEN (a * abs(q) + p * abs(s)) / (abs(q) + abs(s)) WHEN q + s = 0 THEN 0 WHEN sign(q + s) = sign(q) THEN a ELSE p END,
            g + CASE WHEN q = 0 OR sign(q) = sign(s) THEN 0 ELSE least(abs(s), abs(q)) * (p - a) * sign(q) END
          FROM z JOIN n ON n.account = z.account AND n.rn = z.rn + 1)
        SELECT account, round(q, 6)""",
        1,
    ),
)
def average_cost(spark, sf_dir):
    """Final quantity, average cost, realised P&L and fees of each account, composed over pieces of its fills."""
    out = ledger.book(_fills(spark, sf_dir), "user_id", 10.0)
    places = (("quantity", 6), ("average", 6), ("realised", 3), ("fees", 5))
    return out.select("account", *[(F.round(c, n) + 0.0).alias(c) for c, n in places])


@query("A-24", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(c, 20) - least(c - f, 20), 6) + 0.0 AS brokerage FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * 0.0003 AS f, sum(l_extendedprice * 0.0003) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_shipdate, l_tax ROWS UNBOUNDED PRECEDING) AS c FROM lineitem)")
def capped_brokerage(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate", "l_tax"]
    return ledger.capped(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, F.col("l_extendedprice") * 0.0003, 20.0).select("l_orderkey", "l_linenumber", "l_partkey", r("brokerage", "brokerage"))
