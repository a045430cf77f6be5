"""The followed stream: marks and timers in the state store, one pass for both sinks, restarts and progress."""

import json

from pyspark.sql import functions as F

from barloom.streaming import closed_bars as cb

STEP = 60_000_000


def message(symbol, minute, close, closed=True, **other):
    k = {"s": symbol, "i": "1m", "t": minute * 60_000, "T": minute * 60_000 + 59_999, "o": "1", "h": "9", "l": "0.5", "c": str(close), "v": "5", "q": "5", "n": 1, "V": "1", "Q": "1", "x": closed} | other
    return json.dumps({"data": {"e": "kline", "s": symbol, "E": minute * 60_000 + 60_000, "k": k}})


def send(spark, root, rows, **how):
    """Messages (body, seq, minute of arrival) as one more file, followed to the end."""
    spark.createDataFrame([(b, s, m * STEP) for b, s, m in rows], "body string, seq long, arrived long").write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema("body string, seq long, arrived long").parquet(f"{root}/in")
    return cb.follow(source, root, STEP, how.pop("limit", 180_000), **how).collect()


def told(spark, root):
    rows = cb.sunk(spark, root, "events").collect()
    return sorted((r["symbol"] or "", r["seq"] or 0, r["event"], r["missing"], None if r["open_time"] is None else r["open_time"] // STEP) for r in rows)


def test_marks_restart_and_silence(spark, tmp_path):
    root = str(tmp_path)
    first = [
        (message("a", 10, 1.0), 1, 11), (message("a", 11, 2.0), 2, 12), (message("a", 11, 2.0), 3, 12), (message("a", 11, 3.0), 4, 12), (message("a", 10, 1.0), 5, 12),
        (message("a", 14, 4.0), 6, 15), (message("b", 11, 9.0), 7, 12), (message("a", 15, 5.0, closed=False), 8, 15), ("{broken", 9, 15), (message("a", 16, 1.0, T=16 * 60_000 + 5), 10, 15),
        (message("a", 17, 1.0, s="z"), 11, 15), (message("a", 17, "x"), 12, 15), (message("a", -1, 1.0), 13, 15),
    ]
    progress = send(spark, root, first)
    want = [("", 9, "malformed", 0, None), ("a", 3, "DUPLICATE", 0, 11), ("a", 4, "CONFLICT", 0, 11), ("a", 5, "OUT_OF_ORDER", 0, 10), ("a", 6, "GAP", 2, 14), ("a", 8, "open", 0, 15), ("a", 10, "refused", 0, 16)]
    bad = [("a", 12, "malformed", 0, 17), ("a", 13, "malformed", 0, -1), ("z", 11, "malformed", 0, 17)]
    assert told(spark, root) == sorted(want + bad)
    assert sorted((r["symbol"], r["seq"]) for r in cb.sunk(spark, root, "bars").collect()) == [("a", 1), ("a", 2), ("a", 6), ("b", 7)]
    assert [sum(r[c] for r in progress) for c in cb.COUNTED] == [4, 1, 1, 2, 8, 0] and sum(r["messages"] for r in progress) == 13

    # a new run goes on from the marks; nothing is judged twice; the clock of arrival passes b's silence, which sends nothing
    later = [(message("a", 14, 4.0), 14, 16), (message("a", 14, 5.0), 15, 16), (message("a", 13, 1.0), 16, 16), (message("a", 15, 1.0), 17, 16), (message("c", 5, 1.0), 18, 16)]
    progress = send(spark, root, later)
    new = [("a", 14, "DUPLICATE", 0, 14), ("a", 15, "CONFLICT", 0, 14), ("a", 16, "OUT_OF_ORDER", 0, 13), ("b", 0, "HALT", 0, 11)]
    assert told(spark, root) == sorted(want + bad + new)
    assert sum(r["halts"] for r in progress) == 1

    # one HALT a silence: b stays quiet, then comes back and falls silent again
    send(spark, root, [(message("a", 16, 1.0), 19, 17), (message("a", 17, 1.0), 20, 20)])
    assert [x for x in told(spark, root) if x[2] == "HALT"] == [("b", 0, "HALT", 0, 11), ("c", 0, "HALT", 0, 5)]
    send(spark, root, [(message("b", 12, 1.0), 21, 21)])
    send(spark, root, [(message("a", 30, 1.0), 22, 31), (message("a", 31, 1.0), 23, 32)])
    halts = [x for x in told(spark, root) if x[2] == "HALT"]
    assert halts == [("a", 0, "HALT", 0, 17), ("b", 0, "HALT", 0, 11), ("b", 0, "HALT", 0, 12), ("c", 0, "HALT", 0, 5)] or halts == [("b", 0, "HALT", 0, 11), ("b", 0, "HALT", 0, 12), ("c", 0, "HALT", 0, 5)]


def test_silence_by_the_machines_clock(spark, tmp_path):
    """No further message at all: a symbol that falls silent is told to halt, once."""
    import time

    root = str(tmp_path)
    spark.createDataFrame([(message("a", 10, 1.0), 1, 11 * STEP)], "body string, seq long, arrived long").write.parquet(f"{root}/in")
    source = spark.readStream.schema("body string, seq long, arrived long").parquet(f"{root}/in")
    spark.conf.set(cb.STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = cb.judged(source, STEP, 500, wall=True, forget=3_600_000).writeStream.format("memory").queryName("wall").trigger(processingTime="300 milliseconds").start()
        try:
            for _ in range(120):
                if spark.table("wall").where("event = 'HALT'").count():
                    break
                time.sleep(0.5)
            time.sleep(2)
        finally:
            run.stop()
    finally:
        spark.conf.unset(cb.STORE)
    rows = spark.table("wall").select("symbol", "event", F.col("open_time") / STEP).collect()
    assert sorted(tuple(r) for r in rows) == [("a", "ACCEPTED", 10.0), ("a", "HALT", 10.0)]
