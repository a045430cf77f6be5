"""The closed-bar stream: decoding, contract, per-symbol marks, resampling and staleness."""

from __future__ import annotations

import threading
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.operators import features, joins

MINUTE = 60_000_000


def encode(bars: DataFrame, interval: str, closed: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Bars as stream messages (body, and the columns to keep); times in milliseconds, numbers as text."""
    text = lambda c: F.col(c).cast("string")
    k = F.struct(
        F.col("symbol").alias("s"), F.lit(interval).alias("i"), F.expr("open_time div 1000").alias("t"), F.expr("close_time div 1000").alias("T"),
        text("open").alias("o"), text("high").alias("h"), text("low").alias("l"), text("close").alias("c"), text("volume").alias("v"), text("quote_volume").alias("q"),
        F.col("trades").alias("n"), text("taker_buy_base").alias("V"), text("taker_buy_quote").alias("Q"), (F.lit(True) if closed is None else closed).alias("x"),
    )
    data = F.struct(F.lit("kline").alias("e"), F.col("symbol").alias("s"), F.expr("close_time div 1000 + 1").alias("E"), k.alias("k"))
    return bars.select(F.to_json(F.struct(data.alias("data"))).alias("body"), *(keep or []))


def decode(messages: DataFrame, body: str = "body", interval: str | None = None) -> DataFrame:
    """Every message with a status: closed, open (in progress) or malformed; the bar's columns where it is closed.

    Envelope and bar must name the same symbol (and the interval that is asked for), times be whole and not negative and the
    close a number."""
    text_map = "map<string, string>"  # fields that differ only in case are told apart as map keys
    m = messages.withColumn("_d", F.from_json(F.from_json(body, text_map)["data"], text_map)).withColumn("_k", F.from_json(F.col("_d")["k"], text_map))
    k = lambda f: F.col("_k")[f]
    whole = lambda f: k(f).try_cast("long")
    number = lambda f: k(f).try_cast("double")
    text = lambda f: k(f).isNotNull() & number(f).isNotNull()
    bad = (
        F.coalesce(whole("t") < 0, F.lit(True)) | F.coalesce(whole("T") < whole("t"), F.lit(True)) | k("s").isNull() | k("x").isNull() | ~k("x").isin("true", "false")
        | ~F.coalesce(k("s") == F.col("_d")["s"], F.lit(False)) | ~F.coalesce(F.col("_d")["e"] == "kline", F.lit(False)) | k("i").isNull() | ~text("c")
    )
    if interval is not None:
        bad = bad | (k("i") != interval)
    keep = [c for c in messages.columns if c != body]
    return m.select(
        *keep,
        F.when(bad, "malformed").when(k("x") == "true", "closed").otherwise("open").alias("status"),
        k("s").alias("symbol"), (whole("t") * 1000).alias("open_time"), (whole("T") * 1000 + 999).alias("close_time"),
        *[number(f).alias(n) for f, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("q", "quote_volume"))],
        whole("n").alias("trades"), number("V").alias("taker_buy_base"), number("Q").alias("taker_buy_quote"), (F.col("_d")["E"].try_cast("long") * 1000).alias("event_time"),
    )


def contract(step: int) -> Column:
    """On the grid, one step long, seen after its end, consistent prices, taker volume within the total."""
    return (
        (F.col("open_time") % step == 0)
        & (F.col("close_time") - F.col("open_time") == step - 1)
        & (F.col("event_time") >= F.col("close_time"))
        & (F.col("low") <= F.least("open", "close"))
        & (F.col("high") >= F.greatest("open", "close"))
        & (F.col("taker_buy_base") <= F.col("volume"))
    )


#: Columns of a bar as the stream keeps it.
BAR = "seq long, arrived long, symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double, event_time long"
#: What the stream puts out: bars, and events of everything else; a gap is both.
FOLLOWED = f"sink string, event string, missing long, {BAR}"
#: Key of messages that move no state; no symbol begins with it.
ASIDE = "\0"
NEVER = -(2**63)


class Marks(StatefulProcessor):
    """Each symbol's high-water mark: its last accepted time, that bar's close, and the timer that tells of a silence.

    A bar one step past the mark is ACCEPTED, a later one too, after a GAP of ``missing`` bars; the marked bar again is a
    DUPLICATE or, with another close, a CONFLICT; an earlier one is OUT_OF_ORDER. Only accepted bars move the mark. Rows of a
    batch are taken in order of ``seq``; the mark before each is a running maximum. Every accepted bar sets the symbol's timer
    anew, ``limit`` milliseconds after it arrived; a timer that runs out is one HALT, and the symbol is quiet until it is
    accepted again.
    """

    def __init__(self, step: int, limit: int, wall: bool, forget: int | None):
        self.step, self.limit, self.wall, self.forget = step, limit, wall, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "open_time long, close double, expires long", self.forget)

    def handleInputRows(self, key, rows, timerValues):
        part = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable", ignore_index=True)
        if key[0].startswith(ASIDE):
            yield self.put(part, "events", part["event"], 0)
            return
        held = self.mark.get() if self.mark.exists() else None
        mark, close, expires = held or (NEVER, None, NEVER)
        t, said = part["open_time"].to_numpy(np.int64), part["close"].to_numpy()
        top = np.maximum.accumulate(np.concatenate([[mark], t]))[:-1]
        first = part.groupby("open_time")["close"].transform("first").to_numpy()
        first = np.where((t == mark) & (mark != NEVER), close, first)
        ahead = np.where(top == NEVER, self.step, t - np.where(top == NEVER, 0, top))
        event = np.select([ahead == self.step, ahead > 0, ahead < 0, said == first], ["ACCEPTED", "GAP", "OUT_OF_ORDER", "DUPLICATE"], "CONFLICT")
        missing = np.where(event == "GAP", ahead // self.step - 1, 0)
        taken, told = np.isin(event, ["ACCEPTED", "GAP"]), event != "ACCEPTED"
        if taken.any():
            last = part[taken].iloc[-1]
            if expires != NEVER:
                self.handle.deleteTimer(expires)
            now = timerValues.getCurrentProcessingTimeInMs() if self.wall else int(last["arrived"]) // 1000
            self.handle.registerTimer(now + self.limit)
            self.mark.update((int(last["open_time"]), float(last["close"]), now + self.limit))
            yield self.put(part[taken], "bars", event[taken], missing[taken])
        if told.any():
            yield self.put(part[told], "events", event[told], missing[told])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.mark.exists():
            return
        mark, close, expires = self.mark.get()
        if expires == expiredTimerInfo.getExpiryTimeInMs():
            self.mark.update((mark, close, NEVER))
            yield self.put(pd.DataFrame({"symbol": [key[0]], "open_time": [mark], "arrived": [expires * 1000]}), "events", "HALT", 0)

    def put(self, rows: pd.DataFrame, sink: str, event, missing) -> pd.DataFrame:
        out = rows.reindex(columns=[c.split()[0] for c in BAR.split(", ")])
        for c in BAR.split(", "):
            name, kind = c.split()
            if kind == "long":
                out[name] = out[name].astype("Int64")
            elif kind == "double":
                out[name] = out[name].astype("float64")
        out.insert(0, "missing", np.asarray(missing, np.int64) if np.ndim(missing) else missing)
        out.insert(0, "event", np.asarray(event) if np.ndim(event) else event)
        out.insert(0, "sink", sink)
        return out


class Progress(StreamingQueryListener):
    """What each batch of one query reports of itself: its number, duration, input rows and observed counts."""

    def __init__(self, name: str):
        self.name, self.run, self.batches, self.over = name, None, [], threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            seen = p.observedMetrics.get("followed")
            self.batches.append((p.batchId, p.batchDuration, p.numInputRows, *[int(seen[c] or 0) if seen else 0 for c in COUNTED]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.over.set()


COUNTED = ["accepted", "updates", "gaps", "missing", "rejected", "halts"]
PROGRESS = "batch long, ms long, messages long, " + ", ".join(f"{c} long" for c in COUNTED)


def counted() -> list[Column]:
    """Counts of what the stream puts out."""
    is_ = lambda *names: (F.col("sink") == "events") & F.col("event").isin(*names)
    gap = is_("GAP")
    return [
        F.count_if(F.col("sink") == "bars").alias("accepted"), F.count_if(is_("open")).alias("updates"), F.count_if(gap).alias("gaps"), F.sum(F.when(gap, F.col("missing"))).alias("missing"),
        F.count_if(is_("DUPLICATE", "CONFLICT", "OUT_OF_ORDER", "refused", "malformed")).alias("rejected"), F.count_if(is_("HALT")).alias("halts"),
    ]


def judged(messages: DataFrame, step: int, limit: int, slack: str = "1 second", wall: bool = False, forget: int | None = None) -> DataFrame:
    """A stream of messages (body, seq, arrived in microseconds) to rows of FOLLOWED, by one stateful operator.

    ``limit`` (milliseconds) is the silence after which a symbol is told to HALT: by the clock of arrival, which moves on with
    any symbol's messages, or with ``wall`` by the machine's clock, where no message at all is needed (and state that nobody
    has touched for ``forget`` milliseconds may go). Messages may arrive ``slack`` behind the latest one.
    """
    rows = decode(messages)
    good = F.coalesce(contract(step), F.lit(False))
    event = F.when(F.col("status") != "closed", F.col("status")).when(~good, "refused")
    rows = rows.withColumn("event", event).drop("status")
    aside = F.concat(F.lit(ASIDE), F.pmod(F.hash("seq"), F.lit(16)).cast("string"))
    rows = rows.withColumn("key", F.when(F.col("event").isNull(), F.col("symbol")).otherwise(aside))
    if not wall:
        rows = rows.withColumn("clock", F.timestamp_micros("arrived")).withWatermark("clock", slack)
    return rows.groupBy("key").transformWithStateInPandas(Marks(step, limit, wall, forget if wall else None), FOLLOWED, "Append", "ProcessingTime" if wall else "EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"


def follow(messages: DataFrame, root: str, step: int, limit: int, state_partitions: int | None = None, **how) -> DataFrame:
    """Run a stream of messages over what is there now; returns the progress of its batches (PROGRESS).

    ``state_partitions`` (the session's shuffle partitions, if none are given) is fixed by the first run below a ``root``.

    One pass writes bars and events below ``root``/out, split by ``sink``; the file sink's log makes each batch appear once,
    and marks and timers live in the state store of ``root``/checkpoint, from which a later run goes on.
    """
    spark = messages.sparkSession
    name = f"followed-{uuid.uuid4().hex}"
    listener = Progress(name)
    wanted = {STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": state_partitions}
    before = {k: spark.conf.get(k, None) for k, v in wanted.items() if v is not None}
    for k in before:
        spark.conf.set(k, str(wanted[k]))
    spark.streams.addListener(listener)
    try:
        out = judged(messages, step, limit, **how).observe("followed", *counted())
        sink = out.writeStream.queryName(name).format("parquet").partitionBy("sink").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
        listener.over.wait(60)
    finally:
        spark.streams.removeListener(listener)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.createDataFrame(listener.batches, PROGRESS)


def sunk(spark: SparkSession, root: str, sink: str) -> DataFrame:
    """What a followed stream has put out to one sink."""
    return spark.read.schema(FOLLOWED).parquet(f"{root}/out").where(F.col("sink") == sink).drop("sink")


def summary(bars: DataFrame, events: DataFrame) -> DataFrame:
    """By symbol: bars accepted, updates in progress, gaps and bars missing in them, other events, and the time covered."""
    accepted = bars.groupBy("symbol").agg(F.count("*").alias("accepted"), (F.max("close_time") - F.min("open_time") + 1).alias("elapsed"))
    one = lambda *names: F.count_if(F.col("event").isin(*names))
    told = events.where("symbol is not null").groupBy("symbol").agg(
        one("open").alias("updates"), one("GAP").alias("gaps"), F.sum("missing").alias("missing"), one("DUPLICATE", "CONFLICT", "OUT_OF_ORDER", "refused").alias("rejected")
    )
    zero = F.lit(0).cast("long")
    out = accepted.join(told, "symbol", "full_outer")
    return out.select("symbol", *[F.coalesce(c, zero).alias(c) for c in ("accepted", "elapsed", "updates", "gaps", "missing", "rejected")])


def live_features(new: DataFrame, stored: DataFrame, step: int, names: list[str]) -> DataFrame:
    """Features of newly arrived bars by the batch functions, over them and each symbol's last stored bars that any of the
    features looks back on."""
    history = max(features.REGISTRY[n].lookback + features.REGISTRY[n].warmup for n in names)
    newest = new.groupBy("symbol").agg(F.min("open_time").alias("_from"))
    recent = stored.join(joins.small(newest), "symbol").where((F.col("open_time") < F.col("_from")) & (F.col("open_time") >= F.col("_from") - history * step)).drop("_from")
    keys = new.select("symbol", "open_time")
    return features.build(recent.unionByName(new.select(*recent.columns)), step, names).join(keys, ["symbol", "open_time"], "left_semi")


def observed_prices(rows: DataFrame) -> DataFrame:
    """Decoded messages to the last positive price of each symbol and minute of the event clock, from updates in progress
    only, never from a closed bar."""
    live = rows.where((F.col("status") == "open") & (F.col("close") > 0))
    minute = (F.expr(f"event_time div {MINUTE}") * MINUTE).alias("minute")
    return live.groupBy("symbol", minute).agg(F.max_by("close", "event_time").alias("price"))


def once(bars: DataFrame, late: str) -> DataFrame:
    """A stream of bars with each symbol and time once, for repeats that come within ``late``."""
    return bars.withColumn("_at", F.timestamp_micros("open_time")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["symbol", "open_time"])


def resample(bars: DataFrame, step: int, longer: int, late: str = "2 hours") -> DataFrame:
    """Tumbling windows of closed bars on a stream, put out once the watermark has passed and only when complete."""
    rows = bars.withColumn("ts", F.timestamp_micros("open_time")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "open_time"])
    out = rows.groupBy("symbol", F.window("ts", f"{longer // 1_000_000} seconds")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    return out.where(F.col("n") == longer // step).select("symbol", F.unix_micros("window.start").alias("open_time"), "open", "high", "low", "close", "volume")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there now and append it as Parquet; a rerun goes on from its checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(history: DataFrame, root: str, pieces: int, per_batch: int = 1) -> None:
    """Replay bars as a stream in order of close time, then symbol: cut at quantiles of the close time into pieces that are
    written one after the other, each sorted, and read ``per_batch`` files a batch, the oldest first. What arrives goes below
    ``root``/out with the number of its batch."""
    spark = history.sparkSession
    edges = history.agg(F.percentile_approx("close_time", [i / pieces for i in range(1, pieces)], 10_000)).first()[0] or []
    low = None
    for high in [*sorted(set(edges)), None]:
        inside = F.lit(True) if high is None else F.col("close_time") <= high
        inside = inside if low is None else inside & (F.col("close_time") > low)
        history.where(inside).repartition(1).sortWithinPartitions("close_time", "symbol").write.mode("append").parquet(f"{root}/in")
        low = high

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/of={number}")

    stream = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", per_batch).parquet(f"{root}/in")
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


def replayed(spark: SparkSession, root: str) -> DataFrame:
    """What a replay has delivered, with ``batch`` and ``early``: whether an earlier batch holds a bar that closes later."""
    rows = spark.read.parquet(f"{root}/out").drop("of")
    tops = rows.groupBy("batch").agg(F.max("close_time").alias("_top"))  # a row a batch
    before = tops.withColumn("_before", F.max("_top").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(F.broadcast(before.select("batch", "_before")), "batch").withColumn("early", F.coalesce(F.col("close_time") < F.col("_before"), F.lit(False))).drop("_before")
