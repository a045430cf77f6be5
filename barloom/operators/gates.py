"""Regimes, selection gates and validity reasons as column comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ts import finite, over, ratio
from barloom.operators import joins
from barloom.sources import stores

#: The thresholds of the six selection gates. All comparisons are strict.
LIMITS = {"sharpe": 1.0, "fitness": 1.0, "turnover": (0.01, 0.70), "positive": 0.5, "stress": 0.0}
#: The cost multiplier of the stressed Sharpe ratio, and what its turnover floor is.
STRESS, FLOOR = 2.0, 0.125
OUT_OF_SAMPLE = ("valid", "test")
#: The version under which the thresholds are recorded.
CONFIG = "gates_v1"


def terciles(rows: DataFrame, value: str, before: int) -> DataFrame:
    """(symbol, q1, q2): linear quantiles 1/3 and 2/3 of known values before a time; NULL below three distinct values."""
    known = rows.where(F.col(value).isNotNull() & (F.col("open_time") < before)).select("symbol", F.col(value).cast("double").alias("v"))
    found = quantiles(known, "symbol", "v", {"q1": (1, 3), "q2": (2, 3)})
    enough = F.col("distinct") >= 3
    return found.select("symbol", *[F.when(enough, F.col(q)).alias(q) for q in ("q1", "q2")])


#: Parts that a range is cut into in each round of the search for a rank.
PARTS = 512


def quantiles(rows: DataFrame, key: str, value: str, wanted: dict[str, tuple[int, int]], most_rounds: int = 400) -> DataFrame:
    """(key, distinct, one column a quantile): exact linear quantiles, each asked for as a fraction of whole numbers.

    No task holds a key's values. A rank is looked for in a range: its values are counted in ``PARTS`` equal parts, and the
    part that holds the rank, narrowed to its least and largest value, is the next range, until those are the same. All ranks
    of all keys go on together, and a round's counts are combined before they are exchanged. ``distinct`` counts to three.
    """
    rows = stores.settle(rows.select(F.col(key).alias("key"), F.col(value).alias("v")))
    ends = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ends = stores.settle(ends)
    between = rows.join(ends, rows["key"].eqNullSafe(ends["key"])).groupBy(ends["key"]).agg(F.max((F.col("v") > F.col("low")) & (F.col("v") < F.col("high"))).alias("more"))
    ends = stores.settle(ends.join(between.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key"))).drop("_key"))
    asked = []
    for name, (a, b) in wanted.items():  # the values on both sides of the wanted place, counted from 0
        below = F.expr(f"(n - 1) * {a} div {b}")
        asked += [F.struct(F.lit(name).alias("name"), side.alias("rank")) for side in (below, F.least(below + 1, F.col("n") - 1))]
    targets = ends.select("key", "low", "high", F.explode(F.array_distinct(F.array(*[x["rank"] for x in asked]))).alias("rank")).withColumn("skip", F.col("rank"))
    done = None
    for _ in range(most_rounds):
        targets = stores.settle(targets)
        over = targets.where("low = high").select("key", "rank", F.col("low").alias("found"))
        done = over if done is None else done.unionByName(over)
        targets = targets.where("low < high")
        if targets.isEmpty():
            break
        held = rows.join(joins.small(targets.withColumnRenamed("key", "_key")), F.col("key").eqNullSafe(F.col("_key")) & F.col("v").between(F.col("low"), F.col("high")))
        # halves keep the width of the widest range finite
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * PARTS), F.lit(PARTS - 1))
        counts = held.groupBy("key", "rank", "skip", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy("key", "rank").orderBy("part"))
        counts = counts.withColumn("upto", upto).where((F.col("upto") > F.col("skip")) & (F.col("upto") - F.col("c") <= F.col("skip")))
        targets = counts.select("key", F.col("least").alias("low"), F.col("most").alias("high"), "rank", (F.col("skip") - (F.col("upto") - F.col("c"))).alias("skip"))
    else:
        raise RuntimeError(f"ranks not found in {most_rounds} rounds")
    values = done.groupBy(F.col("key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("_v"))
    out = ends.join(values, F.col("key").eqNullSafe(F.col("_key")))
    columns = {}
    for i, (name, (a, b)) in enumerate(wanted.items()):
        low, high = (F.col("_v")[asked[2 * i + side]["rank"]] for side in (0, 1))
        share = ((F.col("n") - 1) * a % b) / b
        columns[name] = low + (high - low) * share
    distinct = F.when(F.col("low") == F.col("high"), 1).when(F.col("more"), 3).otherwise(2)
    return out.select(F.col("key").alias(key), distinct.alias("distinct"), *[c.alias(n) for n, c in columns.items()])


def regimes(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return rows.withColumn("regime", F.when(v.isNull() | F.col("q1").isNull(), "unknown").when(v <= F.col("q1"), "low").when(v <= F.col("q2"), "mid").otherwise("high"))


def measured(rows: DataFrame, keys: list[str], per_year: float, part: Column) -> DataFrame:
    """What the gates look at, for each key: periods, Sharpe, fitness, turnover, the share of parts (weeks, months) with a
    Sharpe above zero, and the Sharpe under stressed costs. ``rows`` has net, gross, cost and turnover.

    Deviations are combined per part first, so a key with a long history is spread over tasks.
    """
    rows = rows.withColumns({"_part": part, "_stress": F.col("gross") - STRESS * F.col("cost")})
    sharpe = lambda c: ratio(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))) * per_year**0.5
    parts = rows.groupBy(*keys, "_part").agg(sharpe("net").alias("s")).groupBy(*keys)
    parts = parts.agg(F.avg(F.when(F.col("s").isNotNull(), (F.col("s") > 0).cast("double"))).alias("positive"))
    whole = rows.groupBy(*keys).agg(
        F.count("net").alias("periods"), sharpe("net").alias("sharpe"), (F.avg("net") * per_year).alias("annual"),
        F.avg("turnover").alias("turnover"), sharpe("_stress").alias("stress"),
    )
    fit = F.col("sharpe") * F.sqrt(F.abs("annual") / F.greatest("turnover", F.lit(FLOOR)))
    return whole.join(parts, keys).withColumn("fitness", fit)


def _outcome(gate: str, value: Column, passed: Column, reason: Column) -> Column:
    known = F.coalesce(passed, F.lit(False))
    return F.struct(F.lit(gate).alias("gate"), known.alias("passed"), value.cast("double").alias("value"), F.when(~known, reason).alias("reason"))


def decisions(rows: DataFrame, split: str = "split") -> DataFrame:
    """Six rows a measurement, G1 to G6 (gate, passed, value, reason), beside its other columns; an unknown value fails."""
    value = {g: F.col(c) for g, c in (("G1", "sharpe"), ("G2", "fitness"), ("G3", "turnover"), ("G5", "positive"), ("G6", "stress"))}
    low, high = LIMITS["turnover"]
    above = {g: value[g] > LIMITS[c] for g, c in (("G1", "sharpe"), ("G2", "fitness"), ("G5", "positive"), ("G6", "stress"))}
    above["G3"] = (value["G3"] > low) & (value["G3"] < high)
    missed = lambda v: F.when(v.isNull(), "unavailable").otherwise("threshold_not_met")
    outside = F.col(split).isin(*OUT_OF_SAMPLE)
    each = [_outcome(g, value[g], above[g], missed(value[g])) for g in value]
    each.append(_outcome("G4", outside.cast("double"), outside, F.lit("in_sample")))
    return rows.withColumn("_g", F.explode(F.array(*each))).select(*rows.columns, "_g.*")


def status(decided: DataFrame, keys: list[str]) -> DataFrame:
    """EVALUATED where all gates pass, else REJECTED with the gates that fail."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",")
    out = decided.groupBy(*keys).agg(F.bool_and("passed").alias("all"), failed.alias("failed"))
    return out.select(*keys, F.when(F.col("all"), "EVALUATED").otherwise("REJECTED").alias("status"), "failed")


def coverage(days: DataFrame, certified: Column, expected: int | Column, least: float) -> DataFrame:
    """Gates G7 (the source is certified) and G8 (complete sessions over expected ones); days has symbol and complete."""
    share = F.count_if("complete") / F.any_value(F.lit(expected) if isinstance(expected, int) else expected)
    rows = days.groupBy("symbol").agg(F.bool_and(certified).alias("c"), share.alias("s"))
    one = lambda gate, passed, value: F.struct(F.lit(gate).alias("gate"), passed.alias("passed"), value.alias("value"))
    each = F.array(one("G7", F.col("c"), F.col("c").cast("double")), one("G8", F.col("s") >= least, F.col("s")))
    return rows.select("symbol", F.explode(each).alias("g")).select("symbol", "g.*")


#: The names of the reasons against a final test, in order.
REASONS = ["NOT_VALID_SPLIT", "INVALID_MEASUREMENT", "VALID_GATES_FAILED", "DIRTY_SOURCE", "GATE_CONFIG_MISMATCH", "METRICS_DO_NOT_PASS_GATES"]


def eligibility(rows: DataFrame, decided: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Recorded results (split, status, dirty, config, periods) with the reasons that bar each from a final test.

    ``decided`` holds the gates recomputed from the recorded measurements.
    """
    now = status(decided, keys).select(*keys, F.col("status").alias("_now"))
    rows = rows.join(now, keys, "left")
    holds = [
        F.col("split") != "valid",
        F.col("status") == "INVALID",
        ~F.col("status").isin("EVALUATED", "PROMOTED", "INVALID"),
        F.col("dirty"),
        F.col("config") != CONFIG,
        (F.col("periods") < least) | ~F.coalesce(F.col("_now") == "EVALUATED", F.lit(False)),
    ]
    reasons = F.concat_ws(", ", *[F.when(h, F.lit(name)) for h, name in zip(holds, REASONS, strict=True)])
    return rows.withColumn("reasons", reasons).drop("_now")


def shortlist(eligible: DataFrame, most: int, order: list[str]) -> DataFrame:
    """At most ``most`` results without a reason against them, by fitness and then ``order``."""
    return eligible.where("reasons = ''").orderBy(F.desc_nulls_last("fitness"), *order).limit(most)


#: Why a series can't be judged, in order.
FAULTS = ["too few periods", "non-finite", "unavailable after warm-up", "constant", "data gaps", "bad prices"]


def validity(rows: DataFrame, step: int, warmup: int, least: int, usable: Column | None = None, bad: Column | None = None) -> DataFrame:
    """(symbol, reasons): the faults of each series of symbol, open_time, open, high, low, close and raw, the signal before
    non-finite values are made unknown. ``usable`` says which values of raw are finite enough, ``bad`` which bars have wrong
    prices; by default infinities are not, and open and close lie between a low above zero and the high."""
    w = over()
    rows = rows.withColumns({"_rn": F.row_number().over(w), "_gap": F.col("open_time") - F.lag("open_time").over(w) != step})
    late = F.col("_rn") > warmup
    usable = finite(F.col("raw")).isNotNull() if usable is None else usable
    if bad is None:
        bad = ~((F.col("low") > 0) & F.col("close").between(F.col("low"), F.col("high")) & F.col("open").between(F.col("low"), F.col("high")))
    seen = F.when(late & usable, F.col("raw"))
    found = rows.groupBy("symbol").agg(
        (F.count_if(late) - 1 < least).alias("f0"), F.bool_or(F.col("raw").isNotNull() & ~usable).alias("f1"), F.bool_or(late & ~usable).alias("f2"),
        (F.min(seen) == F.max(seen)).alias("f3"), F.bool_or("_gap").alias("f4"), F.bool_or(bad).alias("f5"),
    )
    return found.select("symbol", F.concat_ws(", ", *[F.when(F.col(f"f{i}"), F.lit(name)) for i, name in enumerate(FAULTS)]).alias("reasons"))
