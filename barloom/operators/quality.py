"""Bar rules, off-grid rows, gaps, duplicates, reports and content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import scan


def clock_micros(t: Column) -> Column:
    """Milliseconds or microseconds as microseconds, value by value; NULL outside 2009 to 2100."""
    us = F.when(t >= 100_000_000_000_000, t).otherwise(t * 1000)
    return F.when((us >= 1_230_768_000_000_000) & (us < 4_102_444_800_000_000), us)


#: Rule names and when a row breaks them; a NULL input breaks the rule.
RULES: list[tuple[str, str]] = [
    ("price not above zero", "not (open > 0 and high > 0 and low > 0 and close > 0)"),
    ("high below low", "not (high >= low)"),
    ("open outside range", "not (open between low and high)"),
    ("close outside range", "not (close between low and high)"),
    ("negative volume", "not (volume >= 0 and quote_volume >= 0)"),
    ("negative trades", "not (trades >= 0)"),
    ("taker above total", "not (taker_buy_base <= volume * (1 + 1e-9) and taker_buy_quote <= quote_volume * (1 + 1e-9))"),
    ("close time not after open time", "not (close_time > open_time)"),
]


def problems(rules: list[tuple[str, str]] = RULES) -> Column:
    """Names of the broken rules in one string; empty for a good row."""
    return F.concat_ws(", ", *[F.when(F.coalesce(F.expr(rule), F.lit(True)), F.lit(name)) for name, rule in rules])


def validate(bars: DataFrame) -> DataFrame:
    return bars.withColumn("problem", problems()).where("problem <> ''")


def off_grid(bars: DataFrame, step: int) -> DataFrame:
    return bars.where(F.pmod("open_time", F.lit(step)) != 0)


def gaps(bars: DataFrame, step: int, *keys: str) -> DataFrame:
    """Runs of missing bars between on-grid rows: (keys, gap_start, gap_end, missing)."""
    keys = keys or ("symbol",)
    on_grid = bars.where(F.pmod("open_time", F.lit(step)) == 0).select(*keys, "open_time").distinct()
    found = scan.scanned(on_grid, list(keys), scan.by_time(step), ["open_time"], before={"_last": F.col("open_time")}).where(F.col("open_time") - F.col("_last") > step)
    return found.select(
        *keys,
        (F.col("_last") + step).alias("gap_start"),
        (F.col("open_time") - step).alias("gap_end"),
        (F.expr(f"(open_time - _last) div {step}") - 1).alias("missing"),
    )


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows whose key occurs more than once: counted by key first, then joined, so a hot key is combined early."""
    return rows.join(rows.groupBy(*keys).count().where("count > 1").drop("count"), list(keys), "left_semi")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a declared order; a combinable minimum, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*keys, "r.*").select(*rows.columns)


def report(bars: DataFrame, step: int) -> DataFrame:
    """Broken rules and off-grid rows together, with a readable time."""
    bad = validate(bars).select("symbol", "open_time", "problem")
    off = off_grid(bars, step).select("symbol", "open_time", F.lit("off grid").alias("problem"))
    utc = F.date_format(F.timestamp_micros("open_time"), "yyyy-MM-dd HH:mm:ss")
    return bad.unionByName(off).withColumn("utc", utc).orderBy("symbol", "open_time", "problem")


def summary(bars: DataFrame, step: int) -> DataFrame:
    """Per symbol: bars, first, last, bad, off-grid, gap runs, missing bars, longest gap."""
    base = bars.withColumn("problem", problems()).groupBy("symbol").agg(
        F.count("*").alias("bars"),
        F.min("open_time").alias("first"),
        F.max("open_time").alias("last"),
        F.count_if(F.col("problem") != "").alias("bad"),
        F.count_if(F.pmod("open_time", F.lit(step)) != 0).alias("off_grid"),
    )
    holes = gaps(bars, step).groupBy("symbol").agg(
        F.count("*").alias("gap_runs"), F.sum("missing").alias("missing"), F.max(F.struct("missing", (-F.col("gap_start")).alias("s"))).alias("worst")
    )
    zero = F.lit(0).cast("long")
    return base.join(holes, "symbol", "left").select(
        "symbol", "bars", "first", "last", "bad", "off_grid", F.coalesce("gap_runs", zero).alias("gap_runs"), F.coalesce("missing", zero).alias("missing"), (-F.col("worst.s")).alias("worst_start")
    )


def content_id(rows: DataFrame, line: Column, groups: int = 4096) -> DataFrame:
    """One SHA-256 of a manifest, whatever the order of its lines: digests of the sorted lines of ``groups`` groups by the
    line's hash, then the digest of those in order, so no task holds the whole manifest."""
    lines = rows.select(line.alias("line")).withColumn("g", F.conv(F.substring(F.sha2("line", 256), 1, 8), 16, 10).cast("long") % groups)
    each = lines.groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("sha"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "sha"))), lambda x: x["sha"]), "\n")
    return each.agg(F.sha2(joined, 256).alias("id"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows equally often, and how many distinct rows differ. One exchange."""
    both = left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(-1)))
    off = both.groupBy(*left.columns).agg(F.sum("_s").alias("_s")).agg(F.count_if(F.col("_s") != 0).alias("different"))
    return off.select((F.col("different") == 0).alias("same"), "different")


def order_free_digests(rows: DataFrame) -> DataFrame:
    """(part, n, total, mixed): digests of whole rows and of each column of text that don't depend on the order of rows and are
    combined before the exchange: sum and xor of the first 60 bits of each MD5."""
    parts = {"row": F.concat_ws("|", *rows.columns)} | {c: F.col(c) for c in rows.columns}
    bits = lambda text: F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    seen = rows.agg(F.count("*").alias("n"), *[f(bits(x)).alias(f"{k}_{name}") for name, x in parts.items() for k, f in (("s", lambda d: F.sum(d.cast("decimal(38,0)"))), ("x", F.bit_xor))])
    each = F.array(*[F.struct(F.lit(p).alias("part"), (F.col(f"s_{p}") % 1_000_000_007).cast("long").alias("total"), F.col(f"x_{p}").alias("mixed")) for p in parts])
    return seen.select("n", F.explode(each).alias("e")).select("e.part", "n", "e.total", "e.mixed")


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files whose digest differs between two manifests (path, sha)."""
    a, b = old.select("path", F.col("sha").alias("old_sha")), new.select("path", F.col("sha").alias("new_sha"))
    return a.join(b, "path", "full_outer").where(~F.col("old_sha").eqNullSafe(F.col("new_sha"))).select(
        "path", F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").otherwise("changed").alias("status")
    )


def not_unique(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def prediction_faults(rows: DataFrame, begin: Column, end: Column, step: int, horizon: int) -> DataFrame:
    """One row of counts on a table of predictions (symbol, open_time, label_end, target, label, p): rows outside the window,
    of another horizon, with a label that isn't target > 0, with p outside [0, 1], and rows whose key occurs again."""
    outside = (F.col("open_time") < begin) | (F.col("label_end") >= end) | (F.pmod("open_time", F.lit(step)) != 0)
    flags = {
        "outside": outside,
        "wrong_horizon": F.col("label_end") - F.col("open_time") != horizon * step,
        "wrong_label": F.col("label") != (F.col("target") > 0).cast("int"),
        "wrong_probability": ~F.coalesce(F.col("p").between(0, 1), F.lit(False)),
    }
    keys = rows.groupBy("symbol", "open_time").agg(F.count("*").alias("n"), *[F.count_if(x).alias(c) for c, x in flags.items()])
    return keys.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in flags], F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))


def unbalanced_orders(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Orders (order_id, quantity, filled, remaining) that break conservation, with the names of what they break; fills
    without an order count as one of them."""
    sums = fills.groupBy("order_id").agg(F.sum("quantity").alias("_s"))
    both = orders.join(sums, "order_id", "full_outer")
    lost = F.col("quantity").isNull()
    split = ~lost & (F.col("quantity") != F.col("filled") + F.col("remaining"))
    wrong = ~lost & (F.col("filled") != F.coalesce("_s", F.lit(0.0)))
    problem = F.concat_ws(", ", F.when(lost, "no order"), F.when(split, "quantity"), F.when(wrong, "fills"))
    return both.select("order_id", problem.alias("problem")).where("problem <> ''")


def broken_constraints(rows: DataFrame, rules: list[tuple[str, str]], keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(rule, broken): how many rows break each rule (SQL text; an unknown outcome breaks it) and each foreign key."""
    counts = rows.agg(*[F.count_if(~F.coalesce(F.expr(text), F.lit(False))).alias(name) for name, text in rules])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("broken")) for n, _ in rules])).alias("r")).select("r.*")
    for name, (parent, key) in keys.items():
        lost = rows.join(parent.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("broken"))
        out = out.unionByName(lost.select(F.lit(name).alias("rule"), "broken"))
    return out
