"""Fills to positions, cash and charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import scan


#: Scale of quantities, so that running ones meet zero exactly.
QUANTITY = "decimal(30,10)"


def running(fills: DataFrame, keys: list[str], order: list[str], bps: float, piece_rows: int = scan.PIECE_ROWS) -> DataFrame:
    """Running quantity, cash and fees of each account; fills have a signed quantity and a price. Pieces of the table's time
    (the first column of ``order``), so an account of any number of fills is spread over tasks."""
    value = F.col("signed") * F.col("price")
    sums = {"quantity": F.col("signed"), "cash": -value, "fees": F.abs(value) * (bps / 10_000)}
    return scan.scanned(fills, keys, scan.by_rows(fills, order[0], piece_rows), order, sums=sums)


def once(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Fills with each key booked once; repeats that report another quantity, price or time are an error."""
    said = fills.groupBy(*keys).agg(F.min(F.struct("t", "signed", "price")).alias("a"), F.max(F.struct("t", "signed", "price")).alias("b"))
    broken = F.when(~F.col("a").eqNullSafe(F.col("b")), F.raise_error(F.concat(F.lit("conflicting reports of fill "), F.concat_ws("/", *keys))).cast("double"))
    return said.select(*keys, "a.t", "a.signed", F.coalesce(broken, F.col("a.price")).alias("price"))


#: Weights are kept in stretches over which they grow by no more than e to this power.
STRETCH = 300.0


def progress(fills: DataFrame, account: str, piece_rows: int = scan.PIECE_ROWS) -> DataFrame:
    """Every fill (t, event_id, signed, price) with the quantity and average cost after it and the gain that it realises.

    A fill changes the average of an open position affinely, a -> A a + B: opening or turning forgets it (A = 0), adding
    weighs it, reducing keeps it, and A and B follow from the running quantity alone. Within a piece of an account the maps are
    composed by running sums: with L the sum of -ln A since the last fill that forgets, the average is the sum of B e^L over
    the fills so far, times e^-L, and what entered the piece counts e^-L until something forgets it. Sums of e^L are taken
    over stretches of L, of which only the one before still counts. The pieces' maps are then composed in order, at most
    ``scan.MOST_PIECES`` of them, and give what enters each piece. Quantities are decimals, averages doubles.
    """
    rows = fills.withColumn("_s", F.col("signed").cast(QUANTITY))
    piece, order = scan.by_rows(fills, "t", piece_rows), ["t", "event_id"]
    rows = scan.scanned(rows, [account], piece, order, sums={"_q": F.col("_s")}).withColumn("_piece", piece).withColumn("_was", F.col("_q") - F.col("_s"))
    size = lambda c: F.abs(F.col(c)).cast("double")
    adds = (F.signum("_was") == F.signum("_s")) & (F.col("_was") != 0)
    forgets = (F.col("_s") != 0) & ~adds & ((F.col("_was") == 0) | (F.signum("_q") != F.signum("_was")))
    weight = size("_was") / (size("_was") + size("_s"))
    rows = rows.withColumns({
        "_adds": adds, "_forgets": forgets,
        "_l": F.when(adds, -F.ln(weight)).otherwise(0.0),
        "_b": F.when(adds, F.col("price") * (1 - weight)).when(forgets & (F.col("_q") != 0), F.col("price")).otherwise(0.0),
    })
    upto = lambda *keys: Window.partitionBy(account, "_piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_part", F.sum(F.col("_forgets").cast("long")).over(upto()))
    rows = rows.withColumn("_l", F.sum("_l").over(upto("_part"))).withColumn("_stretch", F.floor(F.col("_l") / STRETCH))
    power = F.exp(F.col("_l") - F.col("_stretch") * STRETCH)
    rows = rows.withColumn("_sum", F.sum(F.col("_b") * power).over(upto("_part", "_stretch")))
    whole = F.max_by("_sum", F.struct(*order)).over(Window.partitionBy(account, "_piece", "_part").orderBy("_stretch").rangeBetween(-1, -1))
    rows = rows.withColumn("_sum", F.col("_sum") + F.coalesce(whole, F.lit(0.0)) * F.exp(F.lit(-STRETCH)))
    rows = rows.withColumns({"_b": F.col("_sum") / power, "_a": F.when(F.col("_part") == 0, F.exp(-F.col("_l"))).otherwise(0.0)})
    maps = rows.groupBy(account, "_piece").agg(F.max_by(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")), F.struct(*order)).alias("_map"))
    past = Window.partitionBy(account).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    enter = F.aggregate(F.collect_list("_map").over(past), F.lit(0.0), lambda v, m: m["a"] * v + m["b"])
    maps = maps.select(F.col(account).alias("_account"), F.col("_piece").alias("_of"), enter.alias("_enter"))
    rows = rows.join(maps, F.col(account).eqNullSafe(F.col("_account")) & (F.col("_piece") == F.col("_of")))
    rows = rows.withColumn("average", F.when(F.col("_q") == 0, 0.0).otherwise(F.col("_a") * F.col("_enter") + F.col("_b")))
    held = F.coalesce(F.lag("average").over(Window.partitionBy(account, "_piece").orderBy(*order)), F.col("_enter"))
    closed = F.least(size("_s"), size("_was")) * F.signum("_was").cast("double")
    gain = F.when(F.col("_adds") | (F.col("_was") == 0), 0.0).otherwise(closed * (F.col("price") - held))
    return rows.select(*fills.columns, F.col("_q").cast("double").alias("quantity"), "average", gain.alias("gain"))


def book(fills: DataFrame, account: str, bps: float, piece_rows: int = scan.PIECE_ROWS) -> DataFrame:
    """Average-cost books: account, quantity, average, realised, fees. Fill ids that repeat are booked once."""
    rows = progress(once(fills, [account, "event_id"]), account, piece_rows)
    fee = F.abs(F.col("signed") * F.col("price")) * (bps / 10_000)
    last = F.max_by(F.struct("quantity", "average"), F.struct("t", "event_id"))
    out = rows.groupBy(F.col(account).alias("account")).agg(last.alias("_l"), F.sum("gain").alias("realised"), F.sum(fee).alias("fees"))
    return out.select("account", "_l.quantity", "_l.average", "realised", "fees")


def capped(rows: DataFrame, keys: list[str], order: list[str], fee: Column, cap: float) -> DataFrame:
    """Brokerage of each fill as the difference of the order's capped running fee."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_f", fee).withColumn("_c", F.sum("_f").over(w))
    return rows.withColumn("brokerage", F.least("_c", F.lit(cap)) - F.least(F.col("_c") - F.col("_f"), F.lit(cap))).drop("_f", "_c")


#: Shares of traded value. Exchange and investor-fund rates hold from a day on.
RATES = [("1900-01-01", 297e-7, 10e-7), ("2026-03-01", 306.99e-7, 0.01e-7)]
BROKERAGE, CAP, REGULATOR, STAMP, TAX, SERVICE = 0.0003, 20.0, 10e-7, 0.00003, 0.00025, 0.18


def _dated(day: Column, rates: list[tuple[str, float, float]], at: int) -> Column:
    out = F.lit(rates[0][at])
    for rate in rates[1:]:
        out = F.when(day >= rate[0], F.lit(rate[at])).otherwise(out)
    return out


def charges(trades: DataFrame, rates: list[tuple[str, float, float]] = RATES, *keys: str) -> DataFrame:
    """Estimated charges of each day (and further keys) of trades: day (text), order_id, security, buy, quantity, price.

    Brokerage is capped for each order. The transaction tax takes a security's rounded average price of the day, rounds to
    the paisa by security and to the rupee by day. A day's quantity of a security must be flat; others have ``flat`` false.
    """
    by = [*keys, "day"]
    value = F.col("quantity") * F.col("price")
    rows = trades.withColumns({"_v": value, "_b": F.when(F.col("buy"), F.col("quantity")).otherwise(0.0), "_bv": F.when(F.col("buy"), value).otherwise(0.0)})
    orders = rows.groupBy(*by, "order_id").agg(F.least(F.sum("_v") * BROKERAGE, F.lit(CAP)).alias("b"), F.sum("_v").alias("v"), F.sum("_bv").alias("bv"))
    day = F.col("day")
    sums = orders.groupBy(*by).agg(
        F.sum("b").alias("brokerage"), F.sum("v").alias("turnover"), (F.sum("bv") * STAMP).alias("stamp"), (F.sum("v") * REGULATOR).alias("regulator"), F.count("*").alias("orders")
    )
    sums = sums.withColumns({"exchange": F.col("turnover") * _dated(day, rates, 1), "fund": F.col("turnover") * _dated(day, rates, 2)})
    held = rows.groupBy(*by, "security").agg(F.sum("_v").alias("v"), F.sum("quantity").alias("q"), F.sum("_b").alias("bq"))
    sold = F.col("q") - F.col("bq")
    tax = F.round(sold * F.round(F.col("v") / F.col("q"), 2) * TAX, 2)
    taxed = held.groupBy(*by).agg(F.round(F.round(F.sum(tax), 2), 0).alias("tax"), F.bool_and(F.col("bq") == sold).alias("flat"))
    service = (F.col("brokerage") + F.col("exchange") + F.col("fund") + F.col("regulator")) * SERVICE
    return sums.join(taxed, by).withColumn("service", service)


def round_trip_fees(quantity: Column, buy: Column, sell: Column, day: Column, rates: list[tuple[str, float, float]] = RATES) -> Column:
    """The same charges for one buy and one sale of a security on a day."""
    bought, sold = quantity * buy, quantity * sell
    turnover = bought + sold
    brokerage = F.least(bought * BROKERAGE, F.lit(CAP)) + F.least(sold * BROKERAGE, F.lit(CAP))
    shares = turnover * (_dated(day, rates, 1) + _dated(day, rates, 2) + REGULATOR)
    tax = F.round(F.round(quantity * F.round((buy + sell) / 2, 2) * TAX, 2), 0)
    return (brokerage + shares) * (1 + SERVICE) + bought * STAMP + tax


def attribution(fills: DataFrame, opens: DataFrame, account: str, fee: Column) -> DataFrame:
    """Of fills (signed, price) with the open of their bar: gross at opens, slippage, fees, notional, drag in basis points."""
    rows = fills.join(opens, ["symbol", "open_time"], "left").withColumn("fee", fee)
    signed, price, opening = F.col("signed"), F.col("price"), F.col("opening")
    out = rows.groupBy(account).agg(
        (-F.sum(signed * opening)).alias("gross"), F.sum(signed * (price - opening)).alias("slippage"), F.sum("fee").alias("fees"),
        F.sum(F.abs(signed) * price).alias("notional"), F.count_if(opening.isNull()).alias("unpriced"),
    )
    return out.withColumn("drag_bps", F.try_divide(F.col("fees") + F.col("slippage"), F.col("notional")) * 10_000)


def replayed(fills: DataFrame, account: str, bps: float, piece_rows: int = scan.PIECE_ROWS) -> DataFrame:
    """Every fill with the books after it: quantity, average, realised, cash, fees."""
    rows = progress(fills, account, piece_rows)
    value = F.col("signed") * F.col("price")
    sums = {"realised": F.col("gain"), "cash": -value, "fees": F.abs(value) * (bps / 10_000)}
    return scan.scanned(rows, [account], scan.by_rows(fills, "t", piece_rows), ["t", "event_id"], sums=sums).drop("gain")


def reconcile(replayed: DataFrame, recorded: DataFrame, keys: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """(keys, problem, expected, recorded) of two tables of checkpoints: the fields that differ by more than the tolerance or
    are unknown on one side, and ``not recorded`` or ``no replay`` where a checkpoint is on one side only."""
    side = lambda rows, name: rows.select(*[F.col(k).alias(f"{name}{k}") for k in keys], F.array(*[F.col(f).cast("double") for f in fields]).alias(name))
    both = side(replayed, "_e").join(side(recorded, "_r"), [F.col(f"_e{k}").eqNullSafe(F.col(f"_r{k}")) for k in keys], "full_outer")
    lost = F.when(F.col("_r").isNull(), "not recorded").when(F.col("_e").isNull(), "no replay")
    none = F.lit(None).cast("double")
    row = lambda problem, e, r: F.struct(problem.alias("problem"), e.alias("expected"), r.alias("recorded"))
    differs = lambda a, b: ~F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    each = F.array(*[F.when(differs(F.get("_e", i), F.get("_r", i)), row(F.lit(f), F.get("_e", i), F.get("_r", i))) for i, f in enumerate(fields)])
    found = F.when(lost.isNotNull(), F.array(row(lost, none, none))).otherwise(F.array_compact(each))
    return both.select(*[F.coalesce(f"_e{k}", f"_r{k}").alias(k) for k in keys], F.explode(found).alias("x")).select(*keys, "x.*")
