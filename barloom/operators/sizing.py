"""From a bounded signal to a target and the whole shares to trade, in decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,18)"


def _down(x: Column, places: int) -> Column:
    """Cut off behind so many places, towards zero."""
    return F.when(x < 0, F.ceil(x, F.lit(places))).otherwise(F.floor(x, F.lit(places)))


def target_notional(signal: Column, capital: float, weight: float) -> Column:
    """Capital times weight times the signal (read as its shortest decimal); unknown where the signal is."""
    exact = signal.cast("string").cast("decimal(38,24)")
    return _down(F.lit(str(capital)).cast("decimal(18,4)") * F.lit(str(weight)).cast("decimal(10,6)") * exact, 18).cast(MONEY)


def rebalance(target: Column, price: Column, held: Column, capital: float, threshold: float, lot: int = 1) -> Column:
    """Signed shares, in whole lots, from ``held`` towards the target; 0 where the change is worth less than the threshold's
    share of the capital."""
    price, held = price.cast("string").cast("decimal(20,10)"), held.cast("decimal(20,6)")
    change = target.cast("decimal(30,12)") / price - held
    worth = F.abs(change).cast("double") * price.cast("double")
    lots = F.floor(F.abs(change) / lot) * lot
    return F.when(worth < capital * threshold, F.lit(0)).otherwise(F.signum(change) * lots)
