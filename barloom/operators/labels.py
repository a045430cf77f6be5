"""Labels of series from their metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a source name and the market that they stand for, in order of precedence.
MARKETS = [("nse", "nse_cash"), ("binance", "binance_spot"), ("bybit", "bybit_spot")]


def market(source: Column, synthetic: Column, declared: Column) -> Column:
    """The market of a series: synthetic by flag or name, else by the source's name, else as declared."""
    name = F.coalesce(F.lower(source), F.lit(""))
    label = F.coalesce(declared, F.lit("Unspecified"))
    for token, market_name in reversed(MARKETS):
        label = F.when(name.contains(token), market_name).otherwise(label)
    return F.when(F.coalesce(synthetic, F.lit(False)) | name.contains("synthetic"), "synthetic").otherwise(label)
