"""Running sums, maxima, last known values and rows before over whole series, worked out over pieces of them.

A window over a whole series keeps the series in one task. Here every piece of a series is one window; what the pieces before
it hand on (their sums, maxima, last values) comes from one combinable aggregate a piece and a window over those aggregates,
of which a series has as many as it has pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ts import CHUNK

#: Pieces that ``cuts`` makes at most of one table, and the rows that a piece should hold.
MOST_PIECES, PIECE_ROWS = 512, 1_000_000


def by_time(step: int, bars: int = CHUNK, at: str = "open_time") -> Column:
    """The piece of a bar: a run of ``bars`` steps of the clock."""
    return F.expr(f"({at} - pmod({at}, {bars * step})) div {bars * step}")


def by_rows(rows: DataFrame, at: str, piece_rows: int = PIECE_ROWS) -> Column:
    """The piece of a row of irregular times: cut at quantiles of ``at`` over the table, so that bursts are cut finer. A key
    has at most a piece's share of the table in one piece, but for rows of one and the same time."""
    pieces = min(MOST_PIECES, rows.count() // piece_rows + 1)
    if pieces == 1:
        return F.lit(0)
    edges = rows.agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], 100 * pieces)).first()[0]
    edges = sorted(set(edges or []))

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(at) < edges[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(edges))


def scanned(rows: DataFrame, keys: list[str], piece: Column, order: list[str], *, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running columns in the order of ``order`` within ``keys``, each up to and with the row itself.

    ``sums`` adds known values (NULL until there is one), ``maxima`` is the largest known value (numbers or structs), ``lasts``
    the last known one, ``before`` the value of the row before, known or not (NULL at the first row). ``piece`` must never fall
    along ``order``. Keys may be NULL.
    """
    sums, maxima, lasts, before = sums or {}, maxima or {}, lasts or {}, before or {}
    place = F.struct(*order)
    names = [*sums, *maxima, *lasts, *before]
    named = {n: F.struct(c.alias("v")) for n, c in before.items()}
    cut = rows.withColumn("_piece", piece)
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    inner = {
        **{f"_i_{n}": F.sum(c).over(upto) for n, c in sums.items()},
        **{f"_i_{n}": F.max(c).over(upto) for n, c in maxima.items()},
        **{f"_i_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()},
        **{f"_i_{n}": F.lag(c).over(local) for n, c in named.items()},
    }
    whole = [
        *[F.sum(c).alias(f"_w_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_w_{n}") for n, c in maxima.items()],
        *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_w_{n}") for n, c in lasts.items()],
        *[F.max_by(c, place).alias(f"_w_{n}") for n, c in named.items()],
    ]
    pieces = Window.partitionBy(*keys).orderBy("_piece")
    past = pieces.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        **{n: F.sum(f"_w_{n}").over(past) for n in sums},
        **{n: F.max(f"_w_{n}").over(past) for n in maxima},
        **{n: F.last(f"_w_{n}", ignorenulls=True).over(past) for n in lasts},
        **{n: F.lag(f"_w_{n}").over(pieces) for n in before},
    }
    carry = cut.groupBy(*keys, "_piece").agg(*whole).select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_piece"]], *[c.alias(f"_c_{n}") for n, c in carried.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_piece") == F.col("_k__piece")]
    both = cut.withColumns(inner).join(carry, same, "left")
    at = lambda n: (F.col(f"_i_{n}"), F.col(f"_c_{n}"))
    out = {}
    for n in sums:
        i, c = at(n)
        out[n] = F.coalesce(c + i, i, c)
    for n in maxima:
        i, c = at(n)
        out[n] = F.when(c.isNull() | (i >= c), i).otherwise(c)
    for n in lasts:
        out[n] = F.coalesce(*at(n))
    for n in before:
        out[n] = F.coalesce(*at(n))["v"]
    return both.select(*[c for c in rows.columns if c not in names], *[c.alias(n) for n, c in out.items()])
