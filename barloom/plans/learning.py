"""Model queries (M-*): samples from the tables, fits on TRAIN, reports on VALID."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import ts
from barloom.operators import calibrate, features, ml
from barloom.plans.base import HOUR, bars, query, r, sql, table
from barloom.plans.returns import BPS, bps

SPLITS = [("train", 1704067200000000, 1705276800000000), ("valid", 1705276800000000, 1706140800000000), ("test", 1706140800000000, 1706659200000000)]
NAMES = ["return_1", "taker_ratio", "hour_sin", "hour_cos", "trade_size"]


def _samples(spark, sf_dir):
    b = bars(spark, sf_dir, HOUR)
    return ml.samples(features.build(b, HOUR, NAMES), b, NAMES, 1, HOUR, SPLITS)


_W = "(PARTITION BY symbol ORDER BY open_time)"
_LABELLED = f"SELECT *, CASE WHEN lead(open_time) OVER {_W} - open_time = {HOUR} THEN lead(close) OVER {_W} / close - 1 END AS target, CASE WHEN open_time - lag(open_time) OVER {_W} = {HOUR} THEN ln(close / lag(close) OVER {_W}) END AS return_1, taker_buy_base / volume AS p FROM h"
_SPLITS = "CASE WHEN open_time >= 1704067200000000 AND open_time < 1705276800000000 THEN 'train' WHEN open_time >= 1705276800000000 AND open_time < 1706140800000000 THEN 'valid' WHEN open_time >= 1706140800000000 AND open_time < 1706659200000000 THEN 'test' END"
_ENDS = "CASE split WHEN 'train' THEN 1705276800000000 WHEN 'valid' THEN 1706140800000000 WHEN 'test' THEN 1706659200000000 END"
_INPUTS = {
    "return_1": "return_1", "taker_ratio": "CASE WHEN volume > 0 THEN taker_buy_base / volume END", "hour_sin": f"sin((open_time % 86400000000 // {HOUR}) * 2 * pi() / 24)",
    "hour_cos": f"cos((open_time % 86400000000 // {HOUR}) * 2 * pi() / 24)", "trade_size": "CASE WHEN trades > 0 THEN quote_volume / trades END",
}
_N = len(NAMES)
#: Ridge regression in SQL: normal equations of standardised features, solved by elimination on a list of lists.
_RIDGE = dict(
    l=_LABELLED,
    f0=f"SELECT symbol, open_time, target, {', '.join(f'{v} AS x{i}' for i, v in enumerate(_INPUTS.values(), 1))}, {_SPLITS} AS split FROM l",
    f=f"SELECT * FROM f0 WHERE target IS NOT NULL AND {' AND '.join(f'x{i} IS NOT NULL' for i in range(1, _N + 1))} AND open_time + {HOUR} < {_ENDS}",
    st=f"SELECT avg(target) AS ym, {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}' for i in range(1, _N + 1))} FROM f WHERE split = 'train'",
    z=f"SELECT symbol, split, target, ym, {', '.join(f'(x{i} - m{i}) / coalesce(nullif(s{i}, 0), 1) AS z{i}' for i in range(1, _N + 1))} FROM f CROSS JOIN st",
    ne=f"SELECT [{', '.join('[' + ', '.join([f'sum(z{i} * z{j}) + {1.0 if i == j else 0.0}' for j in range(1, _N + 1)] + [f'sum(z{i} * (target - ym))']) + ']' for i in range(1, _N + 1))}] AS m FROM z WHERE split = 'train'",
    el=f"""SELECT 1 AS k, m FROM ne UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / m[k][k]) ELSE list_transform(row, lambda v, j: v - row[k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= {_N}""",
    w=f"SELECT list_transform(m, lambda row: row[{_N + 1}]) AS w FROM el WHERE k = {_N + 1}",
    e=f"SELECT symbol, target - ym - ({' + '.join(f'w[{i}] * z{i}' for i in range(1, _N + 1))}) AS e FROM z CROSS JOIN w WHERE split = 'valid'",
)


@query("M-01", sql("SELECT symbol, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY symbol", **_RIDGE).replace("WITH ticks", "WITH RECURSIVE ticks", 1))
def ridge(spark, sf_dir):
    rows = ml.standardised(_samples(spark, sf_dir), NAMES)
    scored = ml.ridge(rows.where("split = 'train'"), 1.0).transform(rows.where("split = 'valid'"))
    e = F.col("target") - F.col("prediction")
    return scored.groupBy("symbol").agg(F.count("*").alias("n"), r(F.avg(F.abs(e)), "mae"), r(F.sqrt(F.avg(e * e)), "rmse"))


@query("M-02", None)
def logistic(spark, sf_dir):
    rows = ml.standardised(_samples(spark, sf_dir), NAMES)
    scored = ml.probabilities(ml.logistic(rows.where("split = 'train'"), 1.0), rows.where("split = 'valid'"))
    return scored.groupBy("symbol").agg(F.count("*").alias("n"), r(F.avg(((F.col("p") > 0.5) == (F.col("target") > 0)).cast("int")), "accuracy"))


@query("M-03", None)
def boosted(spark, sf_dir):
    rows = ml.standardised(_samples(spark, sf_dir), NAMES)
    scored = ml.probabilities(ml.boosted(rows), rows.where("split = 'valid'"))
    return scored.groupBy("symbol").agg(F.count("*").alias("n"), r(F.avg(((F.col("p") > 0.5) == (F.col("target") > 0)).cast("int")), "accuracy"))


@query(
    "M-05",
    sql(
        """SELECT symbol, count(*) AS n, round(avg(CASE WHEN lo.x IS NULL THEN (SELECT min(g) FROM fit) WHEN hi.x IS NULL THEN (SELECT max(g) FROM fit) WHEN hi.x = lo.x THEN lo.g ELSE lo.g + (hi.g - lo.g) * (p - lo.x) / (hi.x - lo.x) END), 5) + 0.0 AS mean
        FROM s ASOF LEFT JOIN fit lo ON s.p >= lo.x ASOF LEFT JOIN fit hi ON s.p <= hi.x WHERE open_time >= 1706140800000000 AND open_time + 3600000000 < 1706659200000000 GROUP BY symbol""",
        l=_LABELLED,
        s="SELECT * FROM l WHERE target IS NOT NULL AND p IS NOT NULL",
        v="SELECT p AS x, count(*)::DOUBLE AS w, sum((target > 0)::INT)::DOUBLE AS y FROM s WHERE open_time >= 1705276800000000 AND open_time + 3600000000 < 1706140800000000 GROUP BY p",
        c="SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(y) OVER (ORDER BY x) AS cy, w, y FROM v",
        # isotonic regression: the largest, over where a block may begin, of the least mean of a block that ends here or later
        m="SELECT a.i AS a, b.i AS b, min((b.cy - a.cy + a.y) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM c a JOIN c b ON a.i <= b.i",
        fit="SELECT x, max(least) AS g FROM m JOIN c ON c.i = m.b GROUP BY x",
    ),
)
def calibrated(spark, sf_dir):
    """Taker shares as probabilities of a rise: made monotone on VALID alone and used once it is over, on TEST."""
    b = bars(spark, sf_dir, HOUR)
    shares = b.select("symbol", "open_time", ts.ratio(F.col("taker_buy_base"), F.col("volume")).alias("p"))
    rows = ml.samples(shares, b, ["p"], 1, HOUR, SPLITS)
    out = ml.calibrated(rows.where("split = 'valid'"), rows.where("split = 'test'"))
    return out.groupBy("symbol").agg(F.count("*").alias("n"), (F.round(F.avg("calibrated"), 5) + 0.0).alias("mean"))




@query(
    "J-15",
    sql(
        f"SELECT symbol, count(*) AS n, count(*) FILTER (y IS NULL) AS no_label, count(*) FILTER (f IS NULL) AS no_feature, count(*) FILTER (y IS NOT NULL AND f IS NOT NULL) AS kept FROM (SELECT symbol, CASE WHEN lead(open_time) OVER {_W} - open_time = {HOUR} THEN 1 END AS y, CASE WHEN open_time - lag(open_time) OVER {_W} = {HOUR} THEN 1 END AS f FROM h) GROUP BY symbol"
    ),
)
def dataset_counts(spark, sf_dir):
    rows = bars(spark, sf_dir, HOUR).select("symbol", ts.forward_return(F.col("close"), 1, HOUR).alias("y"), ts.log_return(F.col("close"), 1, HOUR).alias("f"))
    none = lambda c: F.col(c).isNull()
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(none("y")).alias("no_label"), F.count_if(none("f")).alias("no_feature"), F.count_if(~none("y") & ~none("f")).alias("kept"))


@query(
    "M-09",
    sql(
        f"""SELECT symbol, split, count(*) AS n, round(avg((y > 0)::INT), 6) AS positive FROM (SELECT symbol, open_time, {_SPLITS} AS split, CASE WHEN lead(open_time) OVER {_W} - open_time = {HOUR} THEN lead(close) OVER {_W} / close - 1 END AS y,
          CASE WHEN open_time - lag(open_time) OVER {_W} = {HOUR} THEN 1 END AS f FROM h) WHERE split IS NOT NULL AND y IS NOT NULL AND f IS NOT NULL AND open_time + {HOUR} < {_ENDS} GROUP BY ALL"""
    ),
)
def coverage(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    return rows.groupBy("symbol", "split").agg(F.count("*").alias("n"), r(F.avg((F.col("target") > 0).cast("int")), "positive"))


@query(
    "F-17",
    """WITH b AS (SELECT l_discount AS d, avg(l_discount * 10) AS x, avg((l_returnflag = 'R')::INT) AS y FROM lineitem GROUP BY ALL),
      k AS (SELECT x AS x0, y0, lead(x) OVER (ORDER BY x) AS x1, lead(y0) OVER (ORDER BY x) AS y1 FROM (SELECT x, max(y) OVER (ORDER BY x) AS y0 FROM b)),
      q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax * 15 - 0.1 AS p FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN x0 IS NULL THEN (SELECT min(y0) FROM k) WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END, 6) AS value FROM q ASOF LEFT JOIN k ON q.p >= k.x0""",
)
def calibrated_values(spark, sf_dir):
    """A rising map of return rates by discount, read at other points, below and above its ends too."""
    rows = table(spark, sf_dir, "lineitem")
    points = calibrate.monotone_points(rows.select("l_discount", (F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y")), F.col("l_discount"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", r(calibrate.interpolate(F.col("l_tax") * 15 - 0.1, points), "value"))


#: The policy of the edge signal: its calibration map, rows of the score and when it was fitted.
POINTS, WINDOW, READY = [(0.1, 0.3), (0.5, 0.5), (0.9, 0.7)], 12, 1705276800000000


@query(
    "M-06",
    sql(
        f"""SELECT symbol, open_time, round(net, 4) + 0.0 AS net, round(CASE WHEN usable AND open_time + {HOUR} >= {READY} THEN CASE WHEN net = 0 OR sign(v) <> sign(net) THEN 0 ELSE v END END, 5) + 0.0 AS alpha FROM
        (SELECT *, least(greatest(score, -1), 1) AS v, score IS NOT NULL AND coalesce(open_time - lag(open_time, {WINDOW - 1}) OVER {_W} = {(WINDOW - 1) * HOUR}, false) AS usable FROM
          (SELECT *, CASE WHEN count(net) OVER z = {WINDOW} AND stddev_samp(net) OVER z > 0 THEN (net - avg(net) OVER z) / stddev_samp(net) OVER z END AS score FROM n WINDOW z AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)))""",
        f0=f"SELECT symbol, open_time, taker_buy_base / volume AS p, CASE WHEN lead(open_time) OVER {_W} - open_time = {HOUR} THEN lead(close) OVER {_W} / close - 1 END AS y FROM h",
        pay=f"SELECT symbol, avg(y) FILTER (y > 0) * 10000 AS up, avg(y) FILTER (y <= 0) * 10000 AS down FROM f0 WHERE open_time < {READY} GROUP BY symbol",
        c=f"SELECT *, CASE WHEN p <= 0.1 THEN 0.3 WHEN p >= 0.9 THEN 0.7 ELSE 0.3 + (p - 0.1) * 0.5 END AS q, 2 * CASE symbol {' '.join(f"WHEN '{k}' THEN {v}" for k, v in BPS.items())} END AS cost FROM f0 JOIN pay USING (symbol)",
        n="SELECT symbol, open_time, sign(q * up + (1 - q) * down) * greatest(abs(q * up + (1 - q) * down) - cost, 0) AS net FROM c",
    ),
)
def edge_signal(spark, sf_dir):
    """Taker shares as probabilities: calibrated, turned into an edge by TRAIN payoffs, less costs, scored and bounded."""
    rows = bars(spark, sf_dir, HOUR)
    rows = rows.select("symbol", "open_time", ts.ratio(F.col("taker_buy_base"), F.col("volume")).alias("p"), ts.forward_return(F.col("close"), 1, HOUR).alias("y"))
    paid = calibrate.payoffs(rows.where(F.col("open_time") < READY), "y")
    out = calibrate.edge_signal(rows, paid, POINTS, 2 * bps(), HOUR, WINDOW, READY)
    return out.select("symbol", "open_time", (F.round("net", 4) + 0.0).alias("net"), (F.round("alpha", 5) + 0.0).alias("alpha"))


@query("M-04", None)
def book_classes(spark, sf_dir):
    """Classes of labelled vectors by a multinomial logistic fit and a small network, over two seeds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").where("label is not null")
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    kinds = [x[0] for x in rows.select("label").distinct().orderBy("label").collect()]  # the label domain
    index = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("label")).cast("double") - 1
    split = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    ready = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"), index.alias("label"), split.alias("split"))
    ready = VectorAssembler(inputCols=["v"], outputCol="x").transform(ready)
    out = ml.classes(ready, [1, 2], [size, 8, len(kinds)])
    return out.select("model", "seed", "n", r("accuracy", "accuracy"), r("macro_f1", "macro_f1"))


@query("M-07", None)
def expected_return(spark, sf_dir):
    """Boosted direction, isotonic return on VALID, hurdle: the signal of TEST rows, by symbol."""
    rows = ml.standardised(_samples(spark, sf_dir), NAMES)
    scored = ml.probabilities(ml.boosted(rows, 5, 2), rows.where("split <> 'train'"))
    out = ml.isotonic_return(scored.where("split = 'valid'"), scored.where("split = 'test'"))
    alpha = ml.hurdle(F.col("expected"), 0.001, 0.05)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(alpha > 0).alias("active"), r(F.avg(alpha), "mean"), r(F.max(alpha), "most"))


@query("M-08", None)
def horizon_screen(spark, sf_dir):
    """Returns over three exits, each with a regression, a monotone map and a cost screen."""
    b = bars(spark, sf_dir, HOUR)
    made = features.build(b, HOUR, NAMES)
    rows = None
    for h in (1, 2, 4):
        part = ml.samples(made, b, NAMES, h, HOUR, SPLITS).withColumn("horizon", F.lit(h))
        rows = part if rows is None else rows.unionByName(part)
    out = ml.horizon_screen(ml.standardised(rows, NAMES), 0.001)
    return out.select("horizon", "n", "active", r("net_1x", "net_1x"), r("net_2x", "net_2x"))


@query(
    "M-10",
    sql(
        """SELECT a.symbol, count(*) AS n, round(coalesce(covar_pop(return_1, b.target) / nullif(stddev_pop(return_1) * stddev_pop(b.target), 0), 0), 6) + 0.0 AS corr
        FROM a JOIN b ON a.symbol = b.symbol AND a.i = b.i GROUP BY a.symbol""",
        l=_LABELLED,
        s="SELECT * FROM l WHERE target IS NOT NULL AND return_1 IS NOT NULL AND open_time >= 1705276800000000 AND open_time + 3600000000 < 1706140800000000",
        a=f"SELECT symbol, return_1, row_number() OVER (PARTITION BY symbol ORDER BY open_time // 1000000 * {ml.factor(3)} % {2**31}, open_time) AS i FROM s",
        b=f"SELECT symbol, target, row_number() OVER (PARTITION BY symbol ORDER BY open_time // 1000000 * {ml.factor(4)} % {2**31}, open_time) AS i FROM s",
    ),
)
def shuffled_control(spark, sf_dir):
    """Targets dealt anew within each symbol: what a feature then says of them."""
    mixed = ml.shuffled(_samples(spark, sf_dir).where("split = 'valid'"), 3)
    return mixed.groupBy("symbol").agg(F.count("*").alias("n"), r(F.coalesce(F.try_divide(F.covar_pop("return_1", "target"), F.stddev_pop("return_1") * F.stddev_pop("target")), F.lit(0.0)), "corr"))
