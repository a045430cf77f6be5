"""Raw files and nested documents to rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.schema import KLINE


_KLINE_DDL = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in KLINE.fields)


def _only_member(path: str, content: bytes):
    """The one file in a zip, open for reading."""
    z = zipfile.ZipFile(io.BytesIO(content))
    if len(z.namelist()) != 1:
        raise ValueError(f"{path} must hold one file, not {len(z.namelist())}")
    return z.open(z.namelist()[0])


def parse_zipped_klines(files: DataFrame) -> DataFrame:
    """Rows of header-less 12-column CSV members of zip files (path, content), with the file's name.

    A file that holds no or several members, no rows, or other types fails the job. One file is in memory at a time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {f.name: "int64" if f.dataType.simpleString() == "bigint" else "float64" for f in KLINE.fields}
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = pd.read_csv(_only_member(path, content), header=None, names=list(kinds), dtype=kinds, float_precision="round_trip")
                if rows.empty:
                    raise ValueError(f"{path} is empty")
                yield rows.assign(file=path.rsplit("/", 1)[-1], line=range(len(rows)))

    return files.select("path", "content").mapInPandas(run, _KLINE_DDL + ", file string, line long")


def read_zipped_klines(spark: SparkSession, glob: str) -> DataFrame:
    """``parse_zipped_klines`` of all zip files below a path, spread over tasks by Spark's binary reader."""
    return parse_zipped_klines(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(glob))


def pack_klines(rows: DataFrame, interval: str) -> DataFrame:
    """The inverse: one zip file (path, content) for each symbol and month of rows with ``symbol``, ``month``, the
    twelve columns and ``seq``, the order of lines."""
    names = [f.name for f in KLINE.fields]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        name = f"{key[0]}-{interval}-{key[1]}"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{name}.csv", part.sort_values("seq")[names].to_csv(index=False, header=False))
        return pd.DataFrame({"path": [f"{name}.zip"], "content": [out.getvalue()]})

    return rows.groupBy("symbol", "month").applyInPandas(run, "path string, content binary")


def history(files: DataFrame) -> DataFrame:
    """All months of all symbols as one table: symbol and month come from the file's name."""
    name = F.regexp_extract("file", r"^(.+)-([^-]+)-(\d{4}-\d{2})\.zip$", 1)
    month = F.regexp_extract("file", r"(\d{4}-\d{2})\.zip$", 1)
    return parse_zipped_klines(files).select(name.alias("symbol"), month.alias("month"), *[f.name for f in KLINE.fields], "file", "line")


#: Columns that an end-of-day file must have.
EOD = ["day", "symbol", "isin", "series", "high", "low", "close", "volume"]


def pack_eod(rows: DataFrame) -> DataFrame:
    """One zipped CSV file with a header for each day."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"eod-{key[0]}.csv", part[EOD].to_csv(index=False))
        return pd.DataFrame({"path": [f"eod-{key[0]}.zip"], "content": [out.getvalue()]})

    return rows.groupBy("day").applyInPandas(run, "path string, content binary")


def parse_eod(files: DataFrame, series: str = "EQ") -> DataFrame:
    """Rows of one series of zipped end-of-day files; a file without a required column fails the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = pd.read_csv(_only_member(path, content), dtype={c: "str" for c in EOD[:4]})
                if lost := [c for c in EOD if c not in rows.columns]:
                    raise ValueError(f"{path} lacks {', '.join(lost)}")
                yield rows[EOD].astype(dict.fromkeys(EOD[4:], "float64"))

    kinds = ", ".join(f"{c} {'string' if i < 4 else 'double'}" for i, c in enumerate(EOD))
    return files.select("path", "content").mapInPandas(run, kinds).where(F.col("series") == series)


def parse_events(docs: DataFrame, body: str, first: str, last: str) -> DataFrame:
    """Corporate events of a JSON list inside a window of days: symbol, day, kind (dividend or other), subject."""
    rows = docs.select(F.explode(F.from_json(body, "array<struct<symbol: string, subject: string, exDate: string>>")).alias("e"))
    rows = rows.select("e.symbol", F.try_to_date("e.exDate", "dd-MMM-yyyy").alias("day"), "e.subject")
    kind = F.when(F.lower("subject").contains("dividend"), "dividend").otherwise("other")
    return rows.where(F.col("day").between(first, last)).withColumn("kind", kind)


def check_roster(rows: DataFrame, expected: int) -> DataFrame:
    """One row on a constituent list (symbol, isin): count, bad patterns, repeated values and whether all is well."""
    bad = rows.agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce(F.col("symbol").rlike("^[A-Z0-9&-]{1,20}$"), F.lit(False))).alias("bad_symbol"),
        F.count_if(~F.coalesce(F.col("isin").rlike("^IN[A-Z0-9]{9}[0-9]$"), F.lit(False))).alias("bad_isin"),
        (F.count("symbol") - F.count_distinct("symbol")).alias("repeated_symbol"),
        (F.count("isin") - F.count_distinct("isin")).alias("repeated_isin"),
    )
    faults = F.col("bad_symbol") + F.col("bad_isin") + F.col("repeated_symbol") + F.col("repeated_isin")
    return bad.withColumn("passed", (F.col("n") == expected) & (faults == 0))


def first_share(rows: DataFrame, file: str, position: str, share: float) -> DataFrame:
    """``rows`` with ``part``: first for the leading share of the ordered concatenation of files, else last.

    A row's place is its position in its file after the rows of the files before, so only one count a file is summed.
    """
    sizes = rows.groupBy(file).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.select(file, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    cut = F.floor(F.col("_total") * share)
    part = F.when(F.col("_before") + F.col(position) < cut, "first").otherwise("last")
    return rows.join(placed, file).withColumn("part", part).drop("_before", "_total")


def parse_candles(docs: DataFrame, body: str) -> DataFrame:
    """Array-of-arrays candles (time, open, high, low, close, volume as text) to rows; what is no number is unknown."""
    kept = [c for c in docs.columns if c != body]
    rows = docs.select(*kept, F.explode(F.from_json(body, "array<array<string>>")).alias("c"))
    number = lambda i: F.get("c", i).try_cast("double")
    return rows.select(*kept, F.get("c", 0).try_cast("long").alias("open_time"), *[number(i).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)])


def parse_exchange_info(docs: DataFrame, body: str) -> DataFrame:
    """Instruments with the tick and step of their filters."""
    kind = "symbols array<struct<symbol: string, filters: array<struct<filterType: string, tickSize: string, stepSize: string>>>>"
    one = docs.select(F.explode(F.from_json(body, kind)["symbols"]).alias("s"))
    pick = lambda name: F.get(F.filter("s.filters", lambda f: f["filterType"] == name), 0)
    return one.select("s.symbol", pick("PRICE_FILTER")["tickSize"].alias("tick"), pick("LOT_SIZE")["stepSize"].alias("step"))


def parse_chart(docs: DataFrame, body: str) -> DataFrame:
    """Parallel-array chart documents to rows with the reason why a row can't be used, or none."""
    kind = "t array<long>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>"
    j = docs.withColumn("_j", F.from_json(body, kind))
    rows = j.select(*[c for c in docs.columns if c != body], F.explode(F.arrays_zip(*[F.col(f"_j.{x}").alias(x) for x in "tohlcv"])).alias("b")).select("*", "b.*").drop("b")
    missing = F.greatest(*[F.col(x).isNull().cast("int") for x in "tohlcv"]) == 1
    return rows.withColumn("reject_reason", F.when(missing, "missing value").when(F.col("v") < 0, "negative volume").when((F.col("l") > F.least("o", "c")) | (F.col("h") < F.greatest("o", "c")), "inconsistent prices"))


def text_matrix(rows: DataFrame, block: str, event: str, values) -> DataFrame:
    """A text matrix for each block of events: (block, row, line), a line being one value of every event, the first line
    the events' numbers."""
    cells = rows.select(block, F.col(event).alias("_e"), F.posexplode(F.concat(F.array(F.col(event).cast("double")), values)).alias("row", "x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_e", "x"))), lambda c: c["x"].cast("string"))
    return cells.groupBy(block, "row").agg(F.array_join(ordered, " ").alias("line"))


def matrix_events(lines: DataFrame, block: str) -> DataFrame:
    """One row an event of text matrices (block, row, line): the event's number and its values in row order."""
    cells = lines.select(block, "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("column", "text"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("row", F.col("text").try_cast("double").alias("x")))), lambda c: c["x"])
    each = cells.groupBy(block, "column").agg(values.alias("v"))
    return each.select(F.col("v")[0].cast("long").alias("event"), F.expr("slice(v, 2, size(v) - 1)").alias("values"))
