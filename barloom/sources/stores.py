"""Partitioned bar stores: writing, pruned reading, feature stores and exports."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ts import DAY

_STORES: dict[tuple[str, str, str], str] = {}


def year_of(t: str):
    return F.year(F.date_from_unix_date(F.floor(F.col(t) / DAY).cast("int")))


def write_bars(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partition by symbol and UTC year; rows of a partition are gathered first, so each gets few files."""
    rows = bars.withColumn("year", year_of("open_time"))
    rows.repartition("symbol", "year").sortWithinPartitions("symbol", "open_time").write.mode(mode).option("compression", "zstd").partitionBy("symbol", "year").parquet(path)


def load_bars(spark: SparkSession, path: str, symbols: list[str], start: int, end: int) -> DataFrame:
    """Bars of symbols in an inclusive time range; whole years are pruned by the partition column."""
    first, last = (int(str(x)[:4]) for x in (_utc(start), _utc(end)))
    return spark.read.parquet(path).where(F.col("symbol").isin(symbols) & F.col("year").between(first, last) & F.col("open_time").between(start, end))


def _utc(us: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(us // 1_000_000, UTC).isoformat()


def symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("symbol").distinct()


def statistics(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Rows and first and last time of a store, by partition columns if given, from the statistics that Parquet files keep:
    the aggregates by partition are pushed into the scan, which reads footers and no rows."""
    parts = _scan(spark, path).groupBy("symbol", "year").agg(F.count("*").alias("n"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    if keys == ("symbol", "year"):
        return parts
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """A reader that takes aggregates; Spark's default one for Parquet does not."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    old = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(old)
    spark.conf.set(old, ",".join(x for x in before.split(",") if x != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(old, before)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Rows, first and last time of every partition's files, by symbol and year; a store keeps few files in each."""
    return statistics(spark, path, "symbol", "year")


def write_features(frame: DataFrame, path: str) -> None:
    """Features with their masks; computed before they are partitioned, so no year edge restarts a window.

    Only the partitions that ``frame`` has rows for are replaced. A stored partition of one of its symbols that it no longer
    has rows for would go on serving old values, so then nothing is written and the partitions are named in the error.
    """
    from barloom.operators.features import with_masks

    rows = with_masks(frame).withColumn("year", year_of("open_time"))
    stale = _stale(rows.select("symbol", "year").distinct(), path)
    if stale:
        raise ValueError(f"partitions would be stale: {', '.join(stale)}")
    rows = rows.repartition("symbol", "year").sortWithinPartitions("symbol", "open_time").write.mode("overwrite")
    rows.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol", "year").parquet(path)


def _stale(produced: DataFrame, path: str, most: int = 20) -> list[str]:
    """Stored partitions (by name, ``most`` at most) of the symbols of ``produced`` that it lacks."""
    spark = produced.sparkSession
    try:
        present = spark.read.parquet(path).select("symbol", "year").distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return []
    produced = settle(produced)
    lost = present.join(produced.select("symbol").distinct(), "symbol", "left_semi").join(produced, ["symbol", "year"], "left_anti")
    return [f"{r['symbol']}/{r['year']}" for r in lost.orderBy("symbol", "year").limit(most).collect()]


def load_features(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(path).select("symbol", "open_time", *names, *[f"available__{n}" for n in names])


def load_range(spark: SparkSession, path: str, names: list[str], symbols: list[str], start: int, end: int) -> DataFrame:
    """Chosen features and masks of symbols in an inclusive time range, with whole years pruned."""
    keep = ["symbol", "open_time", *names, *[f"available__{n}" for n in names]]
    return load_bars(spark, path, symbols, start, end).select(*keep)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header in every part file; never over an existing folder."""
    rows.write.mode("errorifexists").option("header", True).csv(path)


def export_records(rows: DataFrame, path: str) -> None:
    """One JSON object a row; never over an existing folder."""
    rows.write.mode("errorifexists").json(path)


def write_once(rows: DataFrame, path: str) -> bool:
    """Write Parquet unless the folder exists; whether it was written."""
    try:
        rows.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        return False
    return True


def write_reports(root: str, **reports: DataFrame) -> None:
    """Every report as Parquet with its schema, also where it has no rows."""
    for name, rows in reports.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{name}")


def write_version(rows: DataFrame, root: str, version: int) -> None:
    rows.write.mode("errorifexists").parquet(f"{root}/version={version}")


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """A version of a report as it was written; other versions are not read."""
    return spark.read.parquet(root).where(F.col("version") == version).drop("version")


def shared_root(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that driver and executors share; an error where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root}/{kind}/{uuid.uuid4().hex}"


def listing(rows: DataFrame) -> str:
    """A digest of the names, sizes and times of the files behind ``rows``, by which a rewritten table is told apart."""
    m = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    found = rows.select(m.alias("f")).groupBy("f").count().agg(F.count("*"), F.sum(F.col("f").cast("decimal(38,0)"))).first()
    return f"{found[0]}-{found[1]}"


def settle(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again, so that several readers don't work them out again."""
    path = shared_root(rows.sparkSession, "settled")
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def session_store(spark: SparkSession, name: str, source: DataFrame, make, write=write_bars) -> str:
    """The path of a store written once per session, name and state of ``source``'s files to the folder that the cluster
    shares."""
    key = (spark.sparkContext.applicationId, name, listing(source))
    if key not in _STORES:
        path = shared_root(spark, "stores")
        write(make(), path)
        _STORES[key] = path
    return _STORES[key]
