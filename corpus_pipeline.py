"""Training-corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet to the
shared folder and reads it again for the next one. All stages but the last return the columns of ``documents``, whatever
further columns their input has; an empty table goes through all of them. Rows with a null or repeated doc_id are documents of
their own everywhere; the doc_id decides only which of several is the first. Nulls in lang, source and n_chars don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, langid, lines, simhash
from barloom.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language ID rejects texts without a letter and those whose language is less likely than not.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told (``und``, null, empty and letterless texts, or a score under one half).
    Repeated rows are judged alike."""
    model = langid.fit_sample(docs, F.col("doc_id"))
    judged = langid.classify(docs.select(*COLUMNS), model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The columns and ``row``, a number of each row's own, written out so that it stays; ids may be null or repeated."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines, exact and fuzzy; documents left without a word go; n_chars follows the text. Each row is a
    document of its own; those with one doc_id are ordered by their numbers. A null or blank text stays if nothing was cut."""
    rows = numbered(docs).select(*COLUMNS, F.struct("doc_id", "row").alias("place"))
    out = lines.dedup(rows, key="place").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(r"\S"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: the one with the smallest doc_id (null before all), then row number. Null,
    empty and wordless texts have the zero fingerprint and form one component."""
    rows = numbered(docs)
    found = simhash.near_duplicates(rows.select("row", "text"), key="row").join(rows.select("row", "doc_id"), "row")
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within its edit budget; a null or empty text holds none."""
    found = decontaminate.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text left, with digests of the ids and of the bytes that they decode to; a null text counts as empty."""
    wanted = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return bpe.round_trip(docs.select("doc_id", "text"), wanted=wanted).select("doc_id", *wanted)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", encode),
]
#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
