"""WARC fixity audit (operator 7) with Merkle trees.

Pages become WARC records with an id, a byte length and an offset in their archive; an archive holds the records of
``FANOUT ** LEVELS`` consecutive ids, so no archive grows with the corpus. The leaf of a record hashes its bytes' SHA-256
and its range of offsets: its length and the gap between it and the record before. A node hashes its children's keys and
digests in order, so every range of offsets is covered by the nodes above it; and since a range is hashed against the record
before, not against the archive's begin, a lost or longer record changes its own branch only. An audit joins the roots of two
replicas, then only the children of nodes that differ, level by level, down to records.

Everything is DataFrame operations; leaves and each level of the tree (a sixteenth of the one below) are written once per
replica to the shared folder.

Defined results: a null url or html counts as empty; a record without an id goes by a hash of its content; identical
records under one id are one leaf that counts its copies; different records under one id are ordered by digest and hashed
in groups of their digests' first digits, so an id may hold any number; an empty replica makes every record of the other one
missing or extra, two empty ones give no findings; a record of any length is hashed whole; columns other than those named
are not read, so their names don't matter. A record both altered and displaced is ``changed``; after a hole in the archive
the next record is ``moved``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialize

FANOUT, LEVELS = 16, 3


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC 1.0 resource record as binary."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaves(records: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(archive, id, offset, gap, length, copies, digest) of records (id, record binary and, if any, padding: the bytes that
    stand before the record)."""
    padding = F.coalesce(F.col("padding").cast("long"), F.lit(0)) if "padding" in records.columns else F.lit(0).cast("long")
    one = records.select(
        F.coalesce(F.col("id").cast("long"), F.xxhash64("record")).alias("id"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), padding.alias("gap")
    )
    one = one.groupBy("id", "digest", "length").agg(F.count("*").alias("copies"), F.sum("gap").alias("gap")).withColumn("archive", _floor_div("id", fanout**levels))
    upto = Window.partitionBy("archive").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("length") * F.col("copies")
    return one.withColumn("offset", F.sum(size + F.col("gap")).over(upto) - size)


def _floor_div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by} - if({column} % {by} < 0, 1, 0)")


def tree(leaf_rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Levels from records (key = id, with ``content``, the digest without the gaps) to archives: (key, parent, begin, end, digest)."""
    own, content = F.struct("digest", "copies", "length", "gap"), F.struct("digest", "copies", "length")
    sealed = lambda rows: F.sha2(F.to_json(F.array_sort(F.collect_list(rows))), 256)
    ends = (F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length") * F.col("copies")).alias("end"))
    parts = leaf_rows.groupBy("id", F.substring("digest", 1, 3).alias("part")).agg(*ends, sealed(own).alias("digest"), sealed(content).alias("content"))
    rows = parts.groupBy(F.col("id").alias("key")).agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), sealed(F.struct("part", "digest")).alias("digest"), sealed(F.struct("part", "content")).alias("content")
    )
    out = [materialize(rows.withColumn("parent", _floor_div("key", fanout)))]
    for _ in range(levels):
        rows = out[-1].groupBy(F.col("parent").alias("key")).agg(
            F.min("begin").alias("begin"), F.max("end").alias("end"), sealed(F.struct("key", "digest")).alias("digest"), F.lit(None).cast("string").alias("content")
        )
        out.append(materialize(rows.withColumn("parent", _floor_div("key", fanout))))
    return out


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Records that differ between two replicas' leaf tables: (archive, id, status, begin, end), with the left replica's
    range of offsets (the right one's where only it has the record); status is changed, moved (the same bytes after another gap),
    missing (right lacks it) or extra."""
    a, b = tree(left, fanout, levels), tree(right, fanout, levels)
    suspects = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if suspects is not None:  # descend below differing nodes only
            x, y = (side.join(suspects, side.parent == suspects.suspect, "left_semi") for side in (x, y))
        x, y = x.alias("x"), y.alias("y")
        pairs = x.join(y, F.col("x.key") == F.col("y.key"), "full_outer").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
        pairs = pairs.select(
            F.coalesce("x.key", "y.key").alias("suspect"),
            F.when(F.col("y.key").isNull(), "missing").when(F.col("x.key").isNull(), "extra").when(F.col("x.content") == F.col("y.content"), "moved").otherwise("changed").alias("status"),
            F.coalesce("x.begin", "y.begin").alias("begin"),
            F.coalesce("x.end", "y.end").alias("end"),
        )
        suspects = pairs.select("suspect")
    return pairs.select(_floor_div("suspect", fanout**levels).alias("archive"), F.col("suspect").alias("id"), "status", "begin", "end")


def records(pages: DataFrame) -> DataFrame:
    extra = ["padding"] if "padding" in pages.columns else []
    return pages.select(F.col("page_id").alias("id"), record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"), *extra)


#: The registered query's replica: what its copy of the archive has suffered, by fixed rules on page_id.
CHANGED, MISSING, MOVED, PADDING = (101, 7), (211, 5), (307, 11), 5000


def page_audit(pages: DataFrame) -> DataFrame:
    """The query: audits a replica of all pages in which some records have a byte more, some are lost and some are displaced."""
    pages = pages.select("page_id", "url", "html")
    damaged = pages.where(F.coalesce(F.col("page_id") % MISSING[0] != MISSING[1], F.lit(True))).withColumn(
        "html", F.when(F.col("page_id") % CHANGED[0] == CHANGED[1], F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))
    )
    padding = F.when(F.col("page_id") % MOVED[0] == MOVED[1], PADDING).otherwise(0)
    return audit(materialize(leaves(records(pages))), materialize(leaves(records(damaged.withColumn("padding", padding)))))


ORACLE = f"""
WITH sized AS (
  SELECT page_id AS id, page_id // {FANOUT**LEVELS} AS archive,
    strlen('WARC/1.0WARC-Type: resourceWARC-Record-ID: <urn:page:') + strlen(page_id::VARCHAR) + strlen('>WARC-Target-URI: ') + strlen(coalesce(url, ''))
    + strlen('Content-Type: text/htmlContent-Length: ') + strlen(strlen(coalesce(html, ''))::VARCHAR) + strlen(coalesce(html, '')) + 18 AS length
  FROM pages),
placed AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "begin" FROM sized)
SELECT archive, id, CASE WHEN id % {MISSING[0]} = {MISSING[1]} THEN 'missing' WHEN id % {CHANGED[0]} = {CHANGED[1]} THEN 'changed' ELSE 'moved' END AS status, "begin", ("begin" + length)::BIGINT AS "end"
FROM placed WHERE id % {MISSING[0]} = {MISSING[1]} OR id % {CHANGED[0]} = {CHANGED[1]} OR id % {MOVED[0]} = {MOVED[1]}
"""
