"""Helpers shared by the operators: tables, durable intermediates, Arrow chunks, word bounds, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are ordered: nulls come before every id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Where none is set, an own one in local mode,
    whose tasks run on the driver's machine, and an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample(rows: DataFrame, key: Column, most: int, seed: int = 11) -> DataFrame:
    """About ``most`` rows (all, if no more), those with the least hashes of ``key``; never above twice as many, even
    where many rows share a key. Each task decides alone, so nothing but the sample reaches the driver."""
    n = rows.count()
    if n <= most:
        return rows
    edge = int(most / n * 2**64) - 2**63
    return rows.where(F.xxhash64(key, F.lit(seed)) < edge).limit(2 * most)


def separate(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(doc long, key, text): ``doc`` is the key where every row has one of its own, else a number of each row by its key
    (nulls first), so that rows that share a key are documents of their own. Only then are the rows sorted and written out."""
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    whole = rows.schema["key"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and rows.groupBy("key").count().where("count > 1 or key is null").isEmpty():
        return rows.select(F.col("key").cast("long").alias("doc"), "key", "text")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), F.asc_nulls_first("key"), "row").sortWithinPartitions(F.asc_nulls_first("key"), "row")
    return materialize(dealt.select(F.monotonically_increasing_id().alias("doc"), "key", "text"))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a newline, and where each begins (with the end as the last entry)."""
    texts = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    return data, np.concatenate([[0], np.cumsum(lengths)])


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than space and tab to carriage return. Returns them joined by one space (a space
    after each) and each word's begin and end in that array; ``data`` must end with a separator."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = inside.copy()
    keep[ends[ends < len(data)]] = True
    joined = np.where(inside, data, 32).astype(np.uint8)[keep]
    lengths = ends - begins
    new_begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    return joined, new_begins, new_begins + lengths


def owners(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each word of ``data`` belongs to."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)) == 1)
    return np.searchsorted(offsets, begins, side="right") - 1


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)


def _powers(base: int, n: int, cache: dict) -> np.ndarray:
    if len(cache.get(base, ())) < n:
        size = max(n, 2 * len(cache.get(base, ())), 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        cache[base] = np.multiply.accumulate(out)
    return cache[base][:n]


_POWERS: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[begin:end] for each range, equal for equal ranges."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _powers(_ODD, n, _POWERS), out=sums[1:], dtype=np.uint64)
    h = (sums[ends] - sums[begins]) * _powers(_INVERSE, n + 1, _POWERS)[begins]
    return mix(h + (ends - begins).astype(np.uint64))


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """Whether data[a:a+length] equals data[b:b+length], for each pair."""
    out = np.ones(len(a), bool)
    at, longest = 0, int(lengths.max(initial=1))
    rows = max(1, step // longest)
    while at < len(a):
        to = min(len(a), at + rows)
        span = np.arange(int(lengths[at:to].max(initial=0)))
        use = span < lengths[at:to, None]
        last = len(data) - 1
        x = data[np.minimum(a[at:to, None] + span, last)]
        y = data[np.minimum(b[at:to, None] + span, last)]
        out[at:to] = ((x == y) | ~use).all(axis=1)
        at = to
    return out


def earliest(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether data[begin:end] is, of all equal ranges, the one with the least (doc, start); confirmed byte for byte."""
    if not len(begin):
        return np.zeros(0, bool)
    key = range_hashes(data, begin, end)
    order = np.lexsort((start, doc, key))
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    late = same & ((doc[order] != doc[head]) | (start[order] != start[head]))
    i, j = order[late], head[late]
    length = end[i] - begin[i]
    equal = (length == end[j] - begin[j]) & equal_ranges(data, begin[i], begin[j], length)
    keep = np.ones(len(begin), bool)
    keep[i[equal]] = False
    return keep


#: Strings packed by bucket: compressed arrays of their documents, starts and lengths, and the strings end to end. A block
#: without strings holds spans that the sending task has settled.
BLOCK_SCHEMA = "bucket int, docs binary, starts binary, counts binary, packed binary"


def pack_blocks(held: dict, settled: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK_SCHEMA from {bucket: [(docs, starts, counts, bytes)]} and settled [(docs, starts, counts)]."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    rows = [(b, *[np.concatenate([x[i] for x in parts]) for i in range(3)], b"".join(x[3] for x in parts)) for b, parts in held.items()]
    if settled:
        doc, start, count = (np.concatenate([x[i] for x in settled]) for i in range(3))
        bucket = mix(doc.astype(np.uint64)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            rows.append((int(bucket[part[0]]), doc[part], start[part], count[part], None))
    for i in range(0, len(rows), 2000):
        part = rows[i : i + 2000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in part], pa.int32()),
                *[pa.array([squeeze(np.ascontiguousarray(r[i], t).tobytes()) for r in part], pa.binary()) for i, t in ((1, np.int64), (2, np.int32), (3, np.int32))],
                pa.array([None if r[4] is None else squeeze(r[4]) for r in part], pa.binary()),
            ],
            ["bucket", "docs", "starts", "counts", "packed"],
        )


def unpack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From rows sorted by bucket: (settled spans or None, [(docs, starts, counts, bytes) of a whole bucket]), one bucket
    expanded at a time."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress

    def arrays(row: dict) -> list[np.ndarray]:
        return [np.frombuffer(expand(row[c]), t) for c, t in (("docs", np.int64), ("starts", np.int32), ("counts", np.int32))]

    def join(parts: list) -> list[np.ndarray]:
        return [np.concatenate([x[i] for x in parts]) for i in range(3)]

    for group in sorted_groups(batches, "bucket"):
        bucket = group.column("bucket").to_numpy()
        for at in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
            rows = group.slice(int(at[0]), len(at)).to_pylist()
            settled = [arrays(row) for row in rows if row["packed"] is None]
            held = [(arrays(row), row["packed"]) for row in rows if row["packed"] is not None]
            blocks = [(*join([x for x, _ in held]), b"".join([expand(packed) for _, packed in held]))] if held else []
            del rows, held
            yield join(settled) if settled else None, blocks


def span_batch(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, count)], ["doc", "start", "count"])


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of rows with one key, of input sorted by it; several small runs come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if held and keys[0].as_py() != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        last = keys[-1].as_py()
        same = pc.equal(keys, last).to_numpy(zero_copy_only=False)
        cut = batch.num_rows - int(same[::-1].argmin() if not same.all() else batch.num_rows)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def settled(edges: DataFrame) -> bool:
    """Whether the edges (node, parent), with parent < node, are stars: no node has two parents or is one itself."""
    ends = edges.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list: (node, component).

    Distributed union-find by alternating large-star and small-star steps on DataFrames. Every round is written to
    the shared folder; the loop ends when every node hangs from its component's smallest one. Self-edges and repeated edges are
    allowed; an empty edge list gives an empty result.
    """
    edges = materialize(
        edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("node"), F.least(src, dst).alias("parent")).distinct()
    )
    for _ in range(most_rounds):
        if settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
        least = both.groupBy("node").agg(F.least(F.min("parent"), F.col("node")).alias("least"))
        large = both.join(least, "node").where(F.col("parent") > F.col("node")).select(F.col("parent").alias("node"), F.col("least").alias("parent")).distinct()
        least = large.groupBy("node").agg(F.min("parent").alias("least"))
        small = large.join(least, "node").select(
            F.explode(
                F.when(F.col("parent") != F.col("least"), F.array(F.struct(F.col("parent").alias("node"), F.col("least").alias("parent")), F.struct("node", F.col("least").alias("parent"))))
                .otherwise(F.array(F.struct("node", F.col("least").alias("parent"))))
            ).alias("e")
        ).select("e.node", "e.parent").distinct()
        edges = materialize(small)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select("node", F.col("parent").alias("component")).unionByName(edges.select(F.col("parent").alias("node"), F.col("parent").alias("component"))).distinct()
