"""SimHash near-dedup (operator 6) by covering locality-sensitive hashing.

A fingerprint has bit b set if more than half the XXH64 hashes (seed 42) of the text's word shingles have it set. To find
every pair of fingerprints within ``radius`` differing bits, each bit position gets a nonzero vector of ``radius + 1``
bits; table v (one for each nonzero v, 15 at radius 3) keeps the bits whose vector has odd inner product with v. For any
``radius`` positions some v is orthogonal to all their vectors, so every such pair agrees in that table: no pair is missed.
Distinct fingerprints are exchanged by (table, kept bits); within a bucket they are compared in blocks and each is linked
to the smallest one its links reach there, so links stay linear in number. Buckets above ``split_above`` fingerprints are
covered again on the bits that are not fixed yet and spread over further buckets, level by level, until they are small.

Defined results: a null or wordless text has fingerprint zero, linked like any other; equal fingerprints are one node, so
copies are never expanded into pairs; a null doc_id comes before every other id as a component's least, and rows that share an
id are nodes of their own; texts of any length are hashed whole; an empty table gives no rows; key and text alone are read,
so names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import NULL_ID, connected_components, flat_bytes, materialize, mix, owners, partitions, sorted_groups, text_chunks, words

SEED = 42
BITS = 64
CHUNK_BYTES = 2 << 20


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """Fingerprints (signed 64-bit) of an Arrow array of texts."""
    import xxhash

    data, offsets = flat_bytes(column)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    joined, begins, ends = words(data)
    owner = owners(data, offsets)
    n = len(column)
    counts = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # the last word of each shingle: shingle - 1 on, or the text's last word where the text is shorter
    width = np.minimum(np.maximum(counts, 1), shingle)
    position = np.arange(len(begins)) - first[owner]
    starts = np.flatnonzero(position <= counts[owner] - width[owner])
    stops = starts + width[owner[starts]] - 1
    buf = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buf[a:b], SEED) for a, b in zip(begins[starts].tolist(), ends[stops].tolist(), strict=True)), np.uint64, len(starts))
    out = np.zeros(n, np.int64)
    has = np.flatnonzero(counts)
    if len(has):
        shingles = np.bincount(owner[starts], minlength=n)
        at = np.concatenate([[0], np.cumsum(shingles)[:-1]])
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[has], axis=0, dtype=np.int32)
        out[has] = np.packbits(2 * ones > shingles[has, None], axis=1, bitorder="little").copy().view("<i8")[:, 0]
    return out


def fingerprints(df: DataFrame, key: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp long) of each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fingerprints_of(batch.column("text"), shingle))], ["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def masks(radius: int, free: int = -1) -> list[int]:
    """The covering masks: bit sets of ``free`` (all 64 bits by default), as signed 64-bit values."""
    places = [b for b in range(BITS) if free >> b & 1]
    vector = {b: i % (2 ** (radius + 1) - 1) + 1 for i, b in enumerate(places)}
    out = []
    for v in range(1, 2 ** (radius + 1)):
        m = sum(1 << b for b in places if (vector[b] & v).bit_count() & 1)
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def local_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints of one bucket: each that reaches a smaller one here, and the smallest it reaches."""
    n = len(fps)
    fps = np.sort(fps)
    bits = fps.view(np.uint64)
    label = np.arange(n)
    rows = max(1, (1 << 20) // n)
    while True:
        least = label.copy()
        for a in range(0, n, rows):
            near = np.bitwise_count(bits[a : a + rows, None] ^ bits) <= radius
            least[a : a + rows] = np.where(near, label, n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label < np.arange(n)
    return fps[moved], fps[label[moved]]


#: With so few free bits a bucket holds no more than 4,096 different fingerprints.
LEAST_FREE = 12


def covered_again(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (bucket, free, fp) of large buckets in buckets of the covering masks of the bits that are still free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, free, fp = (batch.column(c).to_numpy() for c in ("bucket", "free", "fp"))
            for kind in np.unique(free).tolist():
                at = np.flatnonzero(free == kind)
                for t, m in enumerate(masks(radius, kind)):
                    key = mix(bucket[at].view(np.uint64) + np.uint64(t + 1)) ^ mix((fp[at] & np.int64(m)).view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(mix(key).view(np.int64)), pa.array(np.full(len(at), kind & ~m, np.int64)), pa.array(fp[at])], ["bucket", "free", "fp"])

    return rows.mapInArrow(run, "bucket long, free long, fp long")


def links(fps: DataFrame, radius: int = 3, split_above: int = 4096) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    spark = fps.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "bucket"):
            keys, fp = group.column("bucket").to_numpy(), group.column("fp").to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            found = [local_links(x, radius) for x in np.split(fp, cuts) if len(x) > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)], ["src", "dst"])

    whole = masks(radius)
    keyed = fps.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(~m).alias("free"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(whole)])).alias("b"), "fp"
    ).select(F.xxhash64("b.t", "b.k").alias("bucket"), "b.free", "fp")
    found = None
    while True:
        # buckets of one are dropped by the join; large ones are covered again on the bits that their masks leave free, until
        # they are small or so few bits are left that they can't be large
        size = materialize(keyed.groupBy("bucket").agg(F.count("*").alias("count"), F.bit_count(F.first("free")).alias("left")).where("count > 1"))
        deep = (F.col("count") > split_above) & (F.col("left") > LEAST_FREE)
        rows = keyed.join(size.where(~deep).select("bucket"), "bucket").select("bucket", "fp").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
        part = rows.mapInArrow(run, "src long, dst long")
        found = part if found is None else found.unionByName(part)
        if size.where(deep).isEmpty():
            return found.distinct()
        keyed = covered_again(materialize(keyed.join(size.where(deep).select("bucket"), "bucket")), radius)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, split_above: int = 4096) -> DataFrame:
    """(key, fp, component): the fingerprint of each row and the smallest key that its links reach."""
    kind = df.schema[key].dataType.simpleString()
    prints = materialize(fingerprints(df, key, text, shingle))
    ids = F.coalesce("key", F.lit(NULL_ID).cast(kind))
    reps = prints.groupBy("fp").agg(F.min(ids).alias("least"))
    joined = connected_components(links(reps.select("fp"), radius, split_above))
    class_of = reps.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = class_of.groupBy("class").agg(F.min("least").alias("component"))
    class_of = class_of.join(least, "class").select("fp", F.nullif("component", F.lit(NULL_ID).cast(kind)).alias("component"))
    return prints.join(class_of, "fp").select(F.col("key").alias(key), "fp", "component")


def document_components(documents: DataFrame) -> DataFrame:
    """The query: doc_id, fingerprint, component_id."""
    found = near_duplicates(documents.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
