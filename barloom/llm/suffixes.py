"""Suffix-array dedup (operator 5) by a distributed difference-cover algorithm.

Removes every byte covered by a ``width``-byte string that also starts earlier. Three steps, each a Spark exchange:

1. Anchors. Each ``width``-byte string has an anchor: the leftmost of its ``GRAM``-byte grams with the least hash; equal
   strings have equal anchors. Anchors are counted over all documents. Those met more than once go into a Bloom filter of
   bounded size; strings with any other anchor occur once and need no comparison.
2. Stretches. Consecutive strings with one anchor occurrence form a stretch, which travels packed to its anchor's bucket,
   so all occurrences of a string meet. Identical stretches are settled first, in the sending task and in the bucket: all
   strings of all but the earliest start earlier elsewhere.
3. Suffix arrays. In each bucket the different stretches of one anchor are laid end to end and their suffixes are sorted by
   the difference cover modulo 3: sampled triples are sorted and named, names are sorted by recursion, the remaining
   suffixes are sorted by their first symbol and the sampled rank behind it, and both are merged. Neighbours in the array
   with ``width`` common bytes are occurrences of one string; all but the earliest are removed.

Anchors with more than ``total / (HOT_SHARE * buckets)`` occurrences (so at most HOT_SHARE times as many as buckets) do not
share one bucket: their strings travel one by one to buckets of their own content hash.

Defined results: a null text is empty; strings never cross documents and are judged on the input; "earlier" is the smaller
(doc_id, start), a null doc_id being the smallest; rows that share a doc_id are documents of their own, in an order of their
rows that is fixed for a run; a text of any length is one document, cut where its stretches end; an empty table gives an
empty one; the operator reads the key and the text alone, so names of other columns don't matter.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import (
    _INVERSE,
    _ODD,
    _POWERS,
    _powers,
    BLOCK_SCHEMA,
    earliest,
    flat_bytes,
    materialize,
    mix,
    pack_blocks,
    partitions,
    range_hashes,
    sorted_groups,
    separate,
    span_batch,
    text_chunks,
    unpack_blocks,
)

WIDTH, GRAM = 100, 32
CHUNK_BYTES = 2 << 20
FLUSH_BYTES = 32 << 20
MOST_BLOCKS = 1 << 22
HOT_SHARE = 4
_CHUNK = 1 << 13
#: Suffix arrays are built over about so many bytes at once (one anchor's stretches stay together).
ARRAY_BYTES = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of positive integers by the difference cover modulo 3, each step on whole arrays."""
    n = len(s)
    if n < 3:
        return np.asarray(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    p = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    # sort and name sampled triples; the dummy at n closes the first half where n = 1 (mod 3)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    a, b, c = p[sampled], p[sampled + 1], p[np.minimum(sampled + 2, n + 2)]
    top = int(p.max()) + 1
    if top < 1 << 21:
        order = np.argsort((a * top + b) * top + c, kind="stable")
    else:
        order = np.lexsort((c, b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)])
    names = np.empty(len(sampled), np.int64)
    names[order] = np.cumsum(new)
    if names.max() < len(sampled):
        order = suffix_array(names)  # recurse on names
    rank = np.zeros(n + 4, np.int64)
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    # the other suffixes: first symbol, then the rank behind it
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], p[rest]))]
    # merge: how many sampled suffixes of either kind come before each other suffix
    size = np.int64(len(sampled) + 2)
    by = sampled[order]
    by = by[by < n]
    one, two = by[by % 3 == 1], by[by % 3 == 2]
    before = np.searchsorted(p[one] * size + rank[one + 1], p[rest] * size + rank[rest + 1])
    if top < 1 << 21 and size < 1 << 21:
        key = lambda i: (p[i] * top + p[i + 1]) * size + rank[i + 2]
        before = before + np.searchsorted(key(two), key(rest))
    else:
        both = np.concatenate([two, rest])
        kind = np.concatenate([np.ones(len(two), np.int64), np.zeros(len(rest), np.int64)])
        joint = np.lexsort((rank[both + 2], p[both + 1], p[both]))
        counts = np.cumsum(kind[joint])
        place = np.empty(len(both), np.int64)
        place[joint] = counts
        before = before + place[len(two) :]
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = by
    return out


def repeated_strings(doc: np.ndarray, start: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of each width-byte string of the stretches data[begin:end] that also starts earlier in one of them."""
    lengths = end - begin
    total = int((lengths + 1).sum())
    # stretches end to end, bytes as 1..256 and a 257 after each, which no common prefix spans unnoticed
    offset = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(doc)), lengths + 1)
    within = np.arange(total) - offset[owner]
    closed = within == lengths[owner]
    symbols = np.where(closed, 257, data[np.minimum(begin[owner] + within, len(data) - 1)].astype(np.int64) + 1)
    order = suffix_array(symbols)
    order = order[within[order] + width <= lengths[owner[order]]]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # neighbours with `width` common bytes, compared byte for byte
    a, b = order[:-1], order[1:]
    alike = symbols[a] == symbols[b]
    for step in range(0, width, 8):
        span = np.arange(step, min(width, step + 8))
        live = np.flatnonzero(alike)
        if not len(live):
            break
        alike[live] = (symbols[a[live, None] + span] == symbols[b[live, None] + span]).all(axis=1)
    group = np.concatenate([[0], np.cumsum(~alike)])
    d, at = doc[owner[order]], start[owner[order]] + within[order]
    by = np.lexsort((at, d, group))
    head = by[np.maximum.accumulate(np.where(np.diff(group[by], prepend=-1) != 0, np.arange(len(by)), 0))]
    late = (d[by] != d[head]) | (at[by] != at[head])
    return d[by][late], at[by][late]


def stretches(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all texts in ``data``: per stretch its anchor hash, text, first byte and end."""
    n = len(data)
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n <= width:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * _powers(_ODD, n, _POWERS), out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n + 1, _POWERS)[: n - gram + 1])
    # sliding least by doubling, with a position kept in the low bits so that the leftmost wins; pieces bound those bits
    piece, span = int(_LOW) - 2 * width, width - gram + 1
    at = np.empty(len(hashes) - span + 1, np.int64)
    for lo in range(0, len(at), piece):
        part = hashes[lo : lo + piece + span - 1]
        v = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < span:
            v = np.minimum(v[: len(v) - (span - size)], v[span - size :])
        at[lo : lo + piece] = (v[: min(piece, len(at) - lo)] & _LOW).astype(np.int64) + lo
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.arange(len(at))
    whole = np.flatnonzero(first + width <= offsets[owner[: len(at)] + 1] - 1)
    if not len(whole):
        return none
    fresh = np.concatenate([[True], (np.diff(whole) > 1) | (np.diff(at[whole]) != 0)])
    begin = whole[fresh]
    end = whole[np.concatenate([np.flatnonzero(fresh)[1:], [len(whole)]]) - 1] + width
    return hashes[at[begin]], owner[begin], begin, end


def _count_anchors(width: int, gram: int, buckets: int):
    """Documents to blocks of anchor hashes by bucket; an anchor met twice in a chunk is sent twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", 8 * CHUNK_BYTES):
            found = [stretches(*flat_bytes(x.column("text")), width, gram)[0] for x in text_chunks([batch], "text", CHUNK_BYTES)]
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            bucket = (values % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            values, counts, bucket = values[order], np.minimum(counts[order], 2**31 - 1).astype("<i4"), bucket[order]
            parts = [p for p in np.split(np.arange(len(values)), np.flatnonzero(np.diff(bucket)) + 1) if len(p)]
            for i in range(0, len(parts), 4000):
                some = parts[i : i + 4000]
                once = [p[counts[p] == 1] for p in some]
                more = [p[counts[p] > 1] for p in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[p[0]]) for p in some], pa.int32()), pa.array([values[p].tobytes() for p in once], pa.binary()), pa.array([values[p].tobytes() for p in more], pa.binary()), pa.array([counts[p].tobytes() for p in more], pa.binary())],
                    ["bucket", "once", "more", "counts"],
                )

    return run


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket to (anchor, n) of those met more than once; one row with a null anchor gives all anchors met."""
    for group in sorted_groups(batches, "bucket"):
        once = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("once").to_pylist()])
        more = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("more").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<i4") for x in group.column("counts").to_pylist()]).astype(np.int64)
        values, at = np.unique(np.concatenate([once, more]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.ones(len(once)), counts]), len(values)).astype(np.int64)
        use = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(values[use].view(np.int64)), pa.array(n[use])], ["anchor", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["anchor", "n"])


def _block_and_bits(anchor: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's block of a blocked Bloom filter and its four bits there."""
    h = mix(anchor ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    bits = np.zeros(len(h), np.uint64)
    for i in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), bits


def _bloom(repeated: DataFrame) -> np.ndarray:
    """The Bloom filter of the repeated anchors, at most MOST_BLOCKS words of 64 bits."""
    count = repeated.count()
    blocks = min(MOST_BLOCKS, 1 << max(10, math.ceil(math.log2(count / 4 + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = _block_and_bits(batch.column("anchor").to_numpy().view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], ["block", "bits"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "chunk"):
            chunk, block, bits = (group.column(c).to_numpy() for c in ("chunk", "block", "bits"))
            for part in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1):
                words = np.zeros(_CHUNK, np.uint64)
                words[block[part] % _CHUNK] = bits[part].view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk[part[0]])], pa.int64()), pa.array([words.tobytes()], pa.binary())], ["chunk", "words"])

    table = repeated.select("anchor").mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    table = table.withColumn("chunk", F.expr(f"block div {_CHUNK}")).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(pack, "chunk long, words binary")
    out = np.zeros(max(blocks, _CHUNK), np.uint64)
    for row in table.toLocalIterator():  # at most MOST_BLOCKS / _CHUNK rows
        out[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["words"], np.uint64)
    return out[:blocks]


def _route(width: int, gram: int, buckets: int, shared):
    """Documents (doc, text) to blocks of stretches by bucket of their anchor, for anchors that may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, hot = shared.value
        held, settled, size = defaultdict(list), [], 0
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            ids = batch.column("doc").to_numpy()
            data, offsets = flat_bytes(batch.column("text"))
            anchor, text, begin, end = stretches(data, offsets, width, gram)
            block, bits = _block_and_bits(anchor, len(bloom))
            use = (bloom[block] & bits) == bits
            anchor, text, begin, end = anchor[use], text[use], begin[use], end[use]
            doc, start = ids[text], begin - offsets[text]
            keep = earliest(data, begin, end, doc, start)
            late = [(doc[~keep], start[~keep].astype(np.int32), (end - begin)[~keep].astype(np.int32))]
            anchor, doc, start, begin, end = (x[keep] for x in (anchor, doc, start, begin, end))
            if len(hot) and (busy := np.isin(anchor, hot)).any():
                # strings of hot anchors go one by one
                many = end[busy] - begin[busy] - width + 1
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                b, s, d = np.repeat(begin[busy], many) + step, np.repeat(start[busy], many) + step, np.repeat(doc[busy], many)
                alone = earliest(data, b, b + width, d, s)
                late.append((d[~alone], s[~alone].astype(np.int32), np.full(int((~alone).sum()), width, np.int32)))
                b, s, d = b[alone], s[alone], d[alone]
                anchor, doc, start = np.concatenate([anchor[~busy], range_hashes(data, b, b + width)]), np.concatenate([doc[~busy], d]), np.concatenate([start[~busy], s])
                begin, end = np.concatenate([begin[~busy], b]), np.concatenate([end[~busy], b + width])
            settled += [x for x in late if len(x[0])]
            bucket = (anchor % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((anchor, bucket))
            bucket, doc, start, begin, end = (x[order] for x in (bucket, doc, start, begin, end))
            buf, lo, hi = data.tobytes(), begin.tolist(), end.tolist()
            for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(part):
                    strings = b"".join([buf[lo[i] : hi[i]] for i in part.tolist()])
                    held[int(bucket[part[0]])].append((doc[part], start[part].astype(np.int32), (end - begin)[part].astype(np.int32), strings))
                    size += len(strings)
            if size > FLUSH_BYTES:
                yield from pack_blocks(held, settled, buckets)
                held, settled, size = defaultdict(list), [], 0
        yield from pack_blocks(held, settled, buckets)

    return run


def anchors_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The anchor hash of each stretch: that of the first string in it (all its strings share one)."""
    span = width - gram + 1
    out = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), 1 << 15):
        b = begin[at : at + (1 << 15), None] + np.arange(span)
        h = range_hashes_fixed(data, b.ravel(), gram).reshape(b.shape)
        v = (h & ~_LOW) | np.arange(span, dtype=np.uint64)
        out[at : at + (1 << 15)] = h[np.arange(len(h)), v.argmin(axis=1)]
    return out


def range_hashes_fixed(data: np.ndarray, begin: np.ndarray, gram: int) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * _powers(_ODD, len(data), _POWERS), out=sums[1:])
    return mix((sums[begin + gram] - sums[begin]) * _powers(_INVERSE, len(data) + 1, _POWERS)[begin])


def _judge(width: int, gram: int):
    """Blocks sorted by bucket to spans (doc, start, count) of bytes to remove."""

    def compare(doc, start, length, data) -> Iterator[pa.RecordBatch]:
        end = np.cumsum(length.astype(np.int64))
        begin = end - length
        keep = earliest(data, begin, end, doc, start)
        if not keep.all():
            yield span_batch(doc[~keep], start[~keep], length[~keep])
        doc, start, begin, end = doc[keep], start[keep].astype(np.int64), begin[keep], end[keep]
        anchor = anchors_of(data, begin, end, width, gram)
        order = np.argsort(anchor, kind="stable")
        cuts = np.flatnonzero(np.diff(anchor[order])) + 1
        groups = [g for g in np.split(order, cuts) if len(g) > 1]  # a lone stretch has nothing to compare with
        at = 0
        while at < len(groups):
            some, size = [], 0
            while at < len(groups) and (not some or size < ARRAY_BYTES):
                some.append(groups[at])
                size += int((end - begin)[groups[at]].sum())
                at += 1
            rows = np.concatenate(some)
            d, s = repeated_strings(doc[rows], start[rows], data, begin[rows], end[rows], width)
            if len(d):
                by = np.lexsort((s, d))
                d, s = d[by], s[by]
                fresh = np.concatenate([[True], (np.diff(d) != 0) | (np.diff(s) > 1)])
                last = np.concatenate([np.flatnonzero(fresh)[1:], [len(d)]]) - 1
                yield span_batch(d[fresh], s[fresh], s[last] - s[fresh] + width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for settled, blocks in unpack_blocks(batches):
            if settled is not None:
                yield span_batch(*settled)
            for doc, start, length, data in blocks:
                if len(doc):
                    yield from compare(doc, start, length, np.frombuffer(data, np.uint8))

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, per_partition: int = 8) -> DataFrame:
    """(doc, start, count): spans of bytes to remove, covering exactly the strings that also start earlier."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = n * per_partition
    docs = docs.select("doc", "text")
    met = docs.select("text").mapInArrow(_count_anchors(width, gram, buckets), "bucket int, once binary, more binary, counts binary")
    met = materialize(met.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated_anchors, "anchor long, n long"))
    total = met.where("anchor is null").agg(F.sum("n")).first()[0] or 0
    repeated = met.where("anchor is not null")
    hot = repeated.where(F.col("n") > max(1000, total // (HOT_SHARE * buckets))).select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast((_bloom(repeated), hot))
    blocks = docs.mapInArrow(_route(width, gram, buckets, shared), BLOCK_SCHEMA)
    return blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(width, gram), "doc long, start long, count long")


def cut_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs and the bytes that stay."""
    n = len(data)
    if not spans:
        return n, 0, 0, data
    pairs = np.asarray(spans, np.int64)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.minimum(pairs[:, 0], n), 1)
    np.add.at(mark, np.minimum(pairs[:, 0] + pairs[:, 1], n), -1)
    gone = np.cumsum(mark)[:n] > 0
    runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return n, int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, per_partition: int = 8) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary): each row's bytes without those of strings that also start earlier."""
    kind = df.schema[key].dataType.simpleString()
    docs = separate(df, key, text)
    spans = repeated_spans(docs, width, gram, per_partition).groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    rows = docs.join(spans.withColumnRenamed("doc", "of"), F.col("doc") == F.col("of"), "left").select("key", "text", "spans")
    names = ["n_bytes", "n_removed", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", 4 * CHUNK_BYTES):
            out = [cut_bytes((t or "").encode(), [(s["start"], s["count"]) for s in x or ()]) for t, x in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array([x[i] for x in out], pa.int64()) for i in range(3)], pa.array([x[3] for x in out], pa.binary())], ["key", *names, "kept"])

    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("key", key)


def document_digests(documents: DataFrame) -> DataFrame:
    """The query: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(documents.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
