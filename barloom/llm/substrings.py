"""Substring dedup (operator 1) by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the leftmost of its word m-grams with the least
hash. Consecutive windows with the same minimiser occurrence form a super-k-mer: it travels once, as one packed string
(words joined by a space), to the bucket of its minimiser, so equal windows always meet. In a bucket all windows are
sorted by content hash; runs of equal hashes are confirmed byte for byte, and every window but the earliest of its run is
reported. Before the exchange a task settles identical super-k-mers of its batch: only the earliest travels, for the
windows of the others surely start earlier elsewhere; so a passage in a third of all documents reaches its bucket about
once a batch. A phrase that stands in many different contexts would draw all of these into one bucket: grams that are the
minimisers of more than ``HOT`` buckets' share of the words, by a sample of ``SAMPLE`` documents, come last in the order of
grams, so such windows go by another gram of theirs. The sample only decides where windows travel, the same for equal ones. Buckets (``per_partition`` for each shuffle partition) travel as compressed blocks.

Defined results: words are runs of bytes other than space and tab to carriage return; a null or empty text has none;
windows are judged on the input; a window is removed if an equal one has a smaller (doc_id, start), a null doc_id being
the smallest; rows that share a doc_id are documents of their own, in an order of their rows that is fixed for a run; a text
of any length is one document; an empty table gives an empty one; the operator reads the key and the text alone, so names
of other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BLOCK_SCHEMA, earliest, equal_ranges, flat_bytes, materialize, owners, pack_blocks, partitions, range_hashes, sample, separate, span_batch, text_chunks, unpack_blocks, words

K, M = 20, 6
CHUNK_BYTES = 1 << 20
FLUSH_BYTES = 16 << 20
HOT, SAMPLE = 4, 4000


def super_kmers(data: np.ndarray, offsets: np.ndarray, k: int, m: int, hot: np.ndarray | None = None):
    """Of all texts in ``data``: joined words, their begins and ends, and per super-k-mer its text, first word (in the
    text), first and last word (in the array) and minimiser hash. Grams in ``hot`` come after all others."""
    joined, begins, ends = words(data)
    owner = owners(data, offsets)
    n = len(begins)
    if n < k:
        return joined, begins, ends, *[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64)
    grams = range_hashes(joined, begins[: n - m + 1], ends[m - 1 :])
    span = k - m + 1
    order = grams >> np.uint64(1)
    if hot is not None and len(hot):
        order |= np.isin(grams, hot).astype(np.uint64) << np.uint64(63)
    at = np.lib.stride_tricks.sliding_window_view(order, span).argmin(axis=1) + np.arange(n - k + 1)
    whole = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    if not len(whole):
        return joined, begins, ends, *[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64)
    fresh = np.concatenate([[True], (np.diff(whole) > 1) | (np.diff(at[whole]) != 0)])
    first = whole[fresh]
    last = whole[np.concatenate([np.flatnonzero(fresh)[1:], [len(whole)]]) - 1] + k - 1
    text_first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    return joined, begins, ends, owner[first], first - text_first[owner[first]], first, last, grams[at[first]]


def hot_minimisers(docs: DataFrame, k: int, m: int, buckets: int) -> np.ndarray:
    """Minimisers of more than HOT buckets' share of a sample's words; no more than buckets / HOT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            *_, first, last, minimiser = super_kmers(*flat_bytes(batch.column("text")), k, m)
            if len(first):
                kinds, at = np.unique(minimiser, return_inverse=True)
                words_of = np.bincount(at, last - first + 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(words_of)], ["minimiser", "n"])

    counts = sample(docs, F.col("doc"), SAMPLE).mapInArrow(run, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = sorted(r[0] for r in counts.where(F.col("n") > max(20 * k, total * HOT / buckets)).select("minimiser").collect())
    return np.array(found, np.int64).view(np.uint64)


def _route(k: int, m: int, buckets: int, hot: np.ndarray):
    """Documents (doc, text) to blocks of super-k-mers by bucket; blocks without strings carry settled spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, settled, size = defaultdict(list), [], 0
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            ids = batch.column("doc").to_numpy()
            data, offsets = flat_bytes(batch.column("text"))
            joined, begins, ends, text, start, first, last, minimiser = super_kmers(data, offsets, k, m, hot)
            if not len(text):
                continue
            doc, count = ids[text], last - first + 1
            keep = earliest(joined, begins[first], ends[last], doc, start)
            if not keep.all():
                settled.append((doc[~keep], start[~keep].astype(np.int32), count[~keep].astype(np.int32)))
            sent = np.flatnonzero(keep)
            bucket = (minimiser[sent] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            buf = joined.tobytes()
            lo, hi = begins[first[sent]].tolist(), (ends[last[sent]] + 1).tolist()
            for part in np.split(np.arange(len(sent)), np.flatnonzero(np.diff(bucket)) + 1):
                strings = b"".join([buf[lo[i] : hi[i]] for i in part.tolist()])
                at = sent[part]
                held[int(bucket[part[0]])].append((doc[at], start[at].astype(np.int32), count[at].astype(np.int32), strings))
                size += len(strings)
            if size > FLUSH_BYTES:
                yield from pack_blocks(held, settled, buckets)
                held, settled, size = defaultdict(list), [], 0
        yield from pack_blocks(held, settled, buckets)

    return run


def repeated_windows(doc: np.ndarray, start: np.ndarray, count: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of one bucket's super-k-mers: (doc, first word) of every window that also starts earlier."""
    joined, begins, ends = words(data)
    origin = np.repeat(np.arange(len(doc)), count)
    n = len(origin)
    at = np.arange(n)
    within = at - np.repeat(np.cumsum(count) - count, count)
    w = at[within <= np.repeat(count, count) - k]
    key = range_hashes(joined, begins[w], ends[w + k - 1])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    multiple = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order = order[multiple]
    w, key = w[order], key[order]
    wdoc, wstart = doc[origin[w]], start[origin[w]] + within[w]
    order = np.lexsort((wstart, wdoc, key))
    w, key, wdoc, wstart = w[order], key[order], wdoc[order], wstart[order]
    if not len(w):
        return wdoc, wstart
    same = np.concatenate([[False], key[1:] == key[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(w))))
    length = ends[w + k - 1] - begins[w]
    equal = (length == length[head]) & equal_ranges(joined, begins[w], begins[w[head]], length)
    late = (wdoc != wdoc[head]) | (wstart != wstart[head])
    out = late & equal
    for clash in np.unique(head[~equal]).tolist():  # different windows with one hash
        seen: dict[bytes, tuple] = {}
        for i in np.flatnonzero(head == clash).tolist():
            text = joined[begins[w[i]] : ends[w[i] + k - 1]].tobytes()
            out[i] = seen.setdefault(text, (wdoc[i], wstart[i])) != (wdoc[i], wstart[i])
    return wdoc[out], wstart[out]


def _judge(k: int):
    """Blocks sorted by bucket to spans (doc, start, count) of words to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for settled, blocks in unpack_blocks(batches):
            if settled is not None:
                yield span_batch(*settled)
            for doc, start, count, data in blocks:
                doc, at = repeated_windows(doc, start, count, np.frombuffer(data, np.uint8), k)
                if len(doc):
                    order = np.lexsort((at, doc))
                    doc, at = doc[order], at[order]
                    fresh = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(at) > 1)])
                    last = np.concatenate([np.flatnonzero(fresh)[1:], [len(doc)]]) - 1
                    yield span_batch(doc[fresh], at[fresh], at[last] - at[fresh] + k)

    return run


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, per_partition: int = 8) -> DataFrame:
    """(doc, start, count): spans of words to remove, covering exactly the windows that also start earlier."""
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select("doc", "text")
    hot = hot_minimisers(docs, k, m, n * per_partition)
    blocks = docs.mapInArrow(_route(k, m, n * per_partition, hot), BLOCK_SCHEMA)
    return blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(k), "doc long, start long, count long")


def cut_words(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Words, removed words and the kept words joined by one space."""
    joined, begins, ends = words(np.frombuffer(data + b"\n", np.uint8))
    n = len(begins)
    mark = np.zeros(n + 1, np.int64)
    if spans:
        pairs = np.asarray(spans, np.int64)
        np.add.at(mark, np.minimum(pairs[:, 0], n), 1)
        np.add.at(mark, np.minimum(pairs[:, 0] + pairs[:, 1], n), -1)
    gone = np.cumsum(mark)[:n] > 0
    if not gone.any():
        return n, 0, joined[:-1].tobytes()
    kept = joined[np.repeat(~gone, ends - begins + 1)]
    return n, int(gone.sum()), kept[:-1].tobytes()


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M, per_partition: int = 8) -> DataFrame:
    """(key, n_words, n_removed, kept): each row's words without those of windows that also start earlier."""
    kind = df.schema[key].dataType.simpleString()
    docs = separate(df, key, text)
    spans = repeated_spans(docs, k, m, per_partition).groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    rows = docs.join(spans.withColumnRenamed("doc", "of"), F.col("doc") == F.col("of"), "left").select("key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", 4 * CHUNK_BYTES):
            out = [cut_words((t or "").encode(), [(s["start"], s["count"]) for s in x or ()]) for t, x in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].decode() for x in out], pa.string())],
                ["key", "n_words", "n_removed", "kept"],
            )

    return rows.mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)


def document_digests(documents: DataFrame) -> DataFrame:
    """The query: doc_id, n_words, n_removed, kept_sha256."""
    return dedup(documents.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
