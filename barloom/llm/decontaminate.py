"""Benchmark decontamination (operator 9) by pigeonhole edit matching.

A test item of n characters may differ from a passage by ``floor(error_rate * n)`` edits. The item is split into one piece
more than that, so at least one piece occurs in the passage unchanged. All pieces of a group of items are searched in the
documents at once (Aho-Corasick); hits of one item on neighbouring diagonals give a window of the document, and Myers'
bit-parallel algorithm finds the least edit distance between the item and any substring of that window.

Items are broadcast in groups of about ``GROUP_BYTES`` of text. A benchmark of several groups is searched in one pass each,
whose findings are written before the next group is read, so what is broadcast and held at once is one group. Documents are
never shuffled for the search; with several groups their numbered rows are joined with the findings in the end.

Both sides are lower-cased and runs of white space count as one space. Defined results: null or empty items and texts
match nothing; an empty benchmark or table finds nothing; repeated items are reported each; rows with a null or repeated
doc_id are documents of their own, each with its own leaks; texts of any length are searched whole; of several passages of
one document that match an item, the least distance (then the first end) is reported; a column ``leaks`` of the input is
replaced, all others are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize, text_chunks

ERROR_RATE = 0.08
GROUP_BYTES = 8 << 20
CHUNK_BYTES = 4 << 20
LEAK = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def piece_bounds(length: int, errors: int) -> list[tuple[int, int]]:
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def myers(pattern: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text`` and the first end where it is reached."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full  # a match may begin anywhere in the text
        down = (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < best:
            best, at = score, i + 1
    return best, at


class Matcher:
    """Pieces of a group of items, ready to search."""

    def __init__(self, items: list[tuple[int, str, int]], error_rate: float):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        places = defaultdict(list)
        for item_id, text, copies in items:
            text = normal(text)
            if not text:
                continue
            errors = int(error_rate * len(text))
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            for begin, end in piece_bounds(len(text), errors):
                places[text[begin:end]].append((len(self.items), begin))
            self.items.append((item_id, text, masks, errors, copies))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[dict]:
        if not self.items or not text:
            return []
        diagonals = defaultdict(set)
        for end, (length, where) in self.automaton.iter(text):
            for item, offset in where:
                diagonals[item].add(end + 1 - length - offset)
        out = []
        for item, starts in diagonals.items():
            item_id, pattern, masks, errors, copies = self.items[item]
            best = None
            window: list[int] = []
            for start in [*sorted(starts), None]:
                if window and (start is None or start - window[1] > 2 * errors):
                    low = max(0, window[0] - errors)
                    distance, end = myers(pattern, masks, text[low : window[1] + len(pattern) + errors])
                    if distance <= errors and (best is None or (distance, low + end) < best):
                        best = (distance, low + end)
                    window = []
                if start is not None:
                    window = [window[0] if window else start, start]
            if best:
                out += [{"item_id": item_id, "distance": best[0], "begin": max(0, best[1] - len(pattern)), "end": best[1]}] * copies
        return sorted(out, key=lambda x: (x["item_id"] is not None, x["item_id"] or 0, x["distance"], x["end"]))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", error_rate: float = ERROR_RATE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, distance, begin, end), offsets being those of the normal text."""
    docs = docs.select(*[c for c in docs.columns if c != "leaks"])
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    # copies of an item are one row here, so none fills a group
    items = items.groupBy("item_id", "text").agg(F.count("*").cast("int").alias("copies"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    if groups == 1:
        return _search(docs, items, text, error_rate)
    row = "_row"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        leaks = materialize(_search(numbered.select(row, text), part, text, error_rate).where(F.size("leaks") > 0).select(row, "leaks"))
        found = leaks if found is None else found.unionByName(leaks)
    each = found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return numbered.join(each, row, "left").withColumn("leaks", F.coalesce("leaks", F.expr(_NONE))).drop(row)


_NONE = "cast(array() as array<struct<item_id: long, distance: int, begin: long, end: long>>)"


def _search(docs: DataFrame, items: DataFrame, text: str, error_rate: float) -> DataFrame:
    """``docs`` with the leaks of one group of items, which is collected and broadcast."""
    schema, at, names = docs.withColumn("leaks", F.expr(_NONE)).schema, docs.columns.index(text), [*docs.columns, "leaks"]
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.select("item_id", "text", "copies").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        for batch in text_chunks(batches, text, CHUNK_BYTES):
            found = [matcher.leaks(normal(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(LEAK))], names)

    return docs.mapInArrow(run, schema)


def document_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query: doc_id, item_id, distance for each item that a document leaks."""
    found = scan(documents.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance")
