"""Packing (operator 13): first-fit decreasing on a tournament tree of capacities, in randomised groups of documents.

Tasks turn texts into token ids. Whole stretches of a sequence's length are sequences of their own and leave the task as one
small row each; only the rest of a document, shorter than a sequence, travels to its group. Groups are drawn by a hash of the
row's number and hold about ``GROUP_DOCS`` rests, so what a task holds is bounded by that times the length of a sequence. Each
group packs its rests, longest first, each into the first sequence with room for it, found in a tree whose nodes hold the
largest room below them. Then the sequences that are not full are filled up from the emptiest ones, whose pieces are cut for
it, and the one left over is cut at powers of two, so nothing is padded.

Ids come from the ``tokenizers`` library without added tokens (text that spells one of the tokenizer's special tokens gives
that token, as the library does by default), then one end id. The vocabulary lower-cases and drops white space, so texts are
cut at spaces and line feeds, and ids of strings between them are kept in tables of bounded size.

Defined results: null, empty and blank texts are one end id; texts of any length are tokenised whole; rows with a null or
repeated doc_id are documents of their own, packed each (their pieces share that doc_id and differ in sequence or offset); of
equal rests the one with the smaller row number goes first; an empty table gives no rows; further columns are not read. The
result follows from the files' splits and the number of groups; sequence ids are unique but not consecutive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import mix, partitions, sorted_groups, text_chunks

LENGTH = 4096
END_ID = 2
GROUP_DOCS = 1024
LEAST_GROUP = 64
CHUNK_BYTES = 1 << 20
SLICE_CHARS = 1 << 20
MOST_KEPT = 500_000
#: Marks that are put apart behind a letter.
ENDS = ".,;:!?"
PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: ``row``: number of the document's row; ``sent``: where it goes; ``ids``: of a rest, null for a full sequence.
SENT = "sent int, row long, ids binary, " + PIECES


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    Strings between spaces keep their ids in two tables: when the newer one is full it becomes the older one, and what is met
    again moves up, so frequent strings stay. Strings that are new are encoded together, set apart by one of the tokenizer's
    special tokens, whose id shows where each one's ids end; one that holds that token's text is encoded by itself. As the
    vocabulary lower-cases and splits letters from marks, one mark behind a letter is put apart and letters from A to Z are
    made small first, so that fewer strings are new.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.older = Tokenizer.from_file(path), {"": b""}, {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark, self.mark_id = next(((t.content, i) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), (None, None))

    def strings(self, text: str) -> Iterator[list[str]]:
        """The strings of a text between spaces and line feeds, of about ``SLICE_CHARS`` characters at a time."""
        at = 0
        while at < len(text):
            to = text.find(" ", at + SLICE_CHARS)
            to = len(text) if to < 0 else to
            yield text[at:to].replace("\n", " ").split(" ")
            at = to

    def learn(self, strings: set[str]) -> None:
        """Put the ids of all these strings in the table."""
        if len(self.kept) > MOST_KEPT:
            self.kept, self.older = {"": b""}, self.kept
        kept, older = self.kept, self.older
        new, made = [], []
        for s in strings.difference(kept):
            if (ids := older.get(s)) is not None:
                kept[s] = ids
                continue
            stem, end = (s[:-1], s[-1]) if s[-1] in ENDS and s[-2:-1].isalpha() else (s, "")
            if stem.isascii() and stem.isalpha():
                stem = stem.lower()
            if stem != s:
                made.append((s, stem, end))
                for part in (stem, end):
                    if part not in kept:
                        if (ids := older.get(part)) is not None:
                            kept[part] = ids
                        else:
                            new.append(part)
            else:
                new.append(s)
        new = set(new)
        apart = [s for s in new if self.mark is None or self.mark in s]
        for s, e in zip(apart, self.tokenizer.encode_batch(apart, add_special_tokens=False), strict=True):
            kept[s] = np.asarray(e.ids, "<u4").tobytes()
        together = [s for s in new if s not in kept]
        if together:
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.mark.join(together)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            data, at = ids.tobytes(), 0
            for s, to in zip(together, ends, strict=True):
                kept[s] = data[4 * at : 4 * to]
                at = to + 1
        for s, stem, end in made:
            kept[s] = kept[stem] + kept[end]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text. Texts that fit in one slice learn their strings together."""
        short = [next(self.strings(t), []) if t and len(t) <= SLICE_CHARS else None for t in texts]
        self.learn(set().union(*(s for s in short if s is not None)))
        for text, strings in zip(texts, short, strict=True):
            if strings is not None:
                yield b"".join(map(self.kept.__getitem__, strings))
            else:
                out = []
                for part in self.strings(text or ""):
                    known = set(part)
                    self.learn(known)
                    out.append(b"".join(map(self.kept.__getitem__, part)))
                if out:
                    self.learn(set().union(*(s for s in short if s is not None)))
                yield b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Rooms:
    """A tournament tree over bins: each node holds the largest room of the bins below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        """The first bin with room for ``need``; there is one."""
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            node += tree[node] < need
        return node - self.size

    def take(self, at: int, need: int) -> None:
        tree, node = self.tree, at + self.size
        tree[node] -= need
        while node := node // 2:
            tree[node] = max(tree[2 * node], tree[2 * node + 1])


def first_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers; ``sizes`` fall and none is above ``room``."""
    rooms, bins = Rooms(len(sizes), room), []
    for i, size in enumerate(sizes):
        at = rooms.first(size)
        rooms.take(at, size)
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def fill_up(bins: list[list[tuple[int, int, int]]], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length): the fullest are filled up from the emptiest, and what is left over at last
    is cut at powers of two."""
    load = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-load[i], i))
    bins, load = [list(bins[i]) for i in order], [load[i] for i in order]
    i, j = 0, len(bins) - 1
    while i < j:
        need = room - load[i]
        if not need:
            i += 1
            continue
        item, start, length = bins[j].pop()
        moved = min(need, length)
        bins[i].append((item, start + length - moved, moved))
        if moved < length:
            bins[j].append((item, start, length - moved))
        load[i], load[j] = load[i] + moved, load[j] - moved
        if not load[j]:
            j -= 1
    out, last = bins[:j], bins[j] if bins else []
    left = load[j] if bins else 0
    pieces = iter(last)
    item, start, length = next(pieces, (0, 0, 0))
    while left:
        part = 1 << (left.bit_length() - 1) if left < room else room
        left -= part
        sequence = []
        while part:
            if not length:
                item, start, length = next(pieces)
            cut = min(part, length)
            sequence.append((item, start, cut))
            part, start, length = part - cut, start + cut, length - cut
        out.append(sequence)
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_tokenizer()
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n, parts = docs.count(), partitions(spark)
    groups = max(1, -(-n // group_docs), min(parts, -(-n // LEAST_GROUP)))
    names = ["sent", "row", "ids", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext

        enc, row, full = encoder(path), TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() << 33
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            of, out = [], []
            for at, ids in enumerate(enc.encode(batch.column("text").to_pylist())):
                ids += end
                whole, tokens = len(ids) // (4 * length), len(ids) // 4
                for k in range(whole):
                    crc = zlib.crc32(memoryview(ids)[4 * length * k : 4 * length * (k + 1)])
                    of.append(at)
                    out.append((full, row, None, length * k, length, crc, tokens, 2 * full + 1, 0))
                    full += 1
                if len(ids) > 4 * length * whole:
                    of.append(at)
                    out.append((row, row, ids[4 * length * whole :], length * whole, tokens - length * whole, None, tokens, None, None))
                row += 1
            columns = list(zip(*out, strict=True))
            sent = (mix(np.array(columns[0], np.uint64) if columns else np.zeros(0, np.uint64)) % np.uint64(groups)).astype(np.int32)
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), batch.column("doc_id").take(pa.array(of))] + [pa.array(c, pa.int64()) for c in columns[3:]], names
                )

    def fill(batches):
        for table in sorted_groups(batches, "sent"):
            table = table.combine_chunks()
            sent = table.column("sent").to_numpy()
            for at in np.split(np.arange(len(sent)), np.flatnonzero(np.diff(sent)) + 1):
                yield packed(table.slice(int(at[0]), len(at)), int(sent[at[0]]))

    def packed(group: pa.Table, number: int) -> pa.RecordBatch:
        rest = group.filter(group.column("ids").is_valid())
        done = group.filter(group.column("ids").is_null()).select(names[3:])
        size, row = rest.column("length").to_numpy(), rest.column("row").to_numpy()
        order = np.lexsort((row, -size))
        bins = first_fit(size[order].tolist(), length)
        sequences = fill_up([[(int(order[i]), 0, int(size[order[i]])) for i in b] for b in bins], length)
        ids, begin, tokens = rest.column("ids").to_pylist(), rest.column("start").to_pylist(), rest.column("doc_tokens").to_pylist()
        of, out = [], []
        for k, sequence in enumerate(sequences):
            offset = 0
            for item, start, count in sequence:
                of.append(item)
                out.append((begin[item] + start, count, zlib.crc32(memoryview(ids[item])[4 * start : 4 * (start + count)]), tokens[item], 2 * ((number << 33) + k), offset))
                offset += count
        columns = list(zip(*out, strict=True)) or [()] * 6
        own = pa.Table.from_arrays([rest.column("doc_id").take(pa.array(of, pa.int64()))] + [pa.array(c, pa.int64()) for c in columns], names[3:])
        return pa.concat_tables([own, done]).combine_chunks().to_batches()[0]

    sent = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, SENT.format(kind=kind))
    dealt = sent.repartitionById(min(parts, groups), F.col("sent") % min(parts, groups)).sortWithinPartitions("sent")
    return dealt.mapInArrow(fill, PIECES.format(kind=kind))
