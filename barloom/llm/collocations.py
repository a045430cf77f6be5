"""Phrase collocations (operator 12): frequent phrases level by level on a broadcast double-array trie.

Words are counted first. The words of at least ``LEAST`` occurrences (of one language: every language has its own numbers)
become the vocabulary, and one pass turns every text into a stream of word numbers, zero where a piece ends or a rare word
stands: no frequent phrase reaches across. For phrases of k words the trie of all frequent shorter ones is broadcast, and
NumPy moves the states of all positions of a block down the trie at once, one level after the other. A position whose first
k - 1 words and whose next k - 1 words are both accepted is a candidate that a frequent phrase can't miss (a phrase is at
most as frequent as its parts). Candidates are bin-counted within the task, and Spark sums the counts of all tasks.

What is broadcast is checked: a vocabulary of more than ``MOST_WORDS`` words, or more than ``MOST_PHRASES`` phrases, is not;
phrases of that length and longer are then counted as strings by a shuffle (``plain_counts``), which needs no table of all
phrases anywhere and gives the same result.

Each cut of a phrase is scored in exact decimals; ``f`` of both sides is found by joins of the frequent phrases only.

Defined results: a null text is empty, a null lang is ``und`` (with documents whose lang is that string); empty and blank
texts have no words; texts of any length are read in whole, in slices; repeated rows count each; scores of cuts that tie
go to the shorter first part; phrases that tie in score and count come in byte order; an empty table gives no rows; columns
besides lang and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialize

LEAST = 100
LONGEST = 5
TOP = 2000
INSIDE_PERCENT = 100
MOST_WORDS = 1_000_000
MOST_PHRASES = 2_000_000
UNKNOWN_LANG = "und"
SLICE_BYTES = 1 << 20
BLOCK_IDS = 1 << 20
FLUSH_WORDS = 500_000
FLUSH_CODES = 1 << 21
#: Slots of the trie for each node, so that small families of children find room after a few tries.
ROOM = 4
LARGE_FAMILY = 8

#: A-Z become a-z, every mark that ends a piece a comma, a tab a space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz,,,,,,,,, ")


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words, and ``,`` where a piece ends, of about ``SLICE_BYTES`` at a time."""
    data, at = (text or "").encode().translate(FOLD), 0
    while at < len(data):
        to = at + SLICE_BYTES
        to = min((x for x in (data.find(b" ", to), data.find(b",", to)) if x >= 0), default=len(data))
        yield data[at:to].replace(b",", b" , ").split()
        at = to


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, f of every word; docs have lang and text."""

    def count(batches):
        held: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                for part in tokens(text.as_py()):
                    own.update(part)
                    if len(own) > FLUSH_WORDS:
                        yield from counted(lang, own)
                        own.clear()
                size += len(own)
            if size > FLUSH_WORDS:
                for lang, own in held.items():
                    yield from counted(lang, own)
                held, size = {}, 0
        for lang, own in held.items():
            yield from counted(lang, own)

    def counted(lang: str, own: Counter) -> Iterator[pa.RecordBatch]:
        own.pop(b",", None)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "f"])

    return docs.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class Trie:
    """A double array over word numbers. The node of a single word is at the slot of its number; a further word takes two
    steps, by its number's quotient and remainder with ``radix``, so no node has more than ``radix`` children. The child of a
    node s by d is at ``base[s] + d`` if ``check`` there is s."""

    def __init__(self, words: int, phrases: list[np.ndarray]):
        """``phrases``: arrays of word numbers, one row a phrase, of 2 words, 3 words and so on, with all their beginnings."""
        self.radix = int(np.ceil(np.sqrt(words + 1)))
        self.tail = max(words + 1, self.radix)
        room = self.tail + 2 * self.radix + ROOM * 2 * sum(map(len, phrases))
        self.base, self.check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.check[: self.tail] = 0
        self.random = np.random.default_rng(5)
        for rows in phrases:
            parents = rows[:, 0].astype(np.int64)
            for i in range(1, rows.shape[1] - 1):
                parents = step(self.arrays(), parents, rows[:, i])
            both, which = np.unique(parents * self.radix + rows[:, -1] // self.radix, return_inverse=True)
            middle = self.add(both // self.radix, both % self.radix)
            self.add(middle[which], rows[:, -1] % self.radix)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, int]:
        return self.base, self.check, self.radix

    def grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) * 3 // 2) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def add(self, parents: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Put a child below each parent (all of a parent's at once); returns the children's slots."""
        order = np.lexsort((steps, parents))
        if not len(order):
            return order
        of, by = parents[order], steps[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sizes = np.diff(np.append(first, len(of)))
        family, bases = np.repeat(np.arange(len(first)), sizes), np.zeros(len(first), np.int64)
        low = int(self.tail)
        for i in np.argsort(-sizes, kind="stable"):
            if sizes[i] <= LARGE_FAMILY:
                break
            children = by[first[i] : first[i] + sizes[i]]
            tries = self.random.integers(low - self.radix, max(self.tail - self.radix, low - self.radix + 1), 48)
            fits = (self.check[tries[:, None] + children] < 0).all(axis=1)
            if fits.any():
                bases[i] = tries[fits.argmax()]
            else:
                bases[i] = self.tail
                self.tail += self.radix
                self.grow(self.tail + 2 * self.radix)
            self.check[bases[i] + children] = of[first[i]]
        waiting = sizes <= LARGE_FAMILY
        self.tail = max(self.tail, low + ROOM * int(sizes[waiting].sum()) + self.radix)
        self.grow(self.tail + 2 * self.radix)
        while waiting.any():
            bases[waiting] = self.random.integers(low, self.tail, int(waiting.sum()))
            rows = np.flatnonzero(waiting[family])
            slots = bases[family[rows]] + by[rows]
            _, which, times = np.unique(slots, return_inverse=True, return_counts=True)
            lost = np.zeros(len(first), bool)
            lost[family[rows[(self.check[slots] >= 0) | (times[which] > 1)]]] = True
            placed = ~lost[family[rows]]
            self.check[slots[placed]] = of[rows[placed]]
            waiting &= lost
        self.tail += self.radix  # children of the last bases
        self.base[of[first]] = bases
        out = np.zeros(len(order), np.int64)
        out[order] = bases[family] + by
        return out


def step(trie: tuple[np.ndarray, np.ndarray, int], states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states below ``states`` by ``words``; 0 where there is none. Neither holds a 0."""
    base, check, radix = trie
    middle = base[states] + words // radix
    end = base[middle] + words % radix
    return np.where((check[middle] == states) & (check[end] == middle), end, 0).astype(np.int64)


def advance(trie: tuple[np.ndarray, np.ndarray, int], ids: np.ndarray, depth: int) -> np.ndarray:
    """For each position the state of the phrase of ``depth`` words that begins there, 0 where it is not in the trie. All
    positions still alive take each level's step at once."""
    states = ids.astype(np.int64)
    for level in range(1, depth):
        at = np.flatnonzero(states[: max(0, len(states) - level)])
        at = at[ids[at + level] > 0]
        new = np.zeros(len(states), np.int64)
        new[at] = step(trie, states[at], ids[at + level])
        states = new
    return states


def encoded(docs: DataFrame, vocabulary: dict[str, dict[bytes, int]]) -> DataFrame:
    """Streams of word numbers: ``ids``, of which phrases begin at the first ``starts``; what follows is only looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches):
        parts, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                known = shared.value.get(lang)
                if known is None:
                    continue
                for part in tokens(text.as_py()):
                    ids = np.fromiter(map(known.get, part, repeat(0)), np.int32, len(part))
                    parts.append(ids)
                    size += len(ids)
                    if size >= BLOCK_IDS:
                        ids = np.concatenate(parts)
                        yield block(ids, len(ids) - LONGEST + 1)
                        parts = [ids[len(ids) - LONGEST + 1 :]]
                        size = len(parts[0])
                parts.append(np.zeros(1, np.int32))
                size += 1
        if size:
            yield block(np.concatenate(parts), size)

    def block(ids: np.ndarray, starts: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([starts], pa.int32())], ["ids", "starts"])

    return docs.mapInArrow(encode, "ids binary, starts int")


def candidate_counts(streams: DataFrame, trie: Trie, k: int) -> DataFrame:
    """ids (of k words, packed), f of every candidate of k words in the streams."""
    shared = streams.sparkSession.sparkContext.broadcast(trie.arrays())

    def count(batches):
        codes, rows, size = [], [], 0
        for batch in batches:
            for data, starts in zip(batch.column("ids"), batch.column("starts").to_pylist(), strict=True):
                ids = np.frombuffer(data.as_py(), np.int32)
                states = advance(shared.value, ids, k - 1)
                at = np.flatnonzero((states[: len(states) - 1] > 0) & (states[1:] > 0)) if len(ids) >= k else np.zeros(0, np.int64)
                at = at[at < starts]
                code, first, count = accepted(states[at] << 32 | ids[at + k - 1].astype(np.int64))
                codes.append((code, count))
                rows.append(ids[at[first][:, None] + np.arange(k)])
                size += len(code)
                if size > FLUSH_CODES:
                    yield summed(codes, rows)
                    codes, rows, size = [], [], 0
        if size:
            yield summed(codes, rows)

    def accepted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct extensions of the trie that a block accepts, where each comes first, and their bin counts."""
        found, first, bins = np.unique(code, return_index=True, return_inverse=True)
        return found, first, np.bincount(bins, minlength=len(found))

    def summed(codes: list, rows: list) -> pa.RecordBatch:
        found, first, bins = np.unique(np.concatenate([c for c, _ in codes]), return_index=True, return_inverse=True)
        count = np.bincount(bins, np.concatenate([n for _, n in codes]), len(found)).astype(np.int64)
        phrases = np.ascontiguousarray(np.concatenate(rows)[first], np.int32)
        data = pa.py_buffer(phrases.tobytes())
        packed = pa.Array.from_buffers(pa.binary(4 * k), len(found), [None, data]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([packed, pa.array(count)], ["ids", "f"])

    return streams.mapInArrow(count, "ids binary, f long").groupBy("ids").agg(F.sum("f").alias("f"))


def plain_counts(docs: DataFrame, k: int) -> DataFrame:
    """lang, phrase, f of every phrase of k words, by a shuffle of the phrases themselves."""

    def count(batches):
        for batch in batches:
            held: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                own, tail = held.setdefault(lang, Counter()), []
                for part in tokens(text.as_py()):
                    part = tail + part
                    own.update(b" ".join(x) for x in zip(*(part[i:] for i in range(k)), strict=False) if b"," not in x)
                    tail = part[len(part) - k + 1 :] if len(part) >= k else part
                    if len(own) > FLUSH_WORDS:
                        yield counted(lang, own)
                        own.clear()
            for lang, own in held.items():
                yield counted(lang, own)

    def counted(lang: str, own: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "f"])

    return docs.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, counts: DataFrame, least: int = LEAST, longest: int = LONGEST, most_words: int = MOST_WORDS, most_phrases: int = MOST_PHRASES) -> DataFrame:
    """lang, phrase, k, f of all phrases of 1 to ``longest`` words that occur ``least`` times; ``counts`` are all words'."""
    levels = [materialize(counts.where(F.col("f") >= least))]
    if levels[0].count() > most_words:
        levels += [plain_counts(docs, k).where(F.col("f") >= least) for k in range(2, longest + 1)]
    else:
        levels += _by_trie(docs, levels[0], least, longest, most_phrases)
    found = [x.select("lang", "phrase", F.lit(k).alias("k"), "f") for k, x in enumerate(levels, 1)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _by_trie(docs: DataFrame, words: DataFrame, least: int, longest: int, most_phrases: int) -> list[DataFrame]:
    known = words.select("lang", "phrase").toArrow()
    langs, phrases = known.column("lang").to_pylist(), known.column("phrase").to_pylist()
    vocabulary: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(zip(langs, phrases, strict=True), 1):
        vocabulary.setdefault(lang, {})[word.encode()] = i
    names = docs.sparkSession.sparkContext.broadcast((["", *langs], ["", *phrases]))

    def spell(batches):
        lang_of, word_of = names.value
        for batch in batches:
            rows = [np.frombuffer(x.as_py(), np.int32) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([pa.array([lang_of[r[0]] for r in rows], pa.string()), pa.array([" ".join([word_of[i] for i in r]) for r in rows], pa.string()), batch.column("f")], ["lang", "phrase", "f"])

    streams = materialize(encoded(docs, vocabulary))
    levels, held = [], []
    for k in range(2, longest + 1):
        packed = materialize(candidate_counts(streams, Trie(len(phrases), held), k).where(F.col("f") >= least))
        levels.append(packed.mapInArrow(spell, "lang string, phrase string, f long"))
        if k == longest:
            break
        if sum(map(len, held)) + packed.count() > most_phrases:
            return levels + [plain_counts(docs, j).where(F.col("f") >= least) for j in range(k + 1, longest + 1)]
        rows = packed.select("ids").toArrow().column("ids").to_pylist()
        held.append(np.frombuffer(b"".join(rows), np.int32).reshape(-1, k))
    return levels


def best_cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of several words by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = phrases.where(F.col("k") > 1).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("rest"))
    parts = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(totals, "lang").withColumns({"above": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")).cast("decimal(34,0)"), "below": (exact("l") * exact("r")).cast("decimal(38,0)")})
    cut = F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(cut).alias("least"))
    return least.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")


def outside(phrases: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of those of several words that lie in no longer one with ``percent`` of their occurrences. A phrase with one
    more word occurs at least as often as a longer one around it, so only those are looked at."""
    words = F.split("phrase", " ")
    inner = F.array(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1))
    longer = phrases.where(F.col("k") > 2).select("lang", "f", F.explode(inner).alias("words")).groupBy("lang", F.array_join("words", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = phrases.where(F.col("k") > 1).join(longer, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("f"))).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = INSIDE_PERCENT, lang_col: str = "lang", text_col: str = "text", **bounds) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_col).alias("text"))
    counts = materialize(word_counts(docs))
    phrases = materialize(frequent_phrases(docs, counts, least, longest, **bounds))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    found = best_cuts(phrases, totals).join(outside(phrases, percent), ["lang", "phrase"], "left_semi")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
with texts as (
  select doc, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from (select row_number() over () as doc, lang, text from documents)
), pieces as (
  select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as words
  from (select lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) as piece from texts)
), grams as (
  select lang, k, words[i:i + k - 1] as words
  from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from pieces, (select unnest([1, 2, 3, 4, 5]) as k) where len(words) >= k)
), counted as (
  select lang, k, words, count(*) as f from grams group by all
), totals as (
  select lang, cast(sum(f) as bigint) as n from counted where k = 1 group by lang
), frequent as (
  select * from counted where f >= 100
), cuts as (
  select p.lang, p.words, p.f as a, c.c, l.f as l, r.f as r, n, cast((1000::hugeint * p.f * n) // (l.f::hugeint * r.f) as bigint) as score
  from frequent p join (select unnest([1, 2, 3, 4]) as c) c on c.c < p.k
  join frequent l on l.lang = p.lang and l.words = p.words[1:c.c]
  join frequent r on r.lang = p.lang and r.words = p.words[c.c + 1:]
  join totals t on t.lang = p.lang where p.k > 1
), best as (
  select * from cuts qualify row_number() over (partition by lang, words order by score, c) = 1
), longer as (
  select lang, words[1:k - 1] as words, f from frequent where k > 2 union all select lang, words[2:], f from frequent where k > 2
  union all select lang, words[1:k - 2], f from frequent where k > 3 union all select lang, words[2:k - 1], f from frequent where k > 3 union all select lang, words[3:], f from frequent where k > 3
  union all select lang, words[i:i + 1], f from frequent, (select unnest([1, 2, 3, 4]) as i) where k = 5
), kept as (
  select * from best b where not exists (select 1 from longer o where o.lang = b.lang and o.words = b.words and 100 * o.f >= 100 * b.a)
), ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(words, ' ')) as rank, array_to_string(words, ' ') as phrase, a, l, r, n, score from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
