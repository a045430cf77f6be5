"""Language ID (operator 10) by a linear-chain conditional random field.

Each word of a text gets a hidden language. Emission features of a word: its first and last one to four bytes (affixes),
its byte bigrams, trigrams and 4-grams with word edges, and a lexicon entry where the word is one of the fit's frequent
words; all are hashed into a table of ``2**TABLE_BITS`` rows of one weight per language, and transitions between
neighbouring words are learned with them. Prediction runs forward-backward exactly over the whole text and takes the
language with the largest mean posterior; that mean is the score.

The fit uses a documented, bounded sample: about ``SAMPLE_DOCS`` labelled rows chosen by a hash of the id, with their whole
texts. Training sequences splice passages of several sampled texts, so that changes of language inside a text are seen and transitions
are learned from them. The model is small (a fixed table) and broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0; words without a letter emit nothing and
take their language from their neighbours; of languages whose mean posteriors tie, the first by name is taken; if no row is labelled, every text is ``und``; repeated rows are predicted alike;
a text of any length is read whole; an empty table gives an empty one; columns lang_pred and score of the input are
replaced, all others are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import flat_bytes, mix, owners, range_hashes, sample, text_chunks, words

SAMPLE_DOCS = 1500
TABLE_BITS = 16
LEXICON = 2000
EPOCHS = 3
SEGMENT = 24
CHUNK_BYTES = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2**TABLE_BITS, labels)
    transitions: np.ndarray  # (labels, labels)
    lexicon: np.ndarray  # sorted hashes of frequent words


def _table_rows(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def word_hashes(joined: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with ASCII capitals lowered."""
    return range_hashes(np.where((joined >= 65) & (joined <= 90), joined + 32, joined), begins, ends)


def features(joined: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (feature rows, word of each), one kind of feature at a time: n-grams (words ascending), then affixes. ASCII
    capitals are lowered; the spaces around a word are its edges."""
    low = np.where((joined >= 65) & (joined <= 90), joined + 32, joined).astype(np.uint64)
    padded = np.concatenate([[np.uint64(32)], low, np.full(4, 32, np.uint64)])  # padded[i + 1] is joined[i]
    n, count = len(joined), len(begins)
    word_of = np.repeat(np.arange(count, dtype=np.int32), ends - begins + 1)  # the space after a word belongs to it
    left = np.repeat(ends.astype(np.int32), ends - begins + 1) - np.arange(n, dtype=np.int32)
    grams = padded[: n + 1].copy()
    for size in (2, 3, 4):
        grams = (grams[: n + 1] << np.uint64(8)) | padded[size - 1 : size + n]
        use = left >= size - 2  # ends at the space after the word at most
        yield _table_rows(grams[:n][use] * np.uint64(8) + np.uint64(size)), word_of[use]
    length = ends - begins
    for size in (1, 2, 3, 4):
        has = np.flatnonzero(length >= size)
        for tag, at in ((16, begins[has] + 1), (24, ends[has] + 1 - size)):
            code = np.zeros(len(has), np.uint64)
            for i in range(size):
                code = (code << np.uint64(8)) | padded[at + i]
            yield _table_rows(code * np.uint64(64) + np.uint64(tag + size)), has


def letter_words(joined: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether each word has a letter: A-Z, a-z, or, outside ASCII, a word that Python finds a letter in."""
    ascii_letter = ((joined | 32) >= 97) & ((joined | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    stops = np.concatenate([begins[1:], [len(joined)]])
    out = sums[stops] > sums[begins]
    high = np.concatenate([[0], np.cumsum(joined >= 128)])
    for i in np.flatnonzero(~out & (high[stops] > high[begins])).tolist():
        out[i] = any(c.isalpha() for c in joined[begins[i] : stops[i]].tobytes().decode("utf-8", "ignore"))
    return out


def emissions(model: Model, joined: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, labels) sums of feature weights; zero for words without a letter."""
    n, labels = len(begins), len(model.labels)
    out = np.zeros((n, labels), np.float32)
    for kind, (feature, word) in enumerate(features(joined, begins, ends)):
        if kind >= 3:
            out[word] += model.weights[feature]
        elif len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] += np.add.reduceat(model.weights[feature], first, axis=0)
    whole = word_hashes(joined, begins, ends)
    at = np.minimum(np.searchsorted(model.lexicon, whole), max(0, len(model.lexicon) - 1))
    if len(model.lexicon):
        known = np.flatnonzero(model.lexicon[at] == whole)
        out[known] += model.weights[_table_rows(whole[known])]
    out[~letter_words(joined, begins)] = 0
    return out


def text_emissions(model: Model, joined: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same, worked out once for each distinct word (case of ASCII letters aside)."""
    _, first, word = np.unique(word_hashes(joined, begins, ends), return_index=True, return_inverse=True)
    lengths = ends[first] - begins[first] + 1
    stops = np.cumsum(lengths)
    text = joined[np.repeat(begins[first] - (stops - lengths), lengths) + np.arange(stops[-1])]
    return emissions(model, text, stops - lengths, stops - 1)[word]


def forward_backward(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of every word and, if asked, summed expected transitions, for texts of ``counts`` words end to end.

    All texts advance together, the longest first, so step t works on those with more than t words; exact for any length.
    Messages are scaled every few steps and normalised at the end.
    """
    order = np.argsort(-counts, kind="stable")
    begin = np.cumsum(counts) - counts
    first, lengths = begin[order], counts[order]
    most = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(most), side="left").tolist()  # texts with more than t words
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(transitions - transitions.max())
    back_a = np.ascontiguousarray(a.T)
    forward, backward = np.empty_like(e), np.empty_like(e)
    now = np.ones((len(counts), scores.shape[1]))
    for t, n in enumerate(alive):
        at = first[:n] + t
        now = e[at] if t == 0 else (now[:n] @ a) * e[at]
        if t & 7 == 7:
            now /= now.max(axis=1, keepdims=True)
        forward[at] = now
    back = np.ones_like(e[: len(counts)])
    for t in range(most - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        live = back[:n]  # texts that end here still hold ones
        backward[at] = live
        live = (live * e[at]) @ back_a
        back[:n] = live if t & 7 else live / live.max(axis=1, keepdims=True)
    post = forward * backward
    post /= post.sum(axis=1, keepdims=True)
    if not pairs:
        return post, None
    later = np.ones(len(e), bool)
    later[begin] = False
    at = np.flatnonzero(later)
    joint = forward[at - 1][:, :, None] * a * (e[at] * backward[at])[:, None, :]
    return post, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Maximum likelihood by AdaGrad on spliced sequences of the sampled texts."""
    labels = sorted(set(langs))
    table = np.zeros((1 << TABLE_BITS, len(labels)), np.float32)
    model = Model(labels, table, np.zeros((len(labels), len(labels))), np.zeros(0, np.uint64))
    if len(labels) < 2:
        return model
    rng = np.random.default_rng(seed)
    data, offsets = flat_bytes(pa.array(texts, pa.string()))
    joined, begins, ends = words(data)
    owner = owners(data, offsets)
    gold_of = np.searchsorted(labels, langs)
    # segments of SEGMENT words; every word of the sampled texts is in one
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    segments = []
    for d, n in enumerate(counts.tolist()):
        segments += [(first[d] + s, min(SEGMENT, n - s), gold_of[d]) for s in range(0, n, SEGMENT)]
    segments = np.asarray(segments, np.int64)
    values, times = np.unique(word_hashes(joined, begins, ends), return_counts=True)
    model.lexicon = np.sort(values[np.argsort(-times, kind="stable")[:LEXICON]])
    squares, pair_squares = np.full_like(table, 1e-6), np.full_like(model.transitions, 1e-6)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(segments)), max(1, len(segments) // 256)):
            pick = segments[batch]
            w = np.concatenate([np.arange(s, s + n) for s, n, _ in pick])
            gold = np.repeat(pick[:, 2], pick[:, 1])
            spliced = np.add.reduceat(pick[:, 1], np.arange(0, len(pick), 3))  # three segments a sequence
            lengths = ends[w] - begins[w] + 1
            stops = np.cumsum(lengths)
            text = joined[np.repeat(begins[w] - (stops - lengths), lengths) + np.arange(stops[-1])]
            b, e = stops - lengths, stops - 1
            rows, hashes = list(features(text, b, e)), word_hashes(text, b, e)
            post, pairs = forward_backward(emissions(model, text, b, e), spliced, model.transitions, pairs=True)
            delta = (np.eye(len(labels))[gold] - post).astype(np.float32)
            delta[~letter_words(text, b)] = 0
            known = np.flatnonzero(np.isin(hashes, model.lexicon))
            rows.append((_table_rows(hashes[known]), known))
            feature = np.concatenate([r for r, _ in rows])
            word = np.concatenate([x for _, x in rows])
            gradient = np.stack([np.bincount(feature, delta[word, i], 1 << TABLE_BITS) for i in range(len(labels))], axis=1).astype(np.float32) / len(w) * 100
            squares += gradient**2
            table += 0.2 * gradient / np.sqrt(squares)
            inner = np.ones(len(w), bool)
            inner[np.cumsum(spliced) - 1] = False
            at = np.flatnonzero(inner)
            seen = np.zeros_like(pairs)
            np.add.at(seen, (gold[at], gold[at + 1]), 1)
            step = (seen - pairs) / len(w) * 100
            pair_squares += step**2
            model.transitions += 0.1 * step / np.sqrt(pair_squares)
    return model


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = flat_bytes(column)
    joined, begins, ends = words(data)
    owner = owners(data, offsets)
    n = len(column)
    names, scores = [UNKNOWN] * n, np.zeros(n)
    if not len(begins) or not model.labels:
        return names, scores
    spoken = np.bincount(owner, letter_words(joined, begins), n) > 0
    counts = np.bincount(owner, minlength=n)
    post, _ = forward_backward(text_emissions(model, joined, begins, ends), counts[counts > 0], model.transitions)
    mean = np.stack([np.bincount(owner, post[:, i], n) for i in range(post.shape[1])], axis=1) / np.maximum(counts, 1)[:, None]
    best = mean.argmax(axis=1)
    for i in np.flatnonzero(spoken).tolist():
        names[i], scores[i] = model.labels[best[i]], min(1.0, float(mean[i, best[i]]))
    return names, scores


def fit_sample(rows: DataFrame, key: Column, text: str = "text", lang: str = "lang", most: int = SAMPLE_DOCS) -> Model:
    """Fit on about ``most`` labelled rows (twice as many at the utmost), chosen by a hash of ``key``. The sample goes to one task,
    and only the model to the driver."""
    labelled = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key.cast("string").alias("key"), text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = [r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        drawn.sort(key=lambda r: (r[0] or "", r[1], r[2]))
        model = fit([r[1] for r in drawn], [r[2] for r in drawn])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = sample(labelled, F.col("key"), most).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit([], [])


def classify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (columns of those names are replaced)."""
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text, CHUNK_BYTES):
            names, scores = predict(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    out = df.select(*keep)
    schema = out.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return out.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def document_languages(documents: DataFrame) -> DataFrame:
    """The query: doc_id, held_out, lang_pred, score; learns from rows that are not held out."""
    key = F.col("doc_id")
    known = documents.where(F.coalesce(~held_out(key), F.lit(False)))
    model = fit_sample(known, key)
    return classify(documents.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "lang_pred", "score")
