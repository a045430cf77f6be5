"""Byte-level BPE encoding and decoding (operator 2).

Texts are encoded by the tiktoken library with a local rank file. Long texts are cut first at safe boundaries: places
where a character that is not white space meets a space or newline. No match of the splitting pattern spans such a place
and its look-ahead never looks past one, so pieces encode as the whole text does. Runs of ``LONG_RUN`` white-space characters
or more, on which the library's matcher fails from a million on, are matched here: all but the last character where another
follows the run, else all of it; that match is merged without the matcher.

Defined results: a null text encodes as the empty text (no ids, no bytes); repeated rows are encoded each on their own;
a null id list decodes to null; an empty table gives no rows; other columns pass through unless they clash with an output column, which replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_chunks

#: Texts longer than this many characters are cut; no piece is cut where that is not safe.
PIECE_CHARS = 50_000
CHUNK_BYTES = 2 << 20
_SAFE = re.compile(r"(?<=\S)[ \n]")
LONG_RUN = 10_000
#: White space as the splitting pattern has it; Python's own class holds four control characters more.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Looked for from a run's first character alone, so that a run that is too short is read once.
_LONG = re.compile(rf"(?<!{_SPACE}){_SPACE}{{{LONG_RUN},}}")


def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; loaded once per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Cut ``text`` at safe boundaries into pieces of about ``most`` characters."""
    out, at = [], 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def encode_text(text: str, rank_file: str, pattern: str) -> list[int]:
    enc = encoding(rank_file, pattern)
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in _LONG.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += [i for piece in pieces(text[at : run.start()]) for i in enc.encode_ordinary(piece)]
        out += enc._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + [i for piece in pieces(text[at:]) for i in enc.encode_ordinary(piece)]


#: What a round trip can give for each text, with its Spark and Arrow types.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("binary", pa.binary()),
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def _outputs(text: str, rank_file: str, pattern: str, wanted: tuple[str, ...]) -> list:
    ids = np.asarray(encode_text(text, rank_file, pattern), "<u4")
    decoded = encoding(rank_file, pattern).decode_bytes(ids.tolist())
    make = {
        "ids": lambda: ids.astype(np.int32),
        "decoded": lambda: decoded,
        "n_tokens": lambda: len(ids),
        "ids_sha256": lambda: hashlib.sha256(ids.tobytes()).hexdigest(),
        "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest(),
    }
    return [make[name]() for name in wanted]


def round_trip(
    df: DataFrame, text: str = "text", rank_file: str | None = None, pattern: str | None = None, wanted: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """``df`` with token ids (``ids``), the bytes that they decode to (``decoded``), or any other of ``OUTPUTS``.

    ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` are made beside
    the texts, so that neither ids nor bytes need to leave the Python worker when only these are wanted.
    """
    rank_file, pattern = rank_file or default_rank_file(), pattern or default_pattern()
    kept = [c for c in df.columns if c not in wanted]
    source, at = df.select(*kept), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text, CHUNK_BYTES):
            made = [_outputs(t or "", rank_file, pattern, wanted) for t in batch.column(at).to_pylist()]
            columns = [pa.array([row[i] for row in made], OUTPUTS[name][1]) for i, name in enumerate(wanted)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *wanted])

    schema = source.withColumns({name: F.lit(None).cast(OUTPUTS[name][0]) for name in wanted}).schema
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with the bytes (binary) of a column of token ids; bytes need not be valid UTF-8."""
    rank_file, pattern = rank_file or default_rank_file(), pattern or default_pattern()

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        enc = encoding(rank_file, pattern)
        return pd.Series([None if x is None else enc.decode_bytes(x.tolist()) for x in lists], dtype=object)

    return df.withColumn(into, run(F.col(ids)))


def digests(documents: DataFrame) -> DataFrame:
    """The query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256")
    return round_trip(documents.select("doc_id", "text"), wanted=wanted).select("doc_id", *wanted)
