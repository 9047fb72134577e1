"""Encoding texts with a public byte-level BPE given as a tiktoken rank file.

The rank file's place is a parameter (or SPANWISE_TOKENIZERS).  Its content
travels to the workers as a broadcast: the size is that of the vocabulary, not
of the data.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_FOLDER = "/opt/tokenizers"
#: The pattern that splits text before the merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places where PATTERN ends one match and begins another whatever stands around them: before a
#: single blank between two visible characters, and between a letter and a digit.  The latter
#: holds after an apostrophe too, since contractions have letters only.
SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
LONG_TEXT = 65_536

_encodings: dict[int, object] = {}


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("SPANWISE_TOKENIZERS", DEFAULT_FOLDER), f"{name}.tiktoken")


def build_encoding(content: bytes):
    """A tiktoken encoding from a rank file's content, built once per process."""
    key = hash(content)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _encodings[key] = tiktoken.Encoding("rank_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def safe_parts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """*text* in parts of about *size* that encode to the same ids as the whole.

    Parts end at the first safe place after *size* characters; a text without one stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding, text: str | None) -> list[int]:
    """Ids without special tokens; an empty list for an empty or null text."""
    if not text:
        return []
    if len(text) <= LONG_TEXT:
        return encoding.encode_ordinary(text)
    return [i for part in safe_parts(text) for i in encoding.encode_ordinary(part)]


def encode(df: DataFrame, key: str, text: str, ranks: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): one row for each row of *df*, in no order.

    An empty or null text gives an empty list; blanks are text.  Other columns of *df* are
    neither read nor returned.  No shuffle; each task encodes the rows it scans.
    """
    content = df.sparkSession.sparkContext.broadcast(open(ranks or rank_file(), "rb").read())
    src = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = build_encoding(content.value)
        for batch in batches:
            ids = [encode_text(encoding, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count(df: DataFrame, key: str, text: str, ranks: str | None = None) -> DataFrame:
    """(key, n_tokens BIGINT): as ``encode``, with the number of ids only; 0 for empty and null."""
    content = df.sparkSession.sparkContext.broadcast(open(ranks or rank_file(), "rb").read())
    src = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = build_encoding(content.value)
        for batch in batches:
            sizes = [len(encode_text(encoding, t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    return src.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decode(df: DataFrame, key: str, ids: str, ranks: str | None = None) -> DataFrame:
    """(key, raw BINARY, text STRING): the bytes of each list of ids; *text* is null where they are
    not valid UTF-8 (a list may end inside a character) or where an id is unknown.  A null list gives
    nulls, an empty one empty values."""
    content = df.sparkSession.sparkContext.broadcast(open(ranks or rank_file(), "rb").read())
    src = df.select(df[key].alias("key"), df[ids].cast("array<int>").alias("ids"))
    kind = src.schema["key"].dataType.simpleString()

    def one(encoding, x: list[int] | None) -> tuple[bytes | None, str | None]:
        if x is None:
            return None, None
        try:
            raw = encoding.decode_bytes(x)
        except (KeyError, OverflowError, TypeError):
            return None, None
        try:
            return raw, raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = build_encoding(content.value)
        for batch in batches:
            both = [one(encoding, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in both], pa.binary()), pa.array([t for _, t in both], pa.string())], [key, "raw", "text"])

    return src.mapInArrow(run, f"`{key}` {kind}, raw binary, text string")
