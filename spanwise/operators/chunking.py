"""Cutting documents into chunks with stable positions and ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK = "chunk_id string, doc_id string, text string, char_start int, char_end int, heading_path array<string>, token_count int"


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of windows of *size*; the last is the first to reach the end."""
    step = size - overlap
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - size) / step)).cast("int")), lambda i: i * step)


def fixed_size(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of *size* code points, *overlap* shared with the one before.

    docs(doc_id, body).  Blank windows, null and empty bodies give no chunk.  Equal texts of a
    document share a chunk_id.  No shuffle and no Python: one narrow stage.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("body").alias("_body")).where("_body IS NOT NULL")
    cut = own.select("doc_id", "_body", F.length("_body").alias("_n"), F.explode(window_starts(F.length("_body"), size, overlap)).alias("char_start"))
    piece = cut.select("doc_id", "char_start", F.least(F.col("char_start") + size, F.col("_n")).alias("char_end"), F.expr(f"substring(_body, char_start + 1, {size})").alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    return piece.select(T.content_id("doc_id", "text").alias("chunk_id"), "doc_id", "text", "char_start", "char_end", F.array().cast("array<string>").alias("heading_path"), T.approx_tokens("text").alias("token_count"))


#: A heading: up to six marks, white space (which may run into the next line), a title.  Fixed value.
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*$", re.MULTILINE)


def break_places(body: str, start: int, end: int, most: int) -> list[int]:
    """Ends of parts of body[start:end] of at most *most*: at the last blank line of the window; where
    that would cut a table (four bars or more behind it), at the blank line before, if there is one."""
    ends, at = [], start
    while end - at > most:
        cut = body.rfind("\n\n", at, at + most)
        if cut > at and body.count("|", cut, at + most) >= 4:
            before = body.rfind("\n\n", at, cut)
            cut = before if before > at else cut
        at = cut if cut > at else at + most
        ends.append(at)
    return [*ends, end] if end > at else ends


def structure(body: str, most: int = 1200, least: int = 120) -> list[tuple[int, int, list[str]]]:
    """(start, end, heading path) of the chunks of a Markdown body that has headings; [] if it has none.

    A section runs from a heading to the next; text before the first heading is left out.  A section
    shorter than *least* is joined to the chunk before, whose path stays; a longer one than *most* is cut.
    """
    heads = [(m.start(), len(m[1]), m[2]) for m in HEADING.finditer(body)]
    out: list[tuple[int, int, list[str]]] = []
    levels: list[str] = []
    ends = [h[0] for h in heads[1:]] + [len(body)]
    for (start, level, title), end in zip(heads, ends, strict=False):
        levels = (levels + [""] * 6)[: level - 1] + [title]
        path = [x for x in levels if x]
        if not body[start:end].strip():
            continue
        if out and end - start < least:
            first, _, kept = out[-1]
            out[-1] = (first, end, kept)
            continue
        at = start
        for cut in break_places(body, start, end, most):
            if body[at:cut].strip():
                out.append((at, cut, path))
            at = cut
    return out


def markdown(docs: DataFrame, most: int = 1200, least: int = 120) -> DataFrame:
    """Chunks along the headings of docs(doc_id, body); bodies without headings in windows of *most*.

    The walk over a document's headings is sequential, so it runs per document in Arrow batches, without
    a shuffle; ids and token counts are expressions.  Null and empty bodies give no chunk.
    """
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("body").alias("body")).where("body IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, b[s:e], s, e, p) for d, b in zip(pdf["doc_id"], pdf["body"], strict=True) for s, e, p in _chunks(b)]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "char_start", "char_end", "heading_path"])

    def _chunks(body: str) -> list[tuple[int, int, list[str]]]:
        if HEADING.search(body):
            return structure(body, most, least)
        return [(s, min(s + most, len(body)), []) for s in range(0, len(body), most) if body[s : s + most].strip()]

    cut = own.mapInPandas(run, "doc_id string, text string, char_start int, char_end int, heading_path array<string>")
    return cut.select(T.content_id("doc_id", "text").alias("chunk_id"), "doc_id", "text", "char_start", "char_end", "heading_path", T.approx_tokens("text").alias("token_count"))


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed_size": fixed_size, "markdown_structure": markdown}
_OPTIONS = {"fixed_size": {"chunk_size": "size", "chunk_overlap": "overlap"}, "markdown_structure": {"max_chars": "most", "min_chars": "least"}}


def build_chunker(kind: str, **options: int) -> Callable[[DataFrame], DataFrame]:
    """The chunker of a configuration; options of other chunkers are ignored."""
    if kind not in CHUNKERS:
        raise ValueError(f"unknown chunker: {kind!r}")
    own = {_OPTIONS[kind][k]: int(v) for k, v in options.items() if k in _OPTIONS[kind]}
    return lambda docs: CHUNKERS[kind](docs, **own)
