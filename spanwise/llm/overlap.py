"""Evaluation texts that also occur, exactly or almost, among training texts.

Two texts overlap when at least *threshold* of the distinct words of both
occur in both.  A text is normalised to its distinct words in sorted order,
between an opening and a closing mark; its passages are the pairs of neighbours
in this order.  With e words only in the evaluation text (of n) and t only in
the training text, at most 2e + t of its n + 1 passages are broken, and the
threshold bounds e and t.  So at least ``least_passages(n)`` passages of an
evaluation text occur in the training text, and HITS of them are among any
n + 1 - least_passages(n) + HITS of them: the rarest are taken.

The passages of the evaluation texts, in shards, make Aho-Corasick automata that
scan all training texts where they lie.  A training text that matches enough of the
rare passages of an evaluation text is a candidate; its matched intervals are
merged into the coverage of the evaluation text, which must hold enough
passages, before the words are compared.  Nothing is missed.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialise, parallelism
from .words import words

PASSAGES_PER_SHARD = 300_000
"""Passages of the evaluation texts of one shard: what goes through the driver at once, and into one automaton.
By estimate 30 MB and, with its lists, 150 MB; the automaton's nodes alone took 33 MB for 925,000 passages."""
SLOTS = 2**20
"""Passages are counted by slots, so that the counts that are broadcast (8 MB) do not grow with the data.  They rank passages,
and tell which no training text has."""
HITS = 2
"""Rare passages that must be met before a pair is looked at; ``least_passages`` is never less."""
OPEN, CLOSE = "\x02", "\x03"


def broken_most(n: int, threshold: Fraction) -> int:
    """Most passages of a text of *n* words that a text at the threshold can break:
    the largest 2e + t where (n - e) / (n + t) reaches the threshold."""
    return max(2 * e + math.floor((n - e) / threshold - n) for e in range(math.floor(n * (1 - threshold)) + 1))


@cache
def least_passages(n: int, threshold: Fraction) -> int:
    return max(1, n + 1 - broken_most(n, threshold))


def normal_form(text: str | None) -> str:
    return " ".join(sorted(set(words(text))))


def passages(norm: str) -> list[str]:
    ws = [OPEN, *norm.split(" "), CLOSE]
    return [f" {a} {b} " for a, b in zip(ws, ws[1:], strict=False)]


def coverage(found: list[int], n: int) -> float:
    """Share of the n words of a text inside the merged intervals of the passages at the places *found*, in order.
    Passage i covers word i - 1 and word i (the marks are no words)."""
    covered, end = 0, -1
    for i in found:
        first, last = max(i - 1, 0, end + 1), min(i, n - 1)
        covered += max(0, last - first + 1)
        end = max(end, last)
    return covered / n if n else 0.0


def text_classes(df: DataFrame) -> DataFrame:
    """(owner, field, cls, norm, n) from (owner, field, text), without a shuffle: texts without a word are left out, and
    repeats near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, tuple[str, int]] = {}
            known: dict[tuple, tuple[bytes, str, int]] = {}
            for owner, field, text in zip(*(batch.column(c).to_pylist() for c in ("owner", "field", "text")), strict=True):
                if (field, text) not in known:
                    norm = normal_form(text)
                    known[field, text] = xxhash.xxh3_128_digest(f"{field}\x00{norm}"), norm, len(norm.split(" ")) if norm else 0
                cls, norm, n = known[field, text]
                if n:
                    rows[owner, field, cls] = norm, n
            keys = list(zip(*rows, strict=True)) or [(), (), ()]
            values = list(zip(*rows.values(), strict=True)) or [(), ()]
            cols = zip((*keys, *values), (pa.string(), pa.string(), pa.binary(), pa.string(), pa.int32()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["owner", "field", "cls", "norm", "n"])

    return df.select("owner", "field", "text").mapInArrow(run, "owner string, field string, cls binary, norm string, n int")


def slot(passage: str) -> int:
    return zlib.crc32(passage.encode()) % SLOTS


def passage_counts(texts: DataFrame) -> np.ndarray:
    """How many of texts(norm) have a passage of each slot; combined before the shuffle, at most SLOTS rows."""
    ws = F.split("norm", " ")
    both = F.zip_with(F.concat(F.array(F.lit(OPEN)), ws), F.concat(ws, F.array(F.lit(CLOSE))), lambda a, b: F.crc32(F.concat(F.lit(" "), a, F.lit(" "), b, F.lit(" ")).cast("binary")))
    rows = texts.select(F.explode(both).alias("h")).groupBy((F.col("h") % SLOTS).cast("int").alias("slot")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def picks(norm: str, counts: np.ndarray, threshold: Fraction) -> tuple[list[int], list[int]]:
    """Places of the passages to look for, the rarest, and of those that some training text may have.  The
    former are [] where too few of them, or of all, are among the latter for a match."""
    often = [int(counts[slot(p)]) for p in passages(norm)]
    n = len(often) - 1
    least = least_passages(n, threshold)
    there = [i for i, m in enumerate(often) if m]
    if len(there) < least:
        return [], there
    chosen = sorted(range(n + 1), key=lambda i: (often[i], i))[: n + 1 - least + min(HITS, least)]
    chosen = [i for i in chosen if often[i]]
    return (chosen if len(chosen) >= min(HITS, least) else []), there


def _queries(texts: DataFrame, counts, threshold: Fraction) -> DataFrame:
    """(field, cls, norm, n, picks, there) of the evaluation texts that can match at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [picks(x, counts.value, threshold) for x in batch.column("norm").to_pylist()]
            keep = [i for i, (x, _) in enumerate(got) if x]
            lists = [pa.array([got[i][j] for i in keep], pa.list_(pa.int32())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, *lists], ["field", "cls", "norm", "n", "picks", "there"])

    return texts.select("field", "cls", "norm", "n").mapInArrow(run, "field string, cls binary, norm string, n int, picks array<int>, there array<int>")


class Shard(NamedTuple):
    automaton: ahocorasick.Automaton
    posting: list[list[int]]  # by passage: the evaluation texts that look for it
    own: list[list[tuple[int, int]]]  # by evaluation text: (place, passage) in order
    words: list[set[str]]
    least: list[int]
    cls: list[bytes]


def build(rows: list[tuple[bytes, str, list[int], list[int]]], threshold: Fraction) -> Shard:
    """One automaton of all passages that may occur, of the evaluation texts (cls, norm, picks, there)."""
    number: dict[str, int] = {}
    shard = Shard(ahocorasick.Automaton(), [], [], [], [], [])
    for e, (cls, norm, chosen, there) in enumerate(rows):
        every = passages(norm)
        own = [(i, number.setdefault(every[i], len(number))) for i in there]
        shard.posting.extend([] for _ in range(len(number) - len(shard.posting)))
        at = dict(own)
        for i in chosen:
            shard.posting[at[i]].append(e)
        shard.own.append(own)
        shard.words.append(set(norm.split(" ")))
        shard.least.append(least_passages(len(every) - 1, threshold))
        shard.cls.append(cls)
    for p, i in number.items():
        shard.automaton.add_word(p, i)
    shard.automaton.make_automaton()
    return shard


def matches(shard: Shard, norm: str, threshold: Fraction) -> Iterator[tuple[bytes, float, float]]:
    """(class, coverage, similarity) of the evaluation texts that the training text *norm* overlaps."""
    hits = {v for _, v in shard.automaton.iter(f" {OPEN} {norm} {CLOSE} ")}
    count = Counter(chain.from_iterable(map(shard.posting.__getitem__, hits)))
    if not count:
        return
    up, down = threshold.numerator, threshold.denominator
    theirs = set(norm.split(" "))
    m = len(theirs)
    # most are met once, which is enough for very short texts only
    for e in [e for e, times in count.items() if times >= HITS or times >= shard.least[e]]:
        ws = shard.words[e]
        n = len(ws)
        if min(n, m) * down < up * max(n, m):
            continue
        found = [i for i, p in shard.own[e] if p in hits]
        if len(found) < shard.least[e]:
            continue
        both = len(ws & theirs)
        if both * down >= up * (n + m - both):
            yield shard.cls[e], coverage(found, n), both / (n + m - both)


_built: dict[str, dict[str, Shard]] = {}


def _scan(name: str, content, threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            # one shard at a time in a process
            _built.clear()
            _built[name] = {field: build(rows, threshold) for field, rows in content.value.items()}
        for batch in batches:
            out: list[tuple] = []
            for field, cls, norm in zip(*(batch.column(c).to_pylist() for c in ("field", "cls", "norm")), strict=True):
                if field in _built[name]:
                    out += [(e, cls, share, alike) for e, share, alike in matches(_built[name][field], norm, threshold)]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], ["eval_cls", "train_cls", "coverage", "similarity"])

    return run


LINKS = "eval_cls binary, train_cls binary, coverage double, similarity double"


def overlaps(texts: DataFrame, sides: DataFrame, threshold: Fraction | str = "3/4") -> tuple[DataFrame, DataFrame]:
    """Returns (classes, links) from texts(owner, field, text) and sides(owner, side), where side is ``train`` or ``eval``.

    classes(owner, side, field, cls): one row for each owner, side and different text; equal normal forms
    are one class.  links(eval_cls, train_cls, coverage, similarity): all pairs of classes of one
    field, one of an evaluation text and one of a training text, that overlap.  Null texts, texts
    without a word, rows without owner, and owners of no or other sides match nothing; repeated rows change
    nothing.  A text may belong to any number of owners: it is scanned once.
    """
    spark, threshold = texts.sparkSession, Fraction(threshold)
    rows = materialise(text_classes(texts.where("owner IS NOT NULL AND text IS NOT NULL")))
    role = sides.where("owner IS NOT NULL AND side IN ('train', 'eval')").select("owner", "side").distinct()
    classes = materialise(rows.select("owner", "field", "cls").distinct().join(role, "owner").select("owner", "side", "field", "cls"))
    roles = classes.groupBy("cls").agg(F.max(F.col("side") == "train").alias("train"), F.max(F.col("side") == "eval").alias("eval"))
    # the one shuffle of texts, into as many files as there are tasks to scan them
    once = rows.select("field", "cls", "norm", "n").repartition(parallelism(spark), "cls").dropDuplicates(["cls"])
    once = materialise(once.join(roles, "cls").select("field", "cls", "norm", "n", "train", "eval"))
    train = once.where("train").select("field", "cls", "norm")
    counts = spark.sparkContext.broadcast(passage_counts(train))
    queries = materialise(_queries(once.where("eval"), counts, threshold))
    shards = max(1, math.ceil((queries.agg(F.sum(F.size("there"))).head()[0] or 0) / PASSAGES_PER_SHARD))
    links = spark.createDataFrame([], LINKS)
    for i in range(shards):
        own: dict[str, list] = {}
        for r in queries.where(F.pmod(F.hash("cls"), F.lit(shards)) == i).select("field", "cls", "norm", "picks", "there").toLocalIterator():
            own.setdefault(r["field"], []).append((bytes(r["cls"]), r["norm"], r["picks"], r["there"]))
        if own:
            content = spark.sparkContext.broadcast(own)
            found = materialise(train.mapInArrow(_scan(f"{spark.sparkContext.applicationId}-{content._jbroadcast.id()}", content, threshold), LINKS))
            links = links.unionByName(found)
            content.destroy()
    return classes, links
