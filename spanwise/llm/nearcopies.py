"""Groups of nearly equal texts by Order MinHash.

A text is the sequence of its words; its k-mers are labelled with their
occurrence number.  Each of *bands* samples takes the *sample* smallest
labelled k-mers under its own hash and keeps them in text order, so that texts
agree in a sample when they share those k-mers in the same order.  Candidates
agree in a sample.  A third of the samples leave repeated k-mers out, for texts that
differ in how often a passage comes.  Common phrases fill some buckets with many texts: those are
not paired there, but by an exact prefix filter over the k-mers of the texts in
such buckets, the rarest first.  The exact share of common k-mers decides, as it
defines the pairs; a banded alignment gives their edit similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialise
from .words import words

HOT_SHARE = 1000
"""A k-mer is common, and then counted, from one text in so many of the crowded buckets.  There are at most HOT_SHARE times the
mean number of k-mers of a text, however many texts there are: the list that is broadcast is bounded.  It
orders k-mers, no more: the rarer come first, whatever counts as common."""
HOT_LEAST = 20
MOST_COMMON = 1_000_000
"""At most so many (16 MB) are broadcast, the most frequent: texts of very many k-mers have more."""
MOST_IN_BUCKET = 200
"""Texts of a larger bucket are paired by the prefix filter, which loses no pair."""
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


class Hasher:
    """Word hashes, remembered up to a bound: most words come back."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


class Texts:
    """The k-mers of many texts in one array, in text order; the texts have at least k words each."""

    def __init__(self, hashes: list[np.ndarray], k: int) -> None:
        sizes = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        x = flat[: max(0, len(flat) - k + 1)]
        for j in range(1, k):
            x = _mix(x) * np.uint64(31) + flat[j : len(flat) - k + 1 + j]
        last = np.repeat(np.cumsum(sizes) - k, sizes)[: len(x)]
        self.kmers = _mix(x[np.arange(len(x)) <= last])
        self.sizes = sizes - k + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known: tuple[np.ndarray, np.ndarray] | None = None

    def labelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The k-mers, where the second, third... occurrence of one in a text becomes a value of its
        own; and the number of different k-mers of each text."""
        if self.known is not None:
            return self.known
        x = self.kmers
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(x ^ _mix(owner.astype(np.uint64) + np.uint64(1)), kind="stable")
        s, o = x[order], owner[order]
        first = np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1]))) if len(s) else np.empty(0, bool)
        at = np.arange(len(s))
        number = at - np.maximum.accumulate(np.where(first, at, 0))
        out = x.copy()
        again = number > 0
        out[order[again]] = _mix(s[again] + number[again].astype(np.uint64))
        self.known = out, np.bincount(o[first], minlength=len(self.sizes))
        return self.known


POSITION_BITS = 24
_FILTER_BITS = np.uint64(2**20 - 1)


def is_among(x: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array *hot*; a bitmap rules out most before the search."""
    out = np.zeros(len(x), bool)
    if len(hot):
        bitmap = np.zeros(int(_FILTER_BITS) + 1, bool)
        bitmap[hot & _FILTER_BITS] = True
        at = np.flatnonzero(bitmap[x & _FILTER_BITS])
        out[at] = hot[np.minimum(np.searchsorted(hot, x[at]), len(hot) - 1)] == x[at]
    return out


def seeds(bands: int) -> np.ndarray:
    return _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(texts: Texts, sample: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(one value per text and band, number of different k-mers of each text).

    A hash keeps 40 bits above the position in the text.  The last third of the bands is over the
    first occurrences of k-mers only; where none repeats, it is like the others.
    """
    x, distinct = texts.labelled()
    position = np.arange(len(x), dtype=np.uint64) - np.repeat(texts.starts, texts.sizes).astype(np.uint64)
    # the same bits for all texts, but for longer ones than there are
    bits = max(POSITION_BITS, int(texts.sizes.max(initial=0)).bit_length())
    mask = np.uint64(2**bits - 1)
    keep = ~mask
    again = x != texts.kmers
    out = np.empty((len(texts.sizes), bands), np.uint64)
    none = np.uint64(2**64 - 1)
    for band, seed in enumerate(seeds(bands)):
        g = (_mix(x ^ seed) & keep) | position
        if band >= bands - bands // 3:
            g[again] = none
        picked = np.full((sample, len(texts.sizes)), np.iinfo(np.int64).max, np.int64)
        for j in range(sample):
            least = np.minimum.reduceat(g, texts.starts)
            there = least != none
            at = texts.starts + (least & mask).astype(np.int64)
            picked[j, there] = at[there]
            g[at[there]] = none
        picked.sort(axis=0)
        value = np.full(len(texts.sizes), seed)
        for j in range(sample):
            has = picked[j] < len(x)
            value[has] = _mix(value[has]) * np.uint64(31) + x[picked[j, has]]
        out[:, band] = _mix(value)
    return out, distinct


MARK_BITS = 128


def marks(texts: Texts) -> np.ndarray:
    """Two values per text: bit i tells whether an odd number of its different k-mers falls to i.  Two texts
    differ in at least as many k-mers as their marks do in bits."""
    first = texts.labelled()[0] == texts.kmers
    owner = np.repeat(np.arange(len(texts.sizes)), texts.sizes)[first]
    bit = (texts.kmers[first] >> np.uint64(57)).astype(np.int64)
    odd = np.bincount(owner * MARK_BITS + bit, minlength=len(texts.sizes) * MARK_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, MARK_BITS), axis=1).view(np.uint64)


def prefixes(texts: Texts, hot: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, k-mer, its place, number of different k-mers of the text): the first k-mers of each text, rarest first.

    The order is the same for all texts: by *counts* of the sorted *hot*, 0 for others, then by value.  Two
    texts that share *threshold* of their k-mers share one of those returned here, whatever the counts.
    """
    x = texts.kmers
    owner = np.repeat(np.arange(len(texts.sizes)), texts.sizes)
    often = np.zeros(len(x), np.int64)
    common = is_among(x, hot)
    often[common] = counts[np.searchsorted(hot, x[common])]
    order = np.lexsort((x, often, owner))
    x, owner = x[order], owner[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[first], owner[first]
    n = np.bincount(owner, minlength=len(texts.sizes))
    place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    shared = np.maximum(1, np.ceil(threshold * n - 1e-6)).astype(np.int64)
    keep = place <= (n - shared)[owner]
    return owner[keep], x[keep], place[keep], n[owner[keep]]


def aligned_share(a: list[str], b: list[str], band: int) -> float:
    """Edit similarity by insertions and deletions, 2 L / (|a| + |b|), where L is the longest common
    subsequence whose matches lie within *band* of the main diagonal (scaled); bit-parallel."""
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, scale, reach = full, len(a) / len(b), (1 << (2 * band + 1)) - 1
    for j, w in enumerate(b):
        m = where.get(w, 0)
        if m:
            low = int(j * scale) - band
            m &= reach << low if low >= 0 else reach >> -low
            u = v & m
            v = ((v + u) | (v - u)) & full
    return 2.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def _text_class(ws: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(ws))


def _parts(hashes: list[np.ndarray], most: int = 300_000) -> Iterator[list[np.ndarray]]:
    """Runs of texts of about *most* words together, so that a batch of long texts fits in memory."""
    part: list[np.ndarray] = []
    size = 0
    for h in hashes:
        part.append(h)
        size += len(h)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _survey(df: DataFrame, k: int, sample: int, bands: int, min_words: int) -> DataFrame:
    """(key, cls) of each row that takes part, where cls is the class of equal word sequences; and, with a null key, (cls, n, m0, m1,
    buckets) of each class of a batch: its number of distinct k-mers, its marks, and one bucket per sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keys, classes, new = [], [], {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                if len(ws) < min_words:
                    continue
                cls = _text_class(ws)
                keys.append(key)
                classes.append(cls)
                if cls not in new:
                    new[cls] = hasher(ws)
            none = pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(classes, pa.binary()), none(len(keys), pa.int32()), none(len(keys), pa.int64()), none(len(keys), pa.int64()), none(len(keys), pa.list_(pa.int64()))], NAMES)
            at, names = 0, list(new)
            for part in _parts(list(new.values())):
                own = Texts(part, k)
                values, n = sketches(own, sample, bands)
                m = marks(own).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bands), pa.int32()), pa.array(values.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([none(len(part), pa.string()), pa.array(names[at : at + len(part)], pa.binary()), pa.array(n, pa.int32()), pa.array(m[:, 0]), pa.array(m[:, 1]), lists], NAMES)
                at += len(part)

    return df.mapInArrow(run, "key string, cls binary, n int, m0 bigint, m1 bigint, buckets array<bigint>")


NAMES = ["key", "cls", "n", "m0", "m1", "buckets"]


def _common(texts: DataFrame, k: int) -> DataFrame:
    """(kmer, n): how often a k-mer is in texts(cls, text), counted in the batches where it is in one of HOT_SHARE texts and in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in _parts([hasher(t.split(" ")) for t in batch.column(1).to_pylist()], 1_500_000):
                u, c = np.unique(Texts(part, k).kmers, return_counts=True)
                often = c >= max(2, len(part) // HOT_SHARE)
                yield pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(c[often], pa.int64())], ["kmer", "n"])

    return texts.select("cls", "text").mapInArrow(run, "kmer bigint, n bigint").groupBy("kmer").agg(F.sum("n").alias("n"))


def _prefixes(df: DataFrame, hot, k: int, threshold: float) -> DataFrame:
    """(cls, kmer, place, n, m0, m1) of texts whose words are separated by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            at, names = 0, batch.column(0)
            for part in _parts([hasher(t.split(" ")) for t in batch.column(1).to_pylist()]):
                own = Texts(part, k)
                text, kmer, place, n = prefixes(own, *hot.value, threshold)
                m = marks(own).view(np.int64)[text]
                cls = names.slice(at, len(part)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([cls, pa.array(kmer.view(np.int64)), pa.array(place, pa.int32()), pa.array(n, pa.int32()), pa.array(m[:, 0]), pa.array(m[:, 1])], ["cls", "kmer", "place", "n", "m0", "m1"])
                at += len(part)

    return df.mapInArrow(run, "cls binary, kmer bigint, place int, n int, m0 bigint, m1 bigint")


def _shared(df: DataFrame, by: str) -> DataFrame:
    """*df* with the number of rows of the same *by*, where it is more than one: most hold one class and need no join.
    Counted before the shuffle and joined, so that the rows of a hot value are spread over tasks."""
    counts = df.groupBy(by).agg(F.count("*").alias("size")).where("size > 1")
    return df.join(counts, by)


def _side(df: DataFrame, by: str, s: str) -> DataFrame:
    return df.select(by, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != by])


def near_pairs(df: DataFrame, key: str, text: str, *, k: int = 5, threshold: float = 0.8, min_words: int = 15, sample: int = 2, bands: int = 24) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequences, and pairs of classes whose k-mers agree.

    Returns (members, links): members(key, cls), one row per key and class; links(cls_a, cls_b,
    jaccard, edit_similarity), one row per pair of different classes of which at least *threshold*
    of the distinct k-mers of both occur in both.  Copies of a text are one class, so a text that is
    delivered a million times costs one.  Texts of fewer than *min_words* words, null and empty ones
    take no part; null keys neither; other columns are ignored; a key with several texts is in several
    classes.  A pair is missed with a chance of about (1 - q * j**sample)**bands, where j is the share of
    occurrence-labelled k-mers in both, lower than that of distinct ones where texts differ in how often
    a passage repeats, and q the share of samples in the same order, 1 unless blocks are moved.
    """
    spark, least = df.sparkSession, max(min_words, k)
    src = df.select(df[key].cast("string").alias("key"), df[text].cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    survey = materialise(_survey(src, k, sample, bands, least))
    members = survey.where("key IS NOT NULL").select("key", "cls").distinct()
    each = survey.where("key IS NULL").select("cls", "n", "m0", "m1", "buckets").dropDuplicates(["cls"])
    shared = _shared(each.select("cls", F.explode(F.array_distinct("buckets")).alias("bucket")), "bucket")
    # few buckets have two texts: only what these need is carried along
    rows = materialise(shared.join(each.drop("buckets"), "cls"))
    small = rows.where(F.col("size") <= MOST_IN_BUCKET).drop("size")
    differ = sum(F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b"))) for i in range(2))
    alike = (F.col("cls_a") < F.col("cls_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9)) & (differ <= (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6)
    sampled = materialise(_side(small, "bucket", "a").join(_side(small, "bucket", "b"), "bucket").where(alike).select("cls_a", "cls_b").distinct())
    crowded = rows.where(F.col("size") > MOST_IN_BUCKET).select("cls").distinct()

    ends = sampled.select(F.explode(F.array("cls_a", "cls_b")).alias("cls"), F.lit(False).alias("crowded"))
    wanted = ends.unionByName(crowded.withColumn("crowded", F.lit(True))).groupBy("cls").agg(F.max("crowded").alias("crowded"))
    speakers = members.join(wanted, "cls").groupBy("cls", "crowded").agg(F.min("key").alias("key"))
    texts = materialise(_texts_of(src.join(speakers, "key").select("cls", "text", "crowded")))

    dense = texts.where("crowded").select("cls", "text")
    often = max(HOT_LEAST, dense.count() // HOT_SHARE)
    common = _common(dense, k).where(F.col("n") >= often).orderBy(F.col("n").desc(), "kmer").limit(MOST_COMMON).toPandas()
    kmers = common["kmer"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(kmers)
    hot = spark.sparkContext.broadcast((kmers[order], common["n"].to_numpy(np.int64)[order]))
    first = materialise(_shared(materialise(_prefixes(dense, hot, k, threshold)), "kmer").drop("size"))
    # one of the k-mers that both prefixes hold is the first that the texts share: they share no more than what follows it
    enough = 1 + F.least(F.col("n_a") - 1 - F.col("place_a"), F.col("n_b") - 1 - F.col("place_b")) >= (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-6
    exact = _side(first, "kmer", "a").join(_side(first, "kmer", "b"), "kmer").where(alike & enough).select("cls_a", "cls_b")
    candidates = materialise(sampled.unionByName(exact).distinct())
    sides = [texts.select(F.col("cls").alias(f"cls_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab"]
    links = _verify(candidates.join(sides[0], "cls_a").join(sides[1], "cls_b").select("cls_a", "cls_b", "text_a", "text_b"), k, threshold)
    return members, links


def _texts_of(df: DataFrame) -> DataFrame:
    """(cls, text, crowded) once per class, where the text is of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = {}
            for cls, text, crowded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws = words(text)
                if _text_class(ws) == bytes(cls):
                    good[bytes(cls)] = " ".join(ws), crowded
            text, crowded = zip(*good.values(), strict=True) if good else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(good), pa.binary()), pa.array(text, pa.string()), pa.array(crowded, pa.bool_())], ["cls", "text", "crowded"])

    return df.mapInArrow(run, "cls binary, text string, crowded boolean").dropDuplicates(["cls"])


def _verify(df: DataFrame, k: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ca, cb, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = ta.split(" "), tb.split(" ")
                x, y = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (a, b))
                both = len(x & y)
                if both and both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    # the band holds every alignment that the threshold allows; a moved block lies outside
                    band = max(8, int(max(len(a), len(b)) * (1 - threshold)) + abs(len(a) - len(b)))
                    out.append((ca, cb, both / (len(x) + len(y) - both), aligned_share(a, b, band)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], ["cls_a", "cls_b", "jaccard", "edit_similarity"])

    return df.mapInArrow(run, "cls_a binary, cls_b binary, jaccard double, edit_similarity double")


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs of keys behind links, and those of equal texts.
    Their number is that of the pairs that are asked for; use ``groups`` where copies abound."""
    m = lambda s: members.select(F.col("key").alias(f"key_{s}"), F.col("cls").alias(f"cls_{s}"))
    across = links.join(m("a"), "cls_a").join(m("b"), "cls_b").select("key_a", "key_b")
    several = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    own = members.join(several, "cls")
    same = own.select("cls", F.col("key").alias("key_a")).join(own.select("cls", F.col("key").alias("key_b")), "cls").select("key_a", "key_b")
    pairs = across.unionByName(same).where("key_a <> key_b")
    return pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, group_id, n_links): one row per key that took part.  Keys of equal or linked texts share a
    group, named by its smallest key; n_links counts the different texts that the key's text is linked to."""
    from ..operators.components import connected_components

    links = materialise(links)
    comp = connected_components(links.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
    ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    rooted = members.join(comp.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(ends, "cls", "left")
    names = rooted.groupBy("root").agg(F.min("key").alias("group_id"))
    # a key with several texts has one row: its smallest group, its links together
    return rooted.join(names, "root").groupBy("key").agg(F.min("group_id").alias("group_id"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"))
