"""Vectors for texts: TF-IDF reduced by a truncated SVD, and a cache by content.

The SVD is a block power iteration: each pass over the texts gives the product
of the Gram matrix with a thin block, as a sum over tasks.  What reaches the
driver is features x components numbers, whatever the number of texts.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import short_hash
from ..errors import ConfigError

_WORD = regex.compile(r"\b\w\w+\b")
BLOCK, PARTS = 256, 64


def terms(text: str | None) -> list[str]:
    """Words of two characters or more and pairs of neighbours, in lower case and without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    ws = _WORD.findall(plain)
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def features(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, counts) of hashed terms."""
    c = Counter(xxhash.xxh3_64_intdigest(t) % n for t in terms(text))
    return np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), float, len(c))


class TfidfSvd:
    """Fitted weights: idf (features) and basis (features x dimension)."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, seed: int) -> None:
        self.idf, self.basis, self.seed = idf, basis, seed

    @property
    def dimension(self) -> int:
        return self.basis.shape[1]

    @property
    def fingerprint(self) -> str:
        return f"tfidf_svd:d{self.dimension}:seed{self.seed}:fit{short_hash([round(float(x), 6) for x in self.idf], 16)}"

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at, f = features(text, len(self.idf))
        w = (1.0 + np.log(f)) * self.idf[at] if len(at) else f
        norm = np.sqrt((w * w).sum())
        return at, w / norm if norm > 0 else w

    def vector(self, text: str | None) -> np.ndarray:
        """Unit length; zeros for a text without a term."""
        at, w = self.row(text)
        v = w @ self.basis[at] if len(at) else np.zeros(self.dimension)
        return (v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32)


def fit_tfidf_svd(texts: DataFrame, dimension: int = 256, seed: int = 20260806, n_features: int = 4096, passes: int = 3) -> TfidfSvd:
    """Fit on all rows of texts(text).  The same texts and seed give the same weights up to the sign of a component."""
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    n = texts.count()

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            df = np.zeros(n_features, np.int64)
            for t in pdf["text"]:
                df[features(t, n_features)[0]] += 1
            yield pd.DataFrame({"slot": np.flatnonzero(df), "df": df[df > 0]})

    counts = np.zeros(n_features)
    for r in texts.mapInPandas(slots, "slot bigint, df bigint").groupBy("slot").agg(F.sum("df").alias("df")).collect():  # at most n_features rows
        counts[r["slot"]] = r["df"]
    idf = np.log((1 + n) / (1 + counts)) + 1
    dimension = min(dimension, max(2, min(n, int((counts > 0).sum())) - 1))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_features, dimension)))[0]
    for _ in range(passes):
        q, r = np.linalg.qr(_gram_times(texts, TfidfSvd(idf, q, seed)))
    # within the subspace, the directions of largest spread come first
    small = q.T @ _gram_times(texts, TfidfSvd(idf, q, seed))
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return TfidfSvd(idf, q @ turn[:, np.argsort(-values)], seed)


def _gram_times(texts: DataFrame, model: TfidfSvd) -> np.ndarray:
    """A' A basis, for the matrix A of the rows of all texts."""
    held = texts.sparkSession.sparkContext.broadcast(model)
    shape = model.basis.shape

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, total, some = held.value, np.zeros(shape), False
        for pdf in batches:
            for t in pdf["text"]:
                at, w = m.row(t)
                if len(at):
                    total[at] += np.outer(w, w @ m.basis[at])
                    some = True
        if some:
            yield pd.DataFrame({"block": range(0, shape[0], BLOCK), "part": TaskContext.get().partitionId() % PARTS, "payload": [total[i : i + BLOCK].tobytes() for i in range(0, shape[0], BLOCK)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0]], "payload": [sum(np.frombuffer(p) for p in pdf["payload"]).tobytes()]})

    out = np.zeros(shape)
    schema = "block int, part int, payload binary"
    # in two steps, so that no task gathers the sums of all others
    sums = texts.mapInPandas(part, schema).groupBy("block", "part").applyInPandas(add, schema)
    for r in sums.groupBy("block").applyInPandas(add, schema).collect():
        out[r["block"] : r["block"] + BLOCK] = np.frombuffer(bytes(r["payload"])).reshape(-1, shape[1])
    return out


def encode(df: DataFrame, model: TfidfSvd, text: str = "text", out: str = "vector") -> DataFrame:
    """*df* with a vector for each text."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<float>")
    def vector(s: pd.Series) -> pd.Series:
        return s.map(lambda t: held.value.vector(t))

    return df.withColumn(out, vector(F.coalesce(F.col(text), F.lit(""))))


def embedding_key(fingerprint: str):
    """The cache key of the text in column *text*: what made the vector, and the text."""
    return F.sha2(F.concat_ws("\u0000", F.lit(fingerprint), F.col("text")), 256)


def encode_cached(texts: DataFrame, fingerprint: str, encode_missing: Callable[[DataFrame], DataFrame], cache) -> DataFrame:
    """texts(text) with vectors from the *cache*; only what it lacks is encoded, and stored."""
    keyed = texts.select("text").distinct().withColumn("key", embedding_key(fingerprint))
    missing = encode_missing(cache.misses(keyed))
    cache.put(missing.select("key", F.to_json("vector").alias("payload")))
    return cache.require(keyed).select("text", F.from_json("payload", "array<float>").alias("vector"))


EMBEDDERS: dict[str, Callable] = {}
"""Further kinds: kind -> (texts, **params) -> an object with dimension, fingerprint and vector(text)."""


def register_embedder(kind: str, fit: Callable) -> None:
    """Make another model available to configurations, for instance one that runs from local files."""
    EMBEDDERS[kind] = fit


def fit_embedder(kind: str, texts: DataFrame, **params):
    """The embedder of a configuration, fitted on texts(text)."""
    if kind in EMBEDDERS:
        return EMBEDDERS[kind](texts, **params)
    if kind != "tfidf_svd":
        raise ConfigError(f"unknown or unavailable embedder: {kind!r}")
    return fit_tfidf_svd(texts, int(params.get("dimension", 256)), int(params.get("seed", 20260806)), int(params.get("features", 4096)))
