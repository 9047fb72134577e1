"""Ranking chunks for queries: dense, lexical, fused; and removal of repeats from a ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import materialise
from ..functions import text as T

QUERY_BLOCK_BYTES = 32 * 2**20
"""Query vectors that one task holds.  More queries make more blocks."""
QUERY_BLOCK_TERMS = 200_000
"""Terms of queries, with their repeats, that are broadcast at once.  More make more blocks."""
ROUNDED = 2e-9
"""Scores that are this close may be equal once they are rounded to nine digits."""


def top_k(scored: DataFrame, k: int, group: list[str], score: str = "score", item: str = "chunk_id") -> DataFrame:
    """The k best of each group with their rank; equal scores in the order of *item*."""
    w = W.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> pd.DataFrame:
    """All (query, item) pairs of two blocks that reach the k-th best score of their query."""
    s = np.round(q @ x.T, 9)
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero(s >= least[:, None])
    else:
        i, j = (a.ravel() for a in np.indices(s.shape))
    return pd.DataFrame({"query_id": q_ids[i], "item_id": x_ids[j], "score": s[i, j]})


def dense_top_k(queries: DataFrame, items: DataFrame, k: int, dim: int) -> DataFrame:
    """Exact search by dot product: the k items of highest score for each query.

    queries(query_id, vector), items(item_id, vector).  Matrix products of blocks; each task keeps what
    reaches its own k-th score (ties included), so what is shuffled is k rows per query and task, not
    queries times items.  Up to QUERY_BLOCK_BYTES the queries are broadcast; beyond, they are cut into
    blocks and each item block meets each query block.  Rows with a null vector or id, or one of another
    length, are left out.  Scores are rounded to nine digits, ties go to the smaller item_id.
    """
    ok = f"vector IS NOT NULL AND size(vector) = {dim}"
    queries = queries.where(ok).where("query_id IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    items = items.where(ok).where("item_id IS NOT NULL").select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    kinds = {**{c: t for c, t in queries.dtypes}, **{c: t for c, t in items.dtypes}}
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double"
    blocks = math.ceil(queries.count() * dim * 8 / QUERY_BLOCK_BYTES) or 1
    if blocks == 1:
        pdf = queries.toPandas()  # bounded by QUERY_BLOCK_BYTES
        held = items.sparkSession.sparkContext.broadcast((pdf["query_id"].to_numpy(), np.stack(pdf["vector"]) if len(pdf) else np.empty((0, dim))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            for b in batches:
                if len(b) and len(q):
                    yield _best_of(q, ids, np.stack(b["vector"]), b["item_id"].to_numpy(), k)

        found = items.mapInPandas(run, schema)
    else:
        parts = max(1, items.rdd.getNumPartitions())
        left = queries.withColumn("qb", F.pmod(F.hash("query_id"), F.lit(blocks))).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = items.withColumn("ib", F.pmod(F.hash("item_id"), F.lit(parts))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def cell(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
            return _best_of(np.stack(q["vector"]), q["query_id"].to_numpy(), np.stack(x["vector"]), x["item_id"].to_numpy(), k)

        found = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(cell, schema)
    return top_k(found, k, ["query_id"], item="item_id")


def idf(n: Column | float, df: Column) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def bm25_weight(idf_: np.ndarray, f: np.ndarray, dl: np.ndarray, avgdl: float, k1: float, b: float) -> np.ndarray:
    return idf_ * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / max(avgdl, 1e-9)))


def postings(docs: DataFrame) -> DataFrame:
    """(item_id, term, f, dl) from docs(item_id, text)."""
    tokens = docs.select("item_id", T.tokenize("text").alias("_t"))
    # explode would have the optimizer add a filter on the array, and with it tokenize every text again
    each = tokens.select("item_id", F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"))
    return each.where("term IS NOT NULL").groupBy("item_id", "term", "dl").agg(F.count("*").alias("f"))


def _tokens_of_items(docs: DataFrame) -> DataFrame:
    """(item_id, copies, texts) from docs(item_id, text): the tokens of an item, of texts of one length together."""
    lists = docs.select("item_id", T.tokenize(F.coalesce("text", F.lit(""))).alias("_t")).groupBy("item_id").agg(F.collect_list("_t").alias("_l"))
    of = lambda n: F.struct(n.alias("dl"), F.flatten(F.filter("_l", lambda x: F.size(x) == n)).alias("tokens"))
    return lists.select("item_id", F.size("_l").alias("copies"), F.transform(F.array_distinct(F.transform("_l", F.size)), of).alias("texts"))


def _query_block(rows: pa.Table) -> tuple[pa.DataType, list, list[list[tuple[int, int]]], pa.Array, np.ndarray]:
    """From rows(query_id, term, times, idf): type and values of query_id, the (code, times) of each query's terms in
    order, the terms by code, their idf by code."""
    own: dict[object, list[tuple[str, int]]] = {}
    weight: dict[str, float] = {}
    for q, term, times, w in zip(*(rows.column(c).to_pylist() for c in ("query_id", "term", "times", "idf")), strict=True):
        terms = own.setdefault(q, [])
        if w is not None:  # else no term, or one that no item has
            terms.append((term, times))
            weight[term] = w
    words = sorted(weight)
    code = {t: i for i, t in enumerate(words)}
    return rows.schema.field("query_id").type, list(own), [[(code[t], n) for t, n in sorted(x)] for x in own.values()], pa.array(words, pa.string()), np.array([weight[t] for t in words], float)


def _postings_of(texts: pa.ListArray, words: pa.Array) -> tuple[np.ndarray, ...]:
    """(code, row, f, dl) of the terms that are among *words*, in the order of their codes."""
    each = texts.flatten()
    tokens = pc.struct_field(each, "tokens")
    codes = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    asked = codes >= 0
    of_token = pc.list_parent_indices(tokens).to_numpy()[asked]
    keys, f = np.unique(codes[asked] * max(1, len(each)) + of_token, return_counts=True)
    code, text = np.divmod(keys, max(1, len(each)))
    return code, pc.list_parent_indices(texts).to_numpy()[text], f, pc.struct_field(each, "dl").to_numpy(zero_copy_only=False)[text]


def _best_items(held: Broadcast, avgdl: float, k: int, k1: float, b: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, item_id, score) of the k best items of a task for each query of a block, from (item_id, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, ids, queries, words, weight = held.value
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            items, size = batch.column("item_id"), len(batch)
            if not size:
                continue
            order = pc.array_sort_indices(items, null_placement="at_start")
            items, place = items.take(order), np.empty(size, np.int64)
            place[order.to_numpy()] = np.arange(size)  # the smaller place has the smaller id
            code, row, f, dl = _postings_of(batch.column("texts"), words)
            at, w = place[row], bm25_weight(weight[code], f, dl, avgdl, k1, b)
            cuts = np.searchsorted(code, np.arange(len(words) + 1)).tolist()
            for q, terms in enumerate(queries):
                # one query after the other: its scores stay in the cache.  The order of terms is fixed, so equal texts have equal scores
                own = [(slice(cuts[c], cuts[c + 1]), n) for c, n in terms if cuts[c] < cuts[c + 1]]
                s = np.bincount(np.concatenate([at[x] for x, _ in own]), np.concatenate([w[x] * n if n > 1 else w[x] for x, n in own]), size) if own else np.zeros(size)
                near = np.flatnonzero(s >= -best[q][-1][0] - ROUNDED) if len(best[q]) == k else np.arange(size)
                if len(near) > k:
                    near = near[s[near] >= np.partition(s[near], -k)[-k] - ROUNDED]
                if not len(near):
                    continue
                score = np.round(s[near], 9)
                first = np.argsort(-score, kind="stable")[:k]
                new = zip(score[first].tolist(), items.take(pa.array(near[first])).to_pylist(), strict=True)
                best[q] = sorted([*best[q], *((-x, i is not None, i) for x, i in new)])[:k]
        rows = [(ids[q], i, 0.0 - x) for q, own in enumerate(best) for x, _, i in own]
        if rows:
            cols = zip(zip(*rows, strict=True), (id_type, items.type, pa.float64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["query_id", "item_id", "score"])

    return run


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, item_id, score, rank) of the k best items of docs(item_id, text) for queries(query_id, text).

    Every item is ranked, those without a common term with score 0 in the order of their id; so a query
    of stop words, an empty or a null one, gets the k smallest ids.  A query's repeated terms count each time.  Items of
    null text have no terms.  Every item is scored for every query, in the task that holds its tokens, which
    keeps k items per query: those are shuffled, not queries times items.  So that they do not grow as queries times
    tasks, there are no more tasks than make one row an item, or one task a core.  The queries' terms are broadcast;
    beyond QUERY_BLOCK_TERMS they are cut into blocks, one after the other.
    """
    spark = docs.sparkSession
    held = materialise(_tokens_of_items(docs))
    items, n, total = held.agg(F.count("*"), F.sum("copies"), F.sum(F.aggregate("texts", F.lit(0), lambda a, x: a + F.size(x["tokens"])))).head()
    each = held.select(F.explode_outer(F.flatten(F.transform("texts", lambda x: F.array_distinct(x["tokens"])))).alias("term"))
    dfs = each.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    terms = queries.select("query_id", F.explode_outer(T.tokenize("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = materialise(terms.join(dfs, "term", "left").select("query_id", "term", "times", idf(float(n or 0), F.col("df")).alias("idf")))
    rows, asking = asked.agg(F.count("*"), F.countDistinct("query_id")).head()
    blocks = math.ceil(rows / QUERY_BLOCK_TERMS) or 1
    tasks = max(spark.sparkContext.defaultParallelism, items // max(1, asking * k))
    kinds = dict(asked.dtypes) | dict(held.dtypes)
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double"

    def of_block(i: int) -> DataFrame:
        own = asked if blocks == 1 else asked.where(F.pmod(F.hash("query_id"), F.lit(blocks)) == i)
        content = spark.sparkContext.broadcast(_query_block(own.toArrow()))  # bounded by QUERY_BLOCK_TERMS
        found = held.select("item_id", "texts").coalesce(tasks).mapInArrow(_best_items(content, (total or 0) / n if n else 0.0, k, k1, b), schema)
        return top_k(found, k, ["query_id"], item="item_id")

    return of_block(0) if blocks == 1 else reduce(DataFrame.unionByName, [materialise(of_block(i)) for i in range(blocks)])


def rrf(rankings: DataFrame, k: int, group: list[str], item: str = "chunk_id", k_rrf: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings(group..., item, rank): the sum of 1 / (k_rrf + rank) over members.

    An item that a member lists twice counts twice; null ranks count nothing.
    """
    fused = rankings.where("rank IS NOT NULL").groupBy(*group, item).agg(F.round(F.sum(1.0 / (F.lit(k_rrf) + F.col("rank"))), 12).alias("score"))
    return top_k(fused, k, group, item=item)


def drop_repeats(ranked: DataFrame, group: list[str], max_overlap: float = 0.8) -> DataFrame:
    """(group..., chunk_id, rank, rank_before): ranked(group..., chunk_id, rank, text) without items whose
    token set overlaps with that of a kept, better ranked item by *max_overlap* of the smaller set.

    Items without tokens are dropped; ranks are numbered anew; nothing moves up from beyond the ranking.
    The pass is sequential within one ranking, so it is a fold over its items, inside the JVM.
    """
    item = F.struct(F.col("rank"), F.col("chunk_id"), F.array_distinct(F.transform(T.tokenize("text"), lambda t: F.xxhash64(t))).alias("tokens"))
    lists = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(ranked.dtypes)
    empty = F.array().cast(f"array<struct<rank:{kind['rank']},chunk_id:{kind['chunk_id']},tokens:array<bigint>>>")

    def repeats(kept: Column, x: Column) -> Column:
        size = lambda y: F.least(F.size(x["tokens"]), F.size(y["tokens"]))
        return F.exists(kept, lambda y: F.size(F.array_intersect(x["tokens"], y["tokens"])) >= max_overlap * size(y))

    kept = F.aggregate("items", empty, lambda acc, x: F.when((F.size(F.coalesce(x["tokens"], F.array().cast("array<bigint>"))) == 0) | repeats(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select(*group, F.posexplode(kept).alias("pos", "x")).select(*group, F.col("x.chunk_id").alias("chunk_id"), (F.col("pos") + 1).alias("rank"), F.col("x.rank").alias("rank_before"))


RETRIEVERS = ("dense", "bm25", "hybrid_rrf")


def l2_normalise(vector: Column) -> Column:
    """Unit length; a null vector stays null, a zero one zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: (x / F.greatest(norm, F.lit(1e-12))).cast("float"))
