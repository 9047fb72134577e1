"""One ranking from several differently scaled scores.

Every score is replaced by its rank among the scores of the same run, so that
no scale counts.  The correlation matrix of the ranks is one distributed
aggregate; its first principal component, with loadings oriented to the declared
directions, gives the weights; items are sorted by their projection.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import materialise

LEVELS = 8
EDGES = 2**LEVELS - 1
"""Quantiles per run and score, from the least to the greatest.  Between two of them ranks are interpolated, so that
different scores have different ranks; they are off by less than 1 / (EDGES - 1) of the run.  With exact = True they are exact."""
MAX_BROADCAST_RUNS = 4096
"""Up to so many runs (about 8 KB each) the edges are broadcast; beyond, they are joined by a shuffle."""


def clean(df: DataFrame, group: list[str], position: str, item: str, scores: list[str], arrived: str) -> DataFrame:
    """One row per (group, position), the latest delivery; NaN and infinite scores become null.
    Rows without a position are told apart by item and scores."""
    own = df.select(*group, position, item, arrived, *[F.when(F.isnan(s) | (F.abs(F.col(s)) == float("inf")), None).otherwise(F.col(s).cast("double")).alias(s) for s in scores])
    other = F.when(F.col(position).isNull(), F.struct(F.col(item), *[F.col(s) for s in scores]))
    last = W.partitionBy(*group, position, other).orderBy(F.col(arrived).desc_nulls_last(), F.col(item).asc_nulls_last(), *[F.col(s).desc_nulls_last() for s in scores])
    return own.repartition(*group).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", arrived)


def rank_edges(df: DataFrame, run: str, scores: list[str]) -> DataFrame:
    """(_run, edges of each score): quantiles, by mergeable sketches; a run's size does not matter."""
    at = F.array(*[F.lit(k / (EDGES - 1)) for k in range(1, EDGES - 1)])
    edges = [F.concat(F.array(F.min(s)), F.percentile_approx(s, at, 5000), F.array(F.max(s))).alias(f"_e_{s}") for s in scores]
    return df.groupBy(F.col(run).alias("_run")).agg(*edges)


def _below(edges: Column, x: Column, equal: bool) -> Column:
    """How many of the sorted edges are below *x* (or equal to it), by bisection."""
    steps = F.array(*[F.lit(2**k) for k in reversed(range(LEVELS))])

    def step(i: Column, s: Column) -> Column:
        e = F.get(edges, i + s - 1)
        return i + F.when((e <= x) if equal else (e < x), s).otherwise(0)

    return F.aggregate(steps, F.lit(0), step)


def _with_edges(df: DataFrame, edges: DataFrame, n_runs: int, run: str) -> DataFrame:
    """A null run is a run like any other."""
    right = F.broadcast(edges) if n_runs <= MAX_BROADCAST_RUNS else edges.hint("merge")
    return df.join(right, F.col(run).eqNullSafe(F.col("_run")))


def rank_transform(df: DataFrame, edges: DataFrame, n_runs: int, run: str, group: list[str], scores: list[str]) -> DataFrame:
    """*df* with _r_<score> in [0, 1]: the score's place among its run's edges; null for null."""
    both = _with_edges(df, edges, n_runs, run)
    if n_runs > MAX_BROADCAST_RUNS:
        both = both.repartition(*group)
    places = both.select(*df.columns, *[F.col(f"_e_{s}") for s in scores], *[_below(F.col(f"_e_{s}"), F.col(s), e).alias(f"_{n}_{s}") for s in scores for n, e in (("lo", False), ("hi", True))])

    def rank(s: str) -> Column:
        e, x, lo, hi = (F.col(c) for c in (f"_e_{s}", s, f"_lo_{s}", f"_hi_{s}"))
        under, over = F.get(e, lo - 1), F.get(e, lo)
        # equal to edges: their middle; else between two of them
        place = F.when(hi > lo, (lo + hi - 1) / 2.0).otherwise(lo - 1 + (x - under) / (over - under))
        return F.when(x.isNotNull(), place / (EDGES - 1.0)).alias(f"_r_{s}")

    return places.select(*df.columns, *[rank(s) for s in scores])


def exact_ranks(df: DataFrame, edges: DataFrame, n_runs: int, run: str, group: list[str], position: str, item: str, scores: list[str]) -> DataFrame:
    """As ``rank_transform``, with exact ranks: (number of lower + half the number of equal scores) / number of scores of the run.

    The edges cut a run into cells whose values are counted, so no task holds a run; scores then meet their
    ranks by an equi-join.  Costs two shuffles of every score.
    """
    keys = list(dict.fromkeys([run, *group, position, item]))
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("x"), _below(F.col(f"_e_{s}"), F.col(s), False).alias("cell")) for s in scores])).alias("c")
    # rows may be equal: numbered, so that each keeps its scores together
    long = materialise(_with_edges(df, edges, n_runs, run).withColumn("_id", F.monotonically_increasing_id()).select(*keys, "_id", cells).select(*keys, "_id", "c.*"))
    there = long.where("x IS NOT NULL")
    counts = there.groupBy(F.col(run).alias("_run"), "name", "cell", "x").agg(F.count("*").alias("n"))
    upto = W.partitionBy("_run", "name", "cell").orderBy("x")
    within = counts.select("_run", "name", "cell", "x", (F.sum("n").over(upto) - F.col("n") / 2).alias("inside"))
    totals = counts.groupBy("_run", "name", "cell").agg(F.sum("n").alias("n"))
    whole = W.partitionBy("_run", "name")
    totals = totals.select(F.col("_run").alias("_of"), F.col("name").alias("_name"), F.col("cell").alias("_cell"), (F.sum("n").over(whole.orderBy("cell")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("all"))
    same = F.col("_run").eqNullSafe(F.col("_of")) & (F.col("name") == F.col("_name")) & (F.col("cell") == F.col("_cell"))
    ranks = within.join(totals, same).select("_run", F.col("name").alias("_name"), F.col("x").alias("_x"), ((F.col("before") + F.col("inside")) / F.col("all")).alias("r"))
    met = long.join(ranks, F.col(run).eqNullSafe(F.col("_run")) & (F.col("name") == F.col("_name")) & (F.col("x") == F.col("_x")), "left")
    return met.groupBy(*keys, "_id").agg(*[F.max(F.when(F.col("name") == s, F.col("r"))).alias(f"_r_{s}") for s in scores]).drop("_id")


def correlations(ranked: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlation matrix from rows where both of a pair are there; 0 where it is undefined.
    One aggregate over all rows; one row of sums reaches the driver."""
    pairs = list(combinations(range(len(columns)), 2))
    sums = []
    for i, j in pairs:
        a, b = F.col(columns[i]), F.col(columns[j])
        x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        sums += [F.count(x + y), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)]
    row = ranked.agg(*[c.alias(f"s{n}") for n, c in enumerate(sums)]).head()
    matrix = np.eye(len(columns))
    for at, (i, j) in enumerate(pairs):
        n, *v = row[6 * at : 6 * at + 6]
        if n > 1:
            sx, sy, sxx, syy, sxy = v
            spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
            if spread > 1e-12 * n**4:
                matrix[i, j] = matrix[j, i] = (n * sxy - sx * sy) / spread**0.5
    return matrix


def loadings(matrix: np.ndarray) -> np.ndarray:
    """First principal component, each loading turned to its declared direction: scores are ranked in
    theirs, so loadings are positive.  They sum to 1.
    """
    values, vectors = np.linalg.eigh(matrix)
    first = vectors[:, int(np.argmax(values))]
    first = np.abs(first)
    return first / first.sum()


def fuse(df: DataFrame, run: str, group: list[str], position: str, item: str, directions: dict[str, int], arrived: str, exact: bool = False) -> DataFrame:
    """(group..., position, item, fused_score, fused_rank): one ranking per group.

    *directions* maps each score column to 1 (more is better) or -1.  fused_score is the weighted
    mean of the ranks an item has, between 0 and 1 (the plain mean, where its scores have no weight); an item
    without any score is null and comes last.  Ties go by item, then position.  Rows delivered twice count once; other columns are ignored;
    an empty table gives an empty ranking.  Groups are as small as one retrieval; a run may be of
    any size: no step gathers one.
    """
    scores = list(directions)
    signed = df.withColumns({s: F.col(s).cast("double") * d for s, d in directions.items()})
    # read three times below: written once, the deliveries are sorted out once
    rows = materialise(clean(signed, group, position, item, scores, arrived))
    edges = materialise(rank_edges(rows, run, scores))
    if exact:
        ranked = materialise(exact_ranks(rows, edges, edges.count(), run, group, position, item, scores))
    else:
        ranked = rank_transform(rows, edges, edges.count(), run, group, scores)
    weights = loadings(correlations(ranked, [f"_r_{s}" for s in scores]))
    return project(ranked, dict(zip(scores, map(float, weights), strict=True)), group, position, item)


def project(ranked: DataFrame, weights: dict[str, float], group: list[str], position: str, item: str) -> DataFrame:
    there = lambda s, v: F.when(F.col(f"_r_{s}").isNotNull(), v).otherwise(0.0)
    # the least part of every score: where an item has only scores of no weight, they count alike
    weights = {s: max(w, 1e-12) for s, w in weights.items()}
    total = sum((there(s, F.col(f"_r_{s}") * w) for s, w in weights.items()), F.lit(0.0))
    weight = sum((there(s, F.lit(w)) for s, w in weights.items()), F.lit(0.0))
    # rounded: sums of floats may differ in their last digits between plans
    scored = ranked.withColumn("fused_score", F.when(weight > 0, F.round(total / weight, 9)))
    order = W.partitionBy(*group).orderBy(F.col("fused_score").desc_nulls_last(), F.col(item).asc_nulls_last(), F.col(position).asc_nulls_last())
    return scored.select(*group, position, item, "fused_score", F.row_number().over(order).alias("fused_rank"))
