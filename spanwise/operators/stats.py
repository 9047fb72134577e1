"""Summaries and comparisons over cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED, RESAMPLES = 20260806, 10_000
MAX_EXACT_PAIRS = 1_000_000
"""The exact bootstrap gathers one metric's differences in one task, up to so many; beyond, use the Poisson one."""


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys..., metric, value): booleans as 0 and 1, NULL where undefined."""
    own = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return own.unpivot(keys, metrics, "metric", "value")


def summarise(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by..., metric, n, mean): means over the cases where a metric is defined; NULL where it is nowhere."""
    return unpivot(df, by, metrics).groupBy(*by, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def confusion(df: DataFrame, by: list[str], expected: str = "expected", observed: str = "observed") -> DataFrame:
    """(by..., expected, observed, n)."""
    return df.groupBy(*by, expected, observed).agg(F.count("*").alias("n"))


def order_statistics(df: DataFrame, by: list[str], value: str, shares: dict[str, float], width: float = 10.0) -> DataFrame:
    """(by..., n, one column per share): the value at place floor(share * n) (0-based, the last at most) of the
    sorted values; exact.

    Counts per range of *width* find the range that holds the place; only its different values are then
    ordered.  So a group of any size is never sorted in one task.  Nulls are left out; groups without a value too.
    """
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), F.floor(F.col(value) / width).alias("bin"))
    counts = own.groupBy(*by, "bin").agg(F.count("*").alias("n_bin"))
    w = W.partitionBy(*by)
    sums = counts.select(*by, "bin", "n_bin", F.sum("n_bin").over(w).alias("n"), (F.sum("n_bin").over(w.orderBy("bin")) - F.col("n_bin")).alias("before"))
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.col("n") * s), F.col("n") - 1).alias("at")) for k, s in shares.items()]))
    wanted = sums.select(*by, "bin", "n", "before", "n_bin", place.alias("p")).where("p.at >= before AND p.at < before + n_bin")
    bins = wanted.select(*by, "bin").distinct()
    # values with their numbers: one that a third of all rows share is one row here
    values = own.join(bins, [*by, "bin"]).groupBy(*by, "bin", "v").agg(F.count("*").alias("c"))
    upto = values.withColumn("upto", F.sum("c").over(W.partitionBy(*by, "bin").orderBy("v")))
    found = upto.join(wanted, [*by, "bin"]).where("p.at - before >= upto - c AND p.at - before < upto")
    return found.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("p.name") == k, F.col("v"))).alias(k) for k in shares])


def pair(base: DataFrame, improved: DataFrame, metrics: list[str], key: str = "case_id") -> DataFrame:
    """(metric, case, baseline, improved) of the cases where both arms define the metric."""
    b = unpivot(base, [key], metrics).withColumnRenamed("value", "baseline")
    i = unpivot(improved, [key], metrics).withColumnRenamed("value", "improved")
    return b.join(i, [key, "metric"]).where("baseline IS NOT NULL AND improved IS NOT NULL")


def bootstrap_interval(diffs: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean and percentile interval of resampled means; the order of *diffs* is part of the result.

    Draws in parts of some million numbers: the stream of the generator is the same as for one call.
    """
    rng, n = np.random.default_rng(seed), len(diffs)
    rows = max(1, 4_000_000 // n)
    means = np.concatenate([rng.choice(diffs, size=(min(rows, resamples - i), n), replace=True).mean(axis=1) for i in range(0, resamples, rows)])
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(diffs.mean()), float(low), float(high)


COMPARISON = "metric string, n_paired bigint, baseline_mean double, improved_mean double, delta double, ci_low double, ci_high double, ci_excludes_zero boolean, direction string"


def compare_exact(pairs: DataFrame, key: str = "case_id", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """One row per metric of ``pair``: paired bootstrap over cases in the order of their ids.

    Fewer than three pairs are "insufficient data".  Every metric draws from the same seed, so metrics with
    equal numbers of pairs share their resamples.  Raises beyond MAX_EXACT_PAIRS pairs of a metric.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name, n = pdf["metric"].iloc[0], len(pdf)
        if n > MAX_EXACT_PAIRS:
            raise ValueError(f"{n} pairs of {name}: use compare_poisson")
        if n < 3:
            return pd.DataFrame([[name, n, None, None, None, None, None, False, "insufficient data"]], columns=[c.split()[0] for c in COMPARISON.split(", ")])
        pdf = pdf.sort_values(key)
        base, imp = pdf["baseline"].to_numpy(float), pdf["improved"].to_numpy(float)
        delta, low, high = bootstrap_interval(imp - base, resamples, seed)
        apart = not low <= 0.0 <= high
        word = "no measurable difference" if not apart else "improved" if delta > 0 else "regressed"
        return pd.DataFrame([[name, n, base.mean(), imp.mean(), delta, low, high, apart, word]], columns=[c.split()[0] for c in COMPARISON.split(", ")])

    return pairs.groupBy("metric").applyInPandas(one, COMPARISON)


#: Cumulated Poisson(1) chances of 0, 1, ... 7; fixed values.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson_weight(seed: int, resample: Column, case: Column) -> Column:
    """A Poisson(1) count that depends on nothing but seed, resample and case: any engine gives the same."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), resample.cast("string"), case).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))


def compare_poisson(pairs: DataFrame, key: str = "case_id", resamples: int = 200, seed: int = SEED) -> DataFrame:
    """Like ``compare_exact`` with Poisson weights: sums per (metric, resample), combined on the map side,
    so that no task holds the cases of a metric.  The interval is that of the resampled means."""
    each = pairs.withColumn("d", F.col("improved") - F.col("baseline"))
    total = each.groupBy("metric").agg(F.count("*").alias("n_paired"), F.avg("baseline").alias("baseline_mean"), F.avg("improved").alias("improved_mean"), F.avg("d").alias("delta"))
    drawn = each.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", poisson_weight(seed, F.col("b"), F.col(key)))
    means = drawn.groupBy("metric", "b").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.groupBy("metric").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    enough = F.col("n_paired") >= 3
    apart = ~((low <= 0) & (high >= 0))
    word = F.when(~enough, "insufficient data").when(~apart, "no measurable difference").when(F.col("delta") > 0, "improved").otherwise("regressed")
    some = lambda c, n: F.when(enough, c).alias(n)
    return total.join(ends, "metric").select("metric", "n_paired", some(F.col("baseline_mean"), "baseline_mean"), some(F.col("improved_mean"), "improved_mean"), some(F.col("delta"), "delta"), some(low, "ci_low"), some(high, "ci_high"), (enough & apart).alias("ci_excludes_zero"), word.alias("direction"))


def mean_interval(values: DataFrame, by: list[str], value: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(by..., n, mean, ci_low, ci_high): percentile bootstrap of a mean; interval NULL for fewer than three values."""
    kinds = dict(values.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "n bigint, mean double, ci_low double, ci_high double"])

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].dropna().sort_values().to_numpy(float)
        if len(v) > MAX_EXACT_PAIRS:
            raise ValueError(f"{len(v)} values: use compare_poisson")
        mean, low, high = bootstrap_interval(v, resamples, seed) if len(v) >= 3 else (float(v.mean()) if len(v) else None, None, None)
        return pd.DataFrame([[*key, len(v), mean, low, high]], columns=[*by, "n", "mean", "ci_low", "ci_high"])

    return values.groupBy(*by).applyInPandas(one, schema)


def budgets(traces: DataFrame, arm: str) -> DataFrame:
    """(arm, budget): the smallest top_k of an arm's error-free runs."""
    return traces.where("coalesce(size(errors), 0) <= 0").groupBy(arm).agg(F.min("top_k").alias("budget"))


def deltas(df: DataFrame, variant: str, base: object, metric: str = "metric", value: str = "value") -> DataFrame:
    """*df*(variant, metric, value) with the difference from the variant *base*."""
    ref = df.where(F.col(variant) == F.lit(base)).select(metric, F.col(value).alias("base_value"))
    return df.join(ref, metric, "left").withColumn("delta", F.col(value) - F.col("base_value"))


