"""Filling containers of fixed capacity with items of varying size.

Only the histogram of sizes, at most one row per size up to the capacity,
reaches the driver.  There, sizes are counted in at most UNITS steps; patterns
are multisets of steps that fill a container.  Non-negative least squares fits
how often to repeat each pattern to the histogram: patterns enter one by one,
each the one of steepest descent among all there are (found by dynamic
programming), until none is left that would lessen the error.  The repeats are rounded,
each pattern is filled with sizes of its steps that use up all room, and the
fit is repeated on what remains until it hardly places more.  The residual is
packed by best fit, largest size first.  The plan is then carried out by the rank
of each item among those of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import materialise

ITEMS_PER_SHARD = 50_000
UNITS = 128
"""Steps that a container is counted in: the cost of the fit depends on them, not on the capacity or the items."""
DOUBLINGS = 4
"""A pattern holds at most 2 ** DOUBLINGS items."""
WORTH_REPEATING = 1000
"""The fit is repeated while it places at least one in so many items; best fit takes what remains, all of it."""
_NONE = -1e300


def best_pattern(value: np.ndarray, there: np.ndarray, doublings: int = DOUBLINGS) -> tuple[float, list[int]]:
    """(value, steps): of all multisets of at most 2 ** *doublings* of the steps *there* whose sum is len(value) - 1, the one of
    the greatest total value; (0, []) for none."""
    n = len(value)
    best = np.full(n, _NONE)
    best[0] = 0.0
    best[there] = value[there]
    rest = np.arange(n)[:, None] - np.arange(n)[None, :]
    fits, rest = rest >= 0, np.maximum(rest, 0)
    halves = []
    for _ in range(doublings):
        both = np.where(fits, best[None, :] + best[rest], _NONE)
        halves.append(both.argmax(axis=1))
        best = np.maximum(both[np.arange(n), halves[-1]], _NONE)
    if best[-1] <= _NONE / 2:
        return 0.0, []
    parts = [n - 1]
    for half in reversed(halves):
        parts = [y for x in parts for y in (int(half[x]), x - int(half[x]))]
    return float(best[-1]), sorted((x for x in parts if x), reverse=True)


def fit_repeats(counts: np.ndarray, tolerance: float = 1e-4) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """(patterns, x): x >= 0 minimises |A x - counts|, where a column of A counts the steps of a pattern and
    the columns are all patterns there are, by the active-set method.

    Stops at the optimum: no pattern's gradient is more than *tolerance* times the number of items.  No more
    patterns than steps have x > 0.
    """
    there, total = np.flatnonzero(counts > 0), float(counts.sum())
    b = counts.astype(float)
    chosen: list[tuple[int, ...]] = []
    matrix, x, left = np.zeros((len(b), 0)), np.zeros(0), b.copy()
    while len(there):
        gain, steps = best_pattern(left, there)
        if not steps or gain <= tolerance * total or tuple(steps) in chosen:
            break
        chosen.append(tuple(steps))
        matrix, x = np.column_stack([matrix, np.bincount(steps, minlength=len(b))]), np.append(x, 0.0)
        while len(x):
            free = np.linalg.lstsq(matrix, b, rcond=None)[0]
            low = free <= 1e-12
            if not low.any():
                x = free
                break
            x = x + (x[low] / np.maximum(x[low] - free[low], 1e-300)).min() * (free - x)
            keep = x > 1e-9 if (x <= 1e-9).any() else ~low
            chosen, matrix, x = [c for c, k in zip(chosen, keep, strict=True) if k], matrix[:, keep], x[keep]
        left = b - matrix @ x
    return chosen, x


Content = list[tuple[int, int]]


def fill(steps: tuple[int, ...], n: int, left: np.ndarray, members: list[np.ndarray], width: float, capacity: int) -> list[tuple[Content, int]]:
    """Up to *n* full containers of the pattern *steps*: [([(size, multiplicity)...], number)]; takes their items from *left*.

    Each step is filled with the size that keeps the sum nearest to plan, the last two with sizes that
    bring it to the capacity, if there are such.  A choice is repeated while its sizes last, so every
    choice uses up a size or the pattern: their number is bounded by the sizes, not by the items.
    """
    out: list[tuple[Content, int]] = []
    while n > 0:
        used: dict[int, int] = {}
        picked: list[int] = []
        planned = 0.0

        def there(step: int, used: dict[int, int] = used) -> np.ndarray:
            return np.array([s for s in members[step] if left[s] > used.get(int(s), 0)], np.int64)

        for step in steps[:-2]:
            own = there(step)
            if not len(own):
                return out
            planned += step * width
            picked.append(int(own[np.abs(own - (planned - sum(picked))).argmin()]))
            used[picked[-1]] = used.get(picked[-1], 0) + 1
        room = capacity - sum(picked)
        a, b = there(steps[-2]) if len(steps) > 1 else np.zeros(1, np.int64), there(steps[-1])
        if not len(a) or not len(b):
            return out
        alone = np.array([s > 0 and left[s] - used.get(int(s), 0) < 2 for s in a])
        full = (a[:, None] + b[None, :] == room) & ~((a[:, None] == b[None, :]) & alone[:, None])
        if not full.any():
            return out
        i, j = divmod(int(full.argmax()), len(b))
        sizes, mult = np.unique([x for x in (*picked, int(a[i]), int(b[j])) if x], return_counts=True)
        times = min(n, int((left[sizes] // mult).min()))
        left[sizes] -= times * mult
        out.append((list(zip(sizes.tolist(), mult.tolist(), strict=True)), times))
        n -= times
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Content, int]]:
    """Best-fit decreasing on a histogram: contents and numbers of containers."""
    open_: dict[int, list[tuple[tuple, int]]] = {}
    done: list[tuple[tuple, int]] = []

    def put(content: tuple, room: int, n: int) -> None:
        if n:
            (done if room == 0 else open_.setdefault(room, [])).append((content, n))

    for size in np.flatnonzero(counts)[::-1]:
        size, left = int(size), int(counts[size])
        if size == 0:
            continue
        for room in sorted(r for r in open_ if r >= size):
            if not left:
                break
            waiting, open_[room] = open_[room], []
            each = room // size
            for content, n in waiting:
                full = min(n, left // each)
                put((content, size, each), room - each * size, full)
                left -= full * each
                if full < n and 0 < left < each:
                    put((content, size, left), room - left * size, 1)
                    left, full = 0, full + 1
                if full < n:
                    open_[room].append((content, n - full))
            if not open_[room]:
                del open_[room]
        each = capacity // size
        full, rest = divmod(left, each)
        put(((), size, each), capacity - each * size, full)
        put(((), size, rest), capacity - rest * size, 1 if rest else 0)
    done += [x for v in open_.values() for x in v]

    def unroll(content: tuple) -> Content:
        out = []
        while content:
            content, size, n = content
            out.append((size, n))
        return out

    return [(unroll(c), n) for c, n in done]


def plan(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Content, int]], list[tuple[Content, int]]]:
    """Containers that the patterns plan, and those of best fit: contents and numbers.  Together they hold every
    item of the histogram *counts* (by size, 1 to capacity)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    total = int(left.sum())
    units = min(capacity, UNITS)
    width = capacity / units
    # a size below half a step is step 0 and in no pattern
    step = np.floor(np.arange(capacity + 1) / width + 0.5).astype(np.int64)
    members = np.split(np.arange(capacity + 1), np.flatnonzero(np.diff(step)) + 1)
    planned: list[tuple[Content, int]] = []
    placed = total
    while placed * WORTH_REPEATING >= total > 0:
        steps = np.bincount(step, left, units + 1)
        steps[0] = 0
        patterns, x = fit_repeats(steps)
        before = int(left.sum())
        for j in np.argsort(-x, kind="stable"):
            planned += fill(patterns[j], int(x[j] + 0.5), left, members, width, capacity)
        placed = before - int(left.sum())
        if not placed:
            break
    return planned, best_fit(left, capacity)

def slots(planned: list[tuple[list[tuple[int, int]], int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, first containers, number of containers): the items of a size with ranks from key's rank on
    go to consecutive containers from the first one; keys are size << 44 | rank, sorted."""
    used: dict[int, int] = {}
    keys, firsts, container = [], [], 0
    for content, n in planned:
        for size, mult in content:
            for _ in range(mult):
                keys.append(size << 44 | used.get(size, 0))
                firsts.append(container)
                used[size] = used.get(size, 0) + n
        container += n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(firsts, np.int64)[order], container


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, start, size, container, by_pattern): every item in a container, no container over its capacity.

    An item larger than the capacity is cut into pieces of the capacity and a rest (piece 0, 1...,
    *start* the place of its first unit); others stay whole.  Items of size 0 or null take no room and
    are spread over the containers (container 0 if there is none).  Containers are numbered from 0.
    by_pattern tells whether a pattern of the fit, or else best fit, placed the item.
    Rows are items: keys may repeat or be null, and other columns are ignored.  No items, no rows.
    """
    spark = sizes.sparkSession
    if capacity < 1:
        raise ValueError("capacity must be positive")
    own = sizes.select(sizes[key].alias("key"), F.coalesce(sizes[size].cast("bigint"), F.lit(0)).alias("whole"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("whole") / capacity) - 1).cast("int"))).alias("piece")
    items = materialise(own.select("key", "whole", piece).select("key", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), F.col("whole") - F.col("piece").cast("bigint") * capacity).cast("bigint").alias("size")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("size").count().collect():  # at most capacity + 1 rows
        counts[row["size"]] = row["count"]
    patterns, rest = plan(counts, capacity)
    n_by_pattern = sum(n for _, n in patterns)
    # some rows for each of at most capacity sizes, whatever the number of items
    keys, firsts, n_containers = slots(patterns + rest)
    table = spark.sparkContext.broadcast((keys, firsts))

    n_shards = max(1, -(-int(counts.sum()) // ITEMS_PER_SHARD))
    sharded = items.where("size > 0").withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(n_shards)).cast("int"))
    sums = W.partitionBy("size").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = sharded.groupBy("size", "shard").agg(F.count("*").alias("n")).select("size", "shard", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("before"))
    ranked = sharded.withColumn("rank", F.row_number().over(W.partitionBy("size", "shard").orderBy("key", "piece")) - 1).join(offsets, ["size", "shard"])
    kind = items.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = table.value
        for batch in batches:
            n = batch.column(3).to_numpy()
            wanted = (n << 44) | batch.column(4).to_numpy()
            at = np.searchsorted(known, wanted, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first[at] + wanted - known[at] if len(at) else at, pa.int64())], [key, "piece", "start", "size", "container"])

    schema = f"`{key}` {kind}, piece int, start bigint, size bigint, container bigint"
    filled = ranked.select("key", "piece", "start", "size", (F.col("rank") + F.col("before")).cast("bigint").alias("rank")).mapInArrow(run, schema)
    empty = items.where("size = 0").select(F.col("key").alias(key), "piece", "start", "size", F.pmod(F.xxhash64("key"), F.lit(max(1, n_containers))).cast("bigint").alias("container"))
    return filled.withColumn("by_pattern", F.col("container") < n_by_pattern).unionByName(empty.withColumn("by_pattern", F.lit(False)))
