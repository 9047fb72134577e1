"""References to records that do not exist at the time of the reference.

The state is kept by key: the parent index (when rows of the key arrived and were deleted) and the
references with whether they wait for a parent.  ``advance`` takes in a batch of events: new references
probe the index, arriving parents resolve references that wait, deletions reopen them.  Only the keys
of the batch are worked on.  Events may come in any order and any batches: the state after all of
them is the same.  ``forget`` drops what no late event can change.

How many rows of a key are there at an instant is a running sum over its events.  Instants are
cut into slices of equal numbers of rows, and sums carried from slice to slice, so a key that
holds a third of all rows is spread over a third of the slices at least.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import materialise

CHANGE, REFERENCE = 1, 2
"""Order of events at one instant: a row is there from its start (included) and gone at its stop."""
ALWAYS, AT_LAST = "0001-01-01", "9999-12-31"
"""Instants of parents and of references where the time does not matter."""
SLICES = 64
EVENT = ["field", "key", "t", "made_at", "ref_id", "kind", "delta"]


def reference_events(refs: DataFrame, field: str, ref_id: Column, key: Column, at: Column, made_at: Column | None = None, arrived: Column | None = None) -> DataFrame:
    """References as events: *at* is when the parent has to be there, *made_at* (the same by default) the
    time they are counted under, *arrived* (that too) when they come in.  A null key is no reference;
    the empty string is one.  Rows delivered twice count once."""
    made_at = at if made_at is None else made_at
    time = lambda c, name: c.cast("timestamp_ntz").alias(name)
    own = refs.select(F.lit(field).alias("field"), key.cast("string").alias("key"), time(at, "t"), time(made_at, "made_at"), ref_id.cast("bigint").alias("ref_id"), time(made_at if arrived is None else arrived, "arrived"))
    first = own.where("key IS NOT NULL").groupBy("field", "key", "t", "made_at", "ref_id").agg(F.min("arrived").alias("arrived"))
    return first.withColumns({"kind": F.lit(REFERENCE), "delta": F.lit(0).cast("bigint")}).select(*EVENT, "arrived")


def parent_events(parents: DataFrame, field: str, key: Column, start: Column, stop: Column, arrived: Column | None = None) -> DataFrame:
    """Arrivals and deletions of parent rows as events, netted per key and instant; they come in when they
    happen, or all at *arrived*.  Rows delivered twice count once; a row whose stop is not after its start is never there."""
    own = parents.select(key.cast("string").alias("key"), start.cast("timestamp_ntz").alias("start"), stop.cast("timestamp_ntz").alias("stop"), F.lit(None).alias("own") if arrived is None else arrived.alias("own"))
    there = own.where("key IS NOT NULL AND start IS NOT NULL AND (stop IS NULL OR stop > start)").groupBy("key", "start", "stop").agg(F.min("own").alias("own"))
    change = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("delta")), F.struct(F.col("stop").alias("t"), F.lit(-1).alias("delta"))))
    come = F.coalesce(F.col("own").cast("timestamp_ntz"), F.col("c.t"))
    nets = there.select("key", "own", change.alias("c")).where("c.t IS NOT NULL").groupBy("key", F.col("c.t").alias("t"), come.alias("arrived")).agg(F.sum("c.delta").cast("bigint").alias("delta"))
    none = F.lit(None)
    return nets.where("delta <> 0").withColumns({"field": F.lit(field), "made_at": none.cast("timestamp_ntz"), "ref_id": none.cast("bigint"), "kind": F.lit(CHANGE)}).select(*EVENT, "arrived")


class State(NamedTuple):
    """changes(field, key, t, delta): the parent index; refs(field, key, t, made_at, ref_id, orphan): references,
    those with orphan = true wait; snapshot(field, n_references, n_waiting): their numbers."""

    changes: DataFrame
    refs: DataFrame
    snapshot: DataFrame


def slice_edges(*tables: DataFrame, slices: int = SLICES) -> list[int]:
    """Instants (microseconds) that cut the rows of *tables*(t) into about equal slices: no key has more rows in one than all rows / *slices*."""
    at = F.unix_micros(F.col("t").cast("timestamp"))
    times = tables[0].select("t")
    for other in tables[1:]:
        times = times.unionByName(other.select("t"))
    return sorted(set(times.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000)).head()[0] or []))


def _there(instants: DataFrame, edges: list[int]) -> DataFrame:
    """(field, key, t, orphan) of each reference instant among instants(field, key, t, kind, delta), which are distinct."""
    at = F.unix_micros(F.col("t").cast("timestamp"))
    number = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < at)) if edges else F.lit(0)
    cut = materialise(instants.withColumn("slice", number))
    nets = cut.groupBy("field", "key", "slice").agg(F.sum("delta").alias("net"))
    w = W.partitionBy("field", "key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = nets.select("field", "key", "slice", F.sum("net").over(w).alias("delta")).where("delta <> 0")
    opening = carried.select("field", "key", F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(0).alias("kind"), "delta", "slice")
    w = W.partitionBy("field", "key", "slice").orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = cut.select(*opening.columns).unionByName(opening).withColumn("there", F.sum("delta").over(w))
    return sums.where(F.col("kind") == REFERENCE).select("field", "key", "t", (F.col("there") <= 0).alias("orphan"))


def advance(before: State | None, events: DataFrame, edges: list[int] | None = None) -> tuple[State, DataFrame]:
    """(the state after *events*, changed(field, key, ref_id, t, status)).

    status is ``orphan`` or ``met`` for a new reference, ``resolved`` for one that no longer waits,
    ``reopened`` for one that waits again.  A reference without a time can not be shown to have met its
    parent and waits for ever.  Equal references count once, in whatever batch they come again; changes
    add up, so a batch must be taken in once.  *events* is read several times.  *edges* are those of
    ``slice_edges`` for all events, by default of those so far.  Empty input changes nothing.
    """
    key = ["field", "key"]
    new_changes = events.where(F.col("kind") == CHANGE).groupBy(*key, "t").agg(F.sum("delta").alias("delta"))
    new_refs = events.where(F.col("kind") == REFERENCE).select(*key, "t", "made_at", "ref_id", F.lit(None).cast("boolean").alias("was"))
    if before is None:
        changes, refs, same = new_changes, new_refs.distinct(), None
    else:
        touched = events.select(*key).distinct()
        changes = before.changes.unionByName(new_changes).groupBy(*key, "t").agg(F.sum("delta").alias("delta"))
        same = before.refs.join(touched, key, "left_anti")
        old = before.refs.join(touched, key, "left_semi").withColumnRenamed("orphan", "was")
        refs = old.unionByName(new_refs).groupBy(*key, "t", "made_at", "ref_id").agg(F.max("was").alias("was"))
    changes = materialise(changes.where("delta <> 0"))
    if edges is None:
        edges = slice_edges(events, *([before.changes, before.refs] if before else []))
    asked = refs.where("t IS NOT NULL").select(*key, "t").distinct()
    # the parents of keys without a reference in question need no sum
    index = changes.join(asked.select(*key).distinct(), key, "left_semi")
    instants = index.select(*key, "t", F.lit(CHANGE).alias("kind"), "delta").unionByName(asked.select(*key, "t", F.lit(REFERENCE).alias("kind"), F.lit(0).cast("bigint").alias("delta")))
    judged = refs.join(_there(instants, edges), [*key, "t"], "left").withColumn("orphan", F.coalesce("orphan", F.lit(True)))
    kept = judged if same is None else judged.unionByName(same.withColumn("was", F.col("orphan")))
    kept = materialise(kept)
    status = F.when(F.col("was").isNull(), F.when(F.col("orphan"), "orphan").otherwise("met")).when(F.col("orphan"), "reopened").otherwise("resolved")
    changed = kept.where("was IS NULL OR was <> orphan").select(*key, "ref_id", "t", status.alias("status"))
    kept = kept.drop("was")
    snapshot = kept.groupBy("field").agg(F.count("*").alias("n_references"), F.count(F.when(F.col("orphan"), 1)).alias("n_waiting"))
    return State(changes, kept, snapshot), changed


def forget(state: State, before: str) -> State:
    """*state* without the references of times before *before*, and with the changes until then as one per key: what
    remains is bounded by the keys that are there and the time since.  Right where no event of an earlier time comes any more."""
    limit = F.lit(before).cast("timestamp_ntz")
    when = F.when(F.col("t") < limit, F.lit(ALWAYS).cast("timestamp_ntz")).otherwise(F.col("t"))
    changes = materialise(state.changes.groupBy("field", "key", when.alias("t")).agg(F.sum("delta").alias("delta")).where("delta <> 0"))
    # a reference whose parent may come at any time is as old as itself
    own = F.least("t", "made_at")
    refs = materialise(state.refs.where((own >= limit) | own.isNull()))
    return State(changes, refs, refs.groupBy("field").agg(F.count("*").alias("n_references"), F.count(F.when(F.col("orphan"), 1)).alias("n_waiting")))


def follow(events: DataFrame, rounds: int = 2) -> State:
    """The state after *events*, taken in in the order of their arrival, in *rounds* batches of about equal size."""
    events = materialise(events)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shares = lambda n: [i / n for i in range(1, n)]
    # one pass for the ends of the batches and for the slices of time
    marks, edges = events.agg(F.percentile_approx(micros("arrived"), shares(rounds), 1000), F.percentile_approx(micros("t"), shares(SLICES), 1000)).head()
    marks, edges = marks or [], sorted(set(edges or []))
    n = sum((F.when(micros("arrived") > m, 1).otherwise(0) for m in marks), F.lit(0))
    state = None
    for i in range(len(marks) + 1):
        state, _ = advance(state, events.where(n == i), edges)
    return state


def orphan_references(events: DataFrame) -> DataFrame:
    """(field, key, ref_id, t, orphan) for every reference event, from one batch of all."""
    return advance(None, events)[0].refs.select("field", "key", "ref_id", "t", "orphan")


def pending_by_period(events: DataFrame, period: str = "month") -> DataFrame:
    """(field, period, n_references, n_pending): at the end of each period, how many of the
    references so far point to a key that is not there then.  Arrivals resolve, deletions reopen."""
    per_key = events.where("t IS NOT NULL").groupBy("field", "key", F.date_trunc(period, "t").cast("timestamp_ntz").alias("period")).agg(F.sum("delta").alias("net"), F.count(F.when(F.col("kind") == REFERENCE, 1)).alias("refs"))
    w = W.partitionBy("field", "key").orderBy("period")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    pending = F.when(F.sum("net").over(run) <= 0, F.sum("refs").over(run)).otherwise(0)
    steps = per_key.select("field", "key", "period", "refs", pending.alias("pending")).withColumn("step", F.col("pending") - F.coalesce(F.lag("pending").over(w), F.lit(0)))
    totals = steps.groupBy("field", "period").agg(F.sum("refs").alias("n_references"), F.sum("step").alias("step"))
    # one row per field and period: a handful
    return totals.select("field", "period", "n_references", F.sum("step").over(W.partitionBy("field").orderBy("period")).alias("n_pending"))


def state_events(state: State) -> DataFrame:
    """The state as events again: (field, key, t, kind, delta)."""
    refs = state.refs.select("field", "key", "t", F.lit(REFERENCE).alias("kind"), F.lit(0).cast("bigint").alias("delta"))
    return state.changes.select("field", "key", "t", F.lit(CHANGE).alias("kind"), "delta").unionByName(refs)
