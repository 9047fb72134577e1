import datetime as dt

from pyspark.sql import functions as F

from spanwise.operators import references as R
from spanwise.streaming import references as S
from spanwise.streaming import traces
from spanwise.streaming.drain import drain as work_off
from spanwise.streaming.windows import hourly

T0 = dt.datetime(2026, 3, 1, 10)


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string, value double")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    assert sorted(map(tuple, drain(hourly(stream), "w", "complete").collect())) == sorted(map(tuple, hourly(df).collect()))


def test_trace_health_counts_a_redelivery_once(spark, tmp_path):
    rows = [("r", f"c{i}", "p", T0 + dt.timedelta(minutes=i), 10.0 * i, ["x"] if i == 2 else []) for i in range(4)] * 2
    df = spark.createDataFrame(rows, "run_id string, case_id string, pipeline_name string, ingested_at timestamp_ntz, latency_ms double, errors array<string>")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    late = [("r", "c9", "p", T0 + dt.timedelta(hours=9), 0.0, [])]
    spark.createDataFrame(late, df.schema).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "t"))
    got = drain(traces.health(stream), "h", "append").collect()
    assert [(r.window_start, r.n, r.n_errors, r.mean_latency_ms) for r in got] in ([], [(T0, 4, 1, 15.0)])
    assert (T0, "p", 4, 1, 15.0) in {tuple(r) for r in traces.health(df).collect()}


def test_references_wait_resolve_and_reopen(spark, tmp_path):
    """One shuffled file a micro-batch; the last batch is run again, as after a failure."""
    day = lambda n: T0 + dt.timedelta(days=n)
    c = F.col
    refs = spark.createDataFrame([(1, "a", day(0)), (2, "a", day(2)), (3, "b", day(1)), (4, "a", None)], "id bigint, key string, at timestamp_ntz")
    parents = spark.createDataFrame([("a", day(1), day(3)), ("a", day(-1), day(1)), ("b", day(2), None)], "key string, start timestamp_ntz, stop timestamp_ntz")
    events = R.reference_events(refs, "f", c("id"), c("key"), c("at")).unionByName(R.parent_events(parents, "f", c("key"), c("start"), c("stop")))
    rows = events.collect()
    order = sorted(range(len(rows)), key=lambda i: (i * 7 + 3) % len(rows))
    files = [order[i::3] for i in range(3)]
    folder = "file://" + str(tmp_path / "life")
    (tmp_path / "r").mkdir()
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    for part in files:
        spark.createDataFrame([rows[i] for i in part], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    S.follow_references(stream, folder, availableNow=True).awaitTermination()
    want = {1: False, 2: False, 3: True, 4: True}
    state = S.read_state(spark, folder, 2)
    assert {r.ref_id: r.orphan for r in state.refs.collect()} == want
    assert [(r.n_references, r.n_waiting) for r in state.snapshot.collect()] == [(4, 2)]
    for name in ("2", ".2.crc"):
        (tmp_path / "life" / "checkpoint" / "commits" / name).unlink()
    S.follow_references(stream, folder, availableNow=True).awaitTermination()
    again = S.read_state(spark, folder, 2)
    assert {r.ref_id: r.orphan for r in again.refs.collect()} == want and again.refs.count() == 4


def test_a_stream_without_rows_is_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("a int").parquet(str(tmp_path / "none"))
    assert work_off(stream, "append").collect() == []
