"""Streaming jobs: late rows are dropped (and counted) by the watermark."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from clickpath.streaming import pipeline as P


def test_late_event_dropped_and_counted(spark, scratch):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    src = os.path.join(scratch, "src")
    names = [f.name for f in schema.fields]

    def batch(rows, i):
        full = [tuple({"event_id": n, "ts": t, "user_id": 1, "event_type": "view", "value": 1.0,
                       "props": '{"k": 1}'}[c] for c in names) for n, t in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(src)

    batch([(1, dt.datetime(2024, 1, 1, 10, 0, 5)), (2, dt.datetime(2024, 1, 1, 10, 5, 0))], 0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = P.stream_rollup(P.domain_stream(stream))
    sink, ck = os.path.join(scratch, "sink"), os.path.join(scratch, "ck")

    def run():
        q = (out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", ck)
             .trigger(availableNow=True).start(sink))
        q.awaitTermination()
        return q

    run()
    batch([(3, dt.datetime(2024, 1, 1, 9, 0, 0))], 1)          # behind the watermark
    q = run()                                                  # resumes from the checkpoint
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    late = spark.read.parquet(sink).where(F.col("timestamp") == F.lit("2024-01-01 09:00:00").cast("timestamp_ntz"))
    assert late.count() == 0


def test_state_attribution_across_micro_batches(spark, scratch):
    import time as _time
    from clickpath.streaming.stateful import stream_attribution_state
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    src = os.path.join(scratch, "src")
    names = [f.name for f in schema.fields]

    def put(i, rows):
        full = [tuple({"event_id": n, "ts": t, "user_id": 7, "event_type": e, "value": 1.0,
                       "props": '{"k": 3}'}[c] for c in names) for n, t, e in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(src)
        _time.sleep(1.1)     # distinct modification times keep the file order

    put(0, [(1, dt.datetime(2024, 1, 1, 10, 0, 20), "view")])
    put(1, [(2, dt.datetime(2024, 1, 1, 10, 30, 40), "purchase"), (3, dt.datetime(2024, 1, 1, 10, 30, 50), "signup")])
    put(2, [(4, dt.datetime(2024, 1, 1, 10, 30, 50) + P.FLUSH, P.HEARTBEAT)])
    put(3, [(5, dt.datetime(2024, 1, 1, 10, 30, 50) + P.FLUSH, P.HEARTBEAT)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = stream_attribution_state(P.domain_stream(stream), as_of="2024-02-01 00:00:00")
    sink = os.path.join(scratch, "sink")
    P.run_available_now(out, sink, os.path.join(scratch, "ck"))
    rows = spark.read.parquet(sink).collect()
    assert [(r.publishers_id, r.conversion_timestamp, r.impression_timestamp, r.time_to_conversion_seconds)
            for r in rows] == [("PID_003", dt.datetime(2024, 1, 1, 10, 30), dt.datetime(2024, 1, 1, 10, 0), 1800)]


def test_live_rows_after_a_replay_are_not_late(spark, scratch):
    """A heartbeat flushes the replay; rows that follow it count, and it counts nothing itself."""
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    src, hb = os.path.join(scratch, "src"), os.path.join(scratch, "hb")
    last = dt.datetime(2024, 1, 1, 10, 5, 30)

    def put(n, t):
        row = {"event_id": n, "ts": t, "user_id": 1, "event_type": "view", "value": 1.0, "props": '{"k": 1}'}
        spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema).coalesce(1).write.mode("append").parquet(src)

    def run(i):
        dom = P.domain_stream(P.event_stream(spark, src, schema, hb))
        P.run_available_now(P.stream_rollup(dom), f"{scratch}/sink", f"{scratch}/ck")
        return sorted(r[0] for r in spark.read.parquet(f"{scratch}/sink").select("timestamp").collect())

    put(1, last)
    P.write_heartbeats(spark, schema, hb, last)
    assert run(0) == [dt.datetime(2024, 1, 1, 10, 5)]
    for n in range(2, 4):
        put(n, last + dt.timedelta(minutes=3 * n))
    assert len(run(1)) >= 2        # the first live minute is closed by the second
    put(5, last + dt.timedelta(hours=1))
    run(2)
    put(6, last + dt.timedelta(hours=2))
    got = run(3)
    assert [dt.datetime(2024, 1, 1, 10, 5) + dt.timedelta(minutes=m) for m in (0, 6, 9)] == got[:3]
    assert all(r.cookie_id is not None for r in spark.read.parquet(f"{scratch}/sink").collect())


def test_state_attribution_takes_a_cookie_in_one_call():
    """All advertisers of a cookie share a state entry and a call; each has its own look-back."""
    import pandas as pd
    from clickpath.streaming.stateful import _attribution_fn

    class State:
        value, wm, timeout = None, 0, None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def getCurrentWatermarkMs(self):
            return self.wm

        def update(self, value):
            self.value = tuple(list(v) for v in value)

        def remove(self):
            self.value = None

        def setTimeoutTimestamp(self, ms):
            self.timeout = ms

    minute = 60_000_000
    rows = [("A", 10 * minute, "view", "P2"), ("A", 10 * minute, "click", "P1"), ("A", 20 * minute, "purchase", "P9"),
            ("A", 20 * minute, "signup", "P9"), ("B", 15 * minute, "view", "P3"), ("B", 40 * minute, "purchase", "P3"),
            ("C", 20 * minute, "purchase", "P1"), ("A", None, "view", "P0"), ("B", 14 * minute, "view", None)]
    pdf = pd.DataFrame(rows, columns=["advertisers_id", "__us", "event_type", "publishers_id"])
    fn, state = _attribution_fn(90 * 60), State()
    assert list(fn(("CID_1",), iter([pdf]), state)) == [] and state.timeout == 20 * 60_000 + 1
    state.wm = 30 * 60_000
    (out,) = fn(("CID_1",), iter([pdf.iloc[:0]]), state)
    assert [tuple(r) for r in out.itertuples(index=False)] == [("A", "P1", "CID_1", 20 * minute, 10 * minute, 600)]
    assert state.value == (["A", "B"], [10 * minute, 15 * minute], ["P1", "P3"], ["B"], [40 * minute])
    state.wm = 101 * 60_000
    (out,) = fn(("CID_1",), iter([]), state)
    assert [tuple(r) for r in out.itertuples(index=False)] == [("B", "P3", "CID_1", 40 * minute, 15 * minute, 1500)]
    assert state.value == (["B"], [15 * minute], ["P3"], [], []) and state.timeout == 105 * 60_000 + 1
    state.wm = 106 * 60_000
    assert list(fn(("CID_1",), iter([]), state)) == [] and not state.exists
    assert list(fn((None,), iter([pdf]), state)) == [] and not state.exists
