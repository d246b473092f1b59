"""The tracker on timers: the same answers for any cut into micro-batches, and state that ends."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from clickpath.operators.attribution import eligible_conversions
from clickpath.streaming import pipeline as P
from clickpath.streaming import tracker as TR

T0 = dt.datetime(2024, 1, 1, 10, 0)


class Source:
    """A folder of event files, read one a trigger in the order they were put."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, os.path.join(folder, "src"), 0
        self.schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
        os.makedirs(self.folder)

    def put(self, rows):
        """rows: (event_id, ts, user_id, event_type, k)"""
        full = [tuple({"event_id": i, "ts": t, "user_id": u, "event_type": e, "value": 1.0, "props": f'{{"k": {k}}}'}[f.name]
                      for f in self.schema.fields) for i, t, u, e, k in rows]
        part = os.path.join(os.path.dirname(self.folder), f"put-{self.n}")
        self.spark.createDataFrame(full, self.schema).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.startswith("part-"))
        to = os.path.join(self.folder, f"{self.n:05d}.parquet")
        with open(os.path.join(part, name), "rb") as a, open(to, "wb") as b:
            b.write(a.read())
        self.n += 1
        os.utime(to, (1_700_000_000 + 10 * self.n,) * 2)

    def events(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


def run(spark, scratch, source, delay, name="a"):
    dom = P.domain_stream(source.events(), delay)
    with TR.rocksdb_state(spark):
        P.run_available_now(TR.stream_cookie_window(dom), f"{scratch}/sink-{name}", f"{scratch}/ck-{name}")
    return {(r.conversion_id, r.eligible) for r in spark.read.parquet(f"{scratch}/sink-{name}").collect()}


def heartbeats(source, last, n=2):
    for _ in range(n):
        source.put([(None, last, None, P.HEARTBEAT, 0)])


def test_impression_one_batch_after_its_conversion_counts(spark, scratch):
    source = Source(spark, scratch)
    source.put([(1, T0, 7, "purchase", 1), (2, T0, 8, "purchase", 1)])
    source.put([(3, T0 - dt.timedelta(minutes=2), 7, "view", 1), (4, T0 + dt.timedelta(minutes=1), 8, "view", 1)])
    heartbeats(source, T0 + dt.timedelta(hours=5))
    assert run(spark, scratch, source, "10 minutes") == {("1", True), ("2", False)}


@pytest.mark.parametrize("files,seed", [(1, 1), (4, 2), (9, 3)])
def test_any_split_equals_the_batch_operator(spark, scratch, files, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        minute = T0 + dt.timedelta(minutes=rng.randrange(900), seconds=rng.randrange(60))
        rows.append((i, minute, rng.randrange(6), rng.choice(["view", "click", "purchase", "signup", "error"]), rng.randrange(20)))
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(100)))       # out of order by 100 minutes at most
    cuts = sorted(rng.sample(range(1, len(rows)), files - 1))
    source = Source(spark, scratch)
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        source.put(rows[a:b])
    heartbeats(source, T0 + dt.timedelta(days=2))
    got = run(spark, scratch, source, "101 minutes")
    dom = P.domain_stream(spark.read.schema(source.schema).parquet(source.folder)).withColumn("timestamp", F.col("ts").cast("timestamp_ntz"))
    attempts = dom.where(F.col("event_type").isin("purchase", "signup"))
    ok = eligible_conversions(dom.where(F.col("event_type").isin("view", "click")), attempts)
    good = {str(r.event_id) for r in ok.collect()}
    assert got == {(str(r[0]), str(r[0]) in good) for r in rows if r[3] in ("purchase", "signup")}
    assert 0 < len(good) < len(got)
    # two days on nothing is left of any cookie
    assert TR.state_left(spark, f"{scratch}/ck-a").count() == 0


def test_state_keeps_what_can_still_be_reached(spark, scratch):
    source = Source(spark, scratch)
    minutes = [0, 30, 60, 95, 130]
    source.put([(i, T0 + dt.timedelta(minutes=m), 1, "view", 1) for i, m in enumerate(minutes)] + [(9, T0, 2, "view", 1)])
    source.put([(20, T0 + dt.timedelta(minutes=140), 1, "purchase", 1)])
    source.put([(21, T0 + dt.timedelta(minutes=150), 3, "view", 1)])
    source.put([(22, T0 + dt.timedelta(minutes=150), 3, "view", 1)])
    run(spark, scratch, source, "0 seconds")
    left = sorted((r.state, r.cookie_id, int((r.timestamp - T0).total_seconds()) // 60) for r in TR.state_left(spark, f"{scratch}/ck-a").collect())
    assert left == [(TR.SEEN, "CID_1", m) for m in (60, 95, 130)] + [(TR.SEEN, "CID_3", 150)]


class Handle:
    """State of one key in plain lists; counts the timers that are set."""

    def __init__(self):
        self.lists, self.timers, self.set = {}, set(), 0

    def getListState(self, name, schema):
        handle, self.lists[name] = self, []

        class Listed:
            get = staticmethod(lambda: iter(list(handle.lists[name])))
            appendList = staticmethod(lambda rows: handle.lists[name].extend(rows))
            put = staticmethod(lambda rows: handle.lists.update({name: list(rows)}))
            clear = staticmethod(lambda: handle.lists.update({name: []}))
        return Listed()

    def registerTimer(self, ms):
        self.timers.add(ms)
        self.set += 1


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_one_timer_a_cookie_and_batch():
    """Many waiting minutes need one timer: it moves on to the next time at which something leaves."""
    import pandas as pd
    minute, n = 60_000, 40
    rows = [(m * minute * 1000, "purchase", "AID_1", str(m)) for m in range(100, 100 + n)]
    rows += [(m * minute * 1000, "view", "AID_1", f"i{m}") for m in range(95, 100)] + [(None, "view", "AID_1", "none")]
    window, handle = TR.CookieWindow(90 * 60), Handle()
    window.init(handle)
    window.handleInputRows(("CID_1",), iter([pd.DataFrame(rows, columns=["us", "event_type", "advertisers_id", "event_id"])]), Clock(0))
    assert handle.set == 1 and handle.timers == {100 * minute}

    judged, fired = [], 0
    for wm in (100, 110, 130, 184, 185, 186, 190, 191):      # in minutes
        for at in sorted(t for t in handle.timers if t <= wm * minute):
            for pdf in window.handleExpiredTimer(("CID_1",), Clock(wm * minute), None):
                judged += zip(pdf["conversion_id"], pdf["eligible"])
            handle.timers.discard(at)
            fired += 1
        waits = [w[0] // 1000 for w in handle.lists[TR.WAITING]]
        assert all(w >= wm * minute for w in waits)
        left = [s[0] // 60_000_000 for s in handle.lists[TR.SEEN]]
        assert left == [m for m in range(95, 100) if m >= min([wm, *(w // minute for w in waits)]) - 90]
        assert bool(handle.timers) == bool(waits or left)
    assert sorted(judged) == [(str(m), True) for m in range(100, 100 + n)]
    assert fired < 10 and not any(handle.lists.values())
