"""Late rows restated: any order of arrival ends in the batch result, and only touched periods change."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from clickpath.operators.attribution import first_touch_attribution
from clickpath.operators.rollup import impression_rollup
from clickpath.streaming import pipeline as P
from clickpath.streaming.restate import Restated

T0 = dt.datetime(2024, 1, 1, 10, 0)


def domain(spark, rows):
    """rows: (event_id, minutes after T0, cookie number, event_type, k)"""
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    full = [tuple({"event_id": i, "ts": T0 + dt.timedelta(minutes=m), "user_id": u, "event_type": e, "value": 1.0,
                   "props": f'{{"k": {k}}}'}[f.name] for f in schema.fields) for i, m, u, e, k in rows]
    return P.domain_stream(spark.createDataFrame(full, schema))


def files(base, name):
    return {os.path.join(d, f) for d, _, fs in os.walk(os.path.join(base, name)) for f in fs if f.startswith("part-")}


def test_out_of_order_batches_equal_the_batch_result(spark, scratch):
    rng = random.Random(6)
    rows = [(i, rng.randrange(1200), rng.randrange(5), rng.choice(["view", "view", "purchase", "error"]), rng.randrange(20)) for i in range(500)]
    rows.sort(key=lambda r: r[1] + (rng.random() < 0.1) * rng.randrange(600))
    base = os.path.join(scratch, "t")
    tables = Restated(spark, base, as_of="2024-02-01")
    for n, at in enumerate(range(0, 500, 125)):
        tables.intake(domain(spark, rows[at:at + 125]), n)
        if n == 2:
            tables.intake(domain(spark, rows[at:at + 125]), n)      # a replayed batch changes nothing
            tables.restate()
    tables.restate()
    tables.finish()
    dom = domain(spark, rows).withColumn("timestamp", F.col("ts").cast("timestamp_ntz"))
    imp = impression_rollup(dom.where("event_type = 'view'").withColumn("bucket_date", F.col("timestamp")))
    conv = dom.where("event_type = 'purchase'").select("advertisers_id", "timestamp", "cookie_id")
    want = first_touch_attribution(imp, conv, as_of="2024-02-01")
    key = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()))
    assert key(tables.rollup(), imp.columns) == key(imp, imp.columns)
    assert key(tables.attributed(), want.columns) == key(want, want.columns) and want.count() > 20
    late = {r.event_id for r in tables.late().collect()}
    assert 0 < len(late) < 100
    before = {n: files(base, n) for n in ("rollup", "attributed")}
    tables.restate()                                               # twice: same rows
    assert key(tables.attributed(), want.columns) == key(want, want.columns)
    changed = {f.split("period=")[1].split("/")[0] for f in files(base, "rollup") - before["rollup"]}
    touched = {str(r.period) for r in tables.late().where("event_type = 'view'").select("period").distinct().collect()}
    assert changed == touched and len(touched) < tables.rollup().select("period").distinct().count()


def test_a_late_impression_reaches_the_next_period(spark, scratch):
    tables = Restated(spark, os.path.join(scratch, "t"), as_of="2024-02-01")
    tables.intake(domain(spark, [(1, 70, 1, "purchase", 3), (2, 400, 2, "view", 3)]), 0)
    assert tables.attributed().count() == 0
    tables.intake(domain(spark, [(3, 10, 1, "view", 3)]), 1)
    tables.restate()
    got = tables.attributed().collect()
    assert [(r.conversion_timestamp, r.impression_timestamp) for r in got] == [(T0 + dt.timedelta(minutes=70), T0 + dt.timedelta(minutes=10))]
