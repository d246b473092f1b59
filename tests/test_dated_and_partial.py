"""As-of rates, hourly partial states and update-mode velocity."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from clickpath.operators import partials as PA
from clickpath.operators import payout as PO
from clickpath.operators import reports as R
from clickpath.streaming import pipeline as P
from clickpath.streaming import velocity as VE
from tests.conftest import ATT_SCHEMA, IMP_SCHEMA

T0 = dt.datetime(2024, 1, 1)


def test_asof_lookup_equals_brute_force(spark):
    rng = random.Random(12)
    at = lambda: T0 + dt.timedelta(minutes=rng.randrange(20 * 1440))
    changes = [(rng.choice("abc"), at(), rng.randrange(100)) for _ in range(40)]
    changes += [("a", T0 + dt.timedelta(days=3), 1), ("a", T0 + dt.timedelta(days=3), 7), (None, T0, 5), ("b", None, 5)]
    probes = {(rng.choice("aaaaabcd"), at()) for _ in range(500)} | {(c[0], c[1]) for c in changes if c[0] and c[1]}
    probes |= {("a", T0 + dt.timedelta(days=d)) for d in range(20)} | {(None, T0)}
    for seconds in (3600, 86400, 40 * 86400):
        got = PO.asof_lookup(spark.createDataFrame(changes, "k string, t timestamp_ntz, v int"),
                             spark.createDataFrame(list(probes), "k string, t timestamp_ntz"),
                             ["k"], "t", "t", F.struct("v"), "rate", seconds).collect()
        assert len(got) == len(probes)
        for r in got:
            under = [(c[1], c[2]) for c in changes if r.k is not None and c[0] == r.k and c[1] is not None and c[1] <= r.t]
            assert (r.rate.v if r.rate else None) == (max(under)[1] if under else None)


def test_payouts_report_what_has_no_rate(spark):
    att = spark.createDataFrame([("A", "P", "c", T0 + dt.timedelta(hours=h), T0, 1, T0) for h in (0, 23, 24, 25, 25, 60)]
                                + [("B", "P", "c", T0, T0, 1, T0)], ATT_SCHEMA)
    rates = spark.createDataFrame([("A", T0 + dt.timedelta(hours=24), 150, 1000), ("A", T0 + dt.timedelta(hours=50), 300, 1000)],
                                  "advertisers_id string, valid_from timestamp_ntz, payout_cents bigint, value_cents bigint")
    got = {r.advertisers_id: r for r in PO.payout_report(att, rates).collect()}
    a, b = got["A"], got["B"]
    assert (a.conversions, a.unrated_conversions, a.payout, a.value) == (6, 2, 7.5, 40.0) and a.roi == round((4000 - 750) / 750, 6)
    assert (b.conversions, b.unrated_conversions, b.payout, b.roi) == (1, 1, 0.0, None)


def test_partials_unite_over_any_window(spark, scratch):
    rng = random.Random(3)
    rows = [(rng.choice(["P", "P", "P", "Q", None]), "A", f"c{rng.randrange(9000)}", T0 + dt.timedelta(minutes=rng.randrange(4 * 1440)), rng.randint(1, 3))
            for _ in range(30_000)]
    imps = spark.createDataFrame(rows, IMP_SCHEMA)
    path = os.path.join(scratch, "hours")
    PA.write_partials(PA.hourly_partials(imps, "publishers_id"), path)
    day = T0 + dt.timedelta(days=2)
    PA.write_partials(PA.hourly_partials(imps.where(F.col("timestamp") >= F.lit(str(day)).cast("timestamp_ntz")), "publishers_id"), path)
    for start, end in ((T0, T0 + dt.timedelta(days=4)), (T0 + dt.timedelta(hours=7), day), (day, day + dt.timedelta(hours=1))):
        some = [r for r in rows if r[0] and start <= r[3] < end]
        read = PA.read_partials(spark, path, start, end)
        for r in PA.reach(read).collect():
            own = [x for x in some if x[0] == r.publishers_id]
            users = len({x[2] for x in own})
            assert r.impressions == sum(x[4] for x in own) and abs(r.approx_unique_users - users) <= 1 + users * PA.STATED_ERROR
    whole = PA.read_partials(spark, path, T0, T0 + dt.timedelta(days=4))
    direct = R.historical_publisher_baseline(imps.where("publishers_id is not null"), T0 + dt.timedelta(days=4))
    assert {r.publishers_id: (round(r.avg_impressions, 9), round(r.avg_conversion_rate, 3)) for r in PA.baseline(whole).collect()} == {
        r.publishers_id: (round(r.avg_impressions, 9), round(r.avg_conversion_rate, 3)) for r in direct.collect()}
    # the read names hours, not facts, and only the days' folders
    plan = PA.read_partials(spark, path, day, day + dt.timedelta(hours=1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day_key" in plan and "20240103" in plan


def test_velocity_levels_rise_and_a_replayed_batch_changes_nothing(spark, scratch):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    src, base, ck = (os.path.join(scratch, x) for x in ("src", "updates", "ck"))

    def put(ids):
        rows = [tuple({"event_id": i, "ts": T0 + dt.timedelta(seconds=i), "user_id": 1, "event_type": "purchase", "value": 1.0,
                       "props": '{"k": 1}'}[f.name] for f in schema.fields) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    done = 0
    for n in (3, 4, 1, 6, 6):                      # 3, 7, 8, 14, 20 conversions within one minute
        put(range(done, done + n))
        done += n
        dom = P.domain_stream(spark.readStream.schema(schema).parquet(src))
        P.run_foreach_batch(VE.velocity_updates(dom), VE.updates_sink(base), ck, "update")
    rows = VE.updates(spark, base)
    assert [r.conversion_count for r in rows.orderBy("batch_id").collect()] == [3, 7, 8, 14, 20]
    now = VE.current(rows).collect()
    assert [(r.cookie_id, r.conversion_count, r.risk_level, r.updates) for r in now] == [("CID_1", 20, "high", 5)]
    assert [r.levels for r in VE.levels(rows).collect()] == ["clean>low>medium>high"]
    last = rows.where("batch_id = 4").drop("batch_id").collect()
    VE.updates_sink(base)(spark.createDataFrame(last, "cookie_id string, timestamp timestamp_ntz, conversion_count bigint, risk_level string"), 4)
    assert VE.current(VE.updates(spark, base)).collect() == now
