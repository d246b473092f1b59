"""Micro-fixtures for first-touch attribution edges (FIXTURES.md section 3)."""

from __future__ import annotations

import pytest

from clickpath.operators.attribution import eligible_conversions, first_touch_attribution
from tests.conftest import CONV_SCHEMA, IMP_SCHEMA, ts

AS_OF = "2024-02-01 00:00:00"
STRATEGIES = ("window", "range", "join")


def _attr(spark, imps, convs, strategy, **kw):
    i = spark.createDataFrame(imps, IMP_SCHEMA)
    c = spark.createDataFrame(convs, CONV_SCHEMA)
    out = first_touch_attribution(i, c, as_of=AS_OF, strategy=strategy, **kw)
    return sorted(tuple(r) for r in out.select("advertisers_id", "publishers_id", "cookie_id",
                                               "conversion_timestamp", "impression_timestamp",
                                               "time_to_conversion_seconds").collect())


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_tie_at_first_touch_smallest_publisher_wins(spark, strategy):
    imps = [("PID_B", "AID_1", "C1", ts("2024-01-01 10:00"), 1), ("PID_A", "AID_1", "C1", ts("2024-01-01 10:00"), 1)]
    convs = [("AID_1", ts("2024-01-01 10:30"), "C1")]
    assert _attr(spark, imps, convs, strategy) == [
        ("AID_1", "PID_A", "C1", ts("2024-01-01 10:30"), ts("2024-01-01 10:00"), 1800)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_same_minute_impression_not_attributed(spark, strategy):
    imps = [("PID_A", "AID_1", "C1", ts("2024-01-01 10:30"), 1)]
    convs = [("AID_1", ts("2024-01-01 10:30"), "C1")]
    assert _attr(spark, imps, convs, strategy) == []


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_lookback_edge(spark, strategy):
    # exactly 90 min before counts; 91 min before does not
    imps = [("PID_A", "AID_1", "C1", ts("2024-01-01 09:00"), 1), ("PID_B", "AID_1", "C1", ts("2024-01-01 08:59"), 1)]
    convs = [("AID_1", ts("2024-01-01 10:30"), "C1")]
    assert _attr(spark, imps, convs, strategy) == [
        ("AID_1", "PID_A", "C1", ts("2024-01-01 10:30"), ts("2024-01-01 09:00"), 5400)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_duplicate_conversions_collapse(spark, strategy):
    imps = [("PID_A", "AID_1", "C1", ts("2024-01-01 10:00"), 1)]
    convs = [("AID_1", ts("2024-01-01 10:30"), "C1"), ("AID_1", ts("2024-01-01 10:30"), "C1")]
    assert len(_attr(spark, imps, convs, strategy)) == 1


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_other_advertiser_not_attributed_but_cookie_eligible(spark, strategy):
    imps = [("PID_A", "AID_2", "C1", ts("2024-01-01 10:00"), 1)]
    convs = [("AID_1", ts("2024-01-01 10:30"), "C1")]
    assert _attr(spark, imps, convs, strategy) == []
    i = spark.createDataFrame(imps, IMP_SCHEMA)
    c = spark.createDataFrame(convs, CONV_SCHEMA)
    assert eligible_conversions(i, c).count() == 1


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_bucket_boundary_and_hot_cookie(spark, strategy):
    """Conversions right after a bucket boundary still see impressions from the
    previous bucket; a cookie with many rows gives the same answer as brute force."""
    import datetime as dt
    base = ts("2024-01-01 00:00")
    imps, convs = [], []
    for m in range(0, 600, 7):
        imps.append((f"PID_{m % 13:02d}", "AID_1", "HOT", base + dt.timedelta(minutes=m), 1))
    for m in range(3, 600, 11):
        convs.append(("AID_1", base + dt.timedelta(minutes=m), "HOT"))
    got = _attr(spark, imps, convs, strategy, lookback_seconds=3600, span_factor=1)
    want = []
    for (_, ct, _) in convs:
        cands = sorted((it, p) for (p, _, _, it, _) in imps if ct - dt.timedelta(hours=1) <= it < ct)
        if cands:
            it, p = cands[0]
            want.append(("AID_1", p, "HOT", ct, it, int((ct - it).total_seconds())))
    assert got == sorted(want)


def test_window_and_join_agree_on_supplied_tables(spark):
    from tests.conftest import SF_MID
    from clickpath.plans import domain
    a = domain.attributed(spark, SF_MID, lookback_seconds=24 * 3600)
    b = domain.attributed(spark, SF_MID, lookback_seconds=24 * 3600, strategy="join")
    assert a.count() == b.count() == 570
    assert a.exceptAll(b).count() == 0


def test_invariants(spark):
    from tests.conftest import SF_MID
    from pyspark.sql import functions as F
    from clickpath.plans import domain
    a = domain.attributed(spark, SF_MID, lookback_seconds=24 * 3600)
    row = a.agg(F.min("time_to_conversion_seconds").alias("lo"), F.max("time_to_conversion_seconds").alias("hi"),
                F.count_if(F.col("impression_timestamp") >= F.col("conversion_timestamp")).alias("bad")).first()
    assert row.lo > 0 and row.hi <= 24 * 3600 and row.bad == 0


def test_eligibility_across_bucket_boundaries_matches_brute_force(spark):
    import datetime as dt
    import random
    rnd = random.Random(5)
    base = ts("2024-01-01 00:00")
    imps = [("P1", "A9", f"C{rnd.randrange(3)}", base + dt.timedelta(minutes=rnd.randrange(0, 500)), 1)
            for _ in range(60)]
    convs = [("A1", base + dt.timedelta(minutes=rnd.randrange(0, 500)), f"C{rnd.randrange(3)}") for _ in range(80)]
    out = eligible_conversions(spark.createDataFrame(imps, IMP_SCHEMA), spark.createDataFrame(convs, CONV_SCHEMA),
                               window_seconds=1800, span_factor=1)
    got = sorted((r.cookie_id, r.timestamp) for r in out.collect())
    want = sorted((c, t) for (_, t, c) in convs
                  if any(ic == c and t - dt.timedelta(minutes=30) <= it <= t for (_, _, ic, it, _) in imps))
    assert got == want
