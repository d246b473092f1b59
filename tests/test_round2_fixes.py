"""Bounds that reach the scan, rules for empty lists, scalar edge cases, the stream tracker."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickpath.functions.ids import publisher_cohort
from clickpath.functions.series import parse_series, series_total
from clickpath.functions.text import format_metric, truncate_text
from clickpath.operators import fraud as FR
from clickpath.operators import rollup
from clickpath.plans import QUERIES
from tests.conftest import SF_SMALL

BOUNDED = ("ttl_filter", "retention_purge", "time_slice", "cookie_in_list", "having",
           "conversion_rate_window", "realtime_vs_history", "suspect_cookie_profile", "conversion_rate_windows",
           "fraud_stage1", "top_publishers", "top_publishers_reach", "approx_reach", "advertiser_daily", "publisher_daily",
           "historical_publisher_baseline", "overview_counts")


@pytest.mark.parametrize("name", BOUNDED)
def test_time_bound_reaches_the_scan(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_lake_scan_reads_only_its_hours(spark):
    df = QUERIES["scan_lake_table"](spark, SF_SMALL)
    assert "GreaterThanOrEqual(timestamp" in df._jdf.queryExecution().executedPlan().toString()
    hours = {int(f.split("hour_key=")[1].split("/")[0]) for f in df.inputFiles()}
    assert hours and min(hours) >= 2024011006 and max(hours) <= 2024011218


def test_scan_keeps_every_bucket(spark):
    minute = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(minute, b) for b in range(16)], "bucket_date timestamp_ntz, bucket int")
    assert rollup.scan_minute_buckets(df, minute).count() == 16
    assert rollup.scan_minute_range(df, minute, "2024-01-01 00:01:00").count() == 16


def test_empty_cookie_list_is_no_filter(spark):
    df = spark.createDataFrame([("a",), ("b",)], "cookie_id string")
    none = spark.createDataFrame([], "cookie_id string")
    assert FR._cookie_filter(df, none).count() == FR._cookie_filter(df, []).count() == 2
    assert FR._cookie_filter(df, df.limit(1)).count() == 1


def test_stage1_rows_can_be_searched_and_exported(spark):
    conv = spark.createDataFrame([(dt.datetime(2024, 1, 1), f"CID_{i % 150}") for i in range(400)], "bucket_date timestamp_ntz, cookie_id string")
    stage = FR.fraud_stage1(conv, "2024-01-01 00:01:00", limit=None)
    assert stage.count() == 150
    report = FR.stage1_report(stage)
    assert FR.fraud_search(report, "cid_7").count() == 11
    assert FR.fraud_csv_rows(report).where("`Sample Publishers` = ''").count() == 150


def _one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x")).first()[0]


def test_scalar_edges(spark):
    bytes_ = lambda c: format_metric(F.col(c), F.lit("used_bytes"))
    assert _one(spark, 0.5, "double", bytes_) == "0.5 Bytes"
    assert _one(spark, 2048.0, "double", bytes_) == "2 KB"
    assert _one(spark, -2048.0, "double", bytes_) == "-2 KB"
    assert _one(spark, None, "double", bytes_) is None
    assert _one(spark, "ab\n\t zz", "string", lambda c: truncate_text(c, 5)) == "ab... [truncated from 7 chars]"
    assert _one(spark, "[[1,2],[3,4]] junk", "string", parse_series) == []
    assert _one(spark, "[[1,2],[3,4]] junk", "string", series_total) == 0
    assert [tuple(r) for r in _one(spark, '[{"ts": null, "count": 3}, {"count": 2}, [5]]', "string", parse_series)] == [(None, 3)]
    assert _one(spark, "PID_TECH_001", "string", publisher_cohort) == "TECH"
    assert _one(spark, "PID_001", "string", publisher_cohort) is None
    assert _one(spark, "PID_GAMES_1", "string", lambda c: publisher_cohort(c, ("GAMES",))) == "GAMES"


def test_tracker_takes_all_impressions_of_a_batch_first(spark, scratch):
    """One key over many Arrow batches, conversions stored before their impressions."""
    from clickpath.streaming import pipeline as P
    from clickpath.streaming import tracker as TR
    base = dt.datetime(2024, 1, 5)
    n = 300
    rows = [(i, base + dt.timedelta(minutes=30), 1, "purchase", 1.0, '{"k": 1}') for i in range(n)]
    rows += [(n + i, base, 1, "view", 1.0, '{"k": 1}') for i in range(n)]
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    names = [f.name for f in schema.fields]
    cols = dict(zip(("event_id", "ts", "user_id", "event_type", "value", "props"), range(6)))
    data = [tuple(r[cols[c]] if c in cols else None for c in names) for r in rows]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{scratch}/in")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        # a conversion is judged when the watermark has passed it: heartbeats move it on
        P.write_heartbeats(spark, schema, f"{scratch}/hb", base + dt.timedelta(minutes=30))
        dom = P.domain_stream(P.event_stream(spark, f"{scratch}/in", schema, f"{scratch}/hb"))
        with TR.rocksdb_state(spark):
            P.run_available_now(TR.stream_cookie_window(dom), f"{scratch}/sink", f"{scratch}/ck")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert spark.read.parquet(f"{scratch}/sink").where("eligible").count() == n
