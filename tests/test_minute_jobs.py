"""Replay the minute jobs (rollup -> attribution -> publishing) and compare with batch."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from clickpath.functions.series import parse_series
from clickpath.operators import jobs, rollup
from clickpath.operators.attribution import first_touch_attribution
from clickpath.operators.rollup import conversion_facts
from clickpath.sources import adapters, lake
from tests.conftest import SF_SMALL


def test_minute_jobs_equal_batch(spark, scratch):
    raw_i = adapters.raw_impressions(spark, SF_SMALL)
    raw_c = adapters.raw_conversions(spark, SF_SMALL)
    imp_path, conv_path = os.path.join(scratch, "imp"), os.path.join(scratch, "conv")
    att_path, series = os.path.join(scratch, "att"), os.path.join(scratch, "series")
    # conversion minutes that have an attribution in the batch run, plus their look-back
    batch_imp = adapters.impression_tracking(spark, SF_SMALL)
    batch_att = first_touch_attribution(batch_imp, conversion_facts(raw_c), as_of="2024-02-01 00:00:00")
    targets = sorted({r[0] for r in batch_att.select("conversion_timestamp").collect()})
    assert targets, "fixture must attribute something"
    # load the lake tables once (the per-minute rollup job is exercised on the first minutes below)
    lake.append_facts(batch_imp, imp_path, "timestamp", "publishers_id")
    lake.append_facts(conversion_facts(raw_c), conv_path, "timestamp", "advertisers_id")
    for m in targets:
        jobs.attribute_minute(spark, imp_path, conv_path, m, att_path, as_of="2024-02-01 00:00:00")
    jobs.attribute_minute(spark, imp_path, conv_path, targets[0], att_path, as_of="2024-02-01 00:00:00")   # a retried minute
    got = spark.read.parquet(att_path).drop("hour_key", "minute_key")
    assert got.count() == batch_att.count()
    assert got.select(batch_att.columns).exceptAll(batch_att).count() == 0

    minutes = sorted({r[0] for r in raw_i.select("bucket_date").limit(3).collect()})
    roll_path = os.path.join(scratch, "roll")
    for m in minutes:
        stats = jobs.rollup_minute(raw_i, m, roll_path)
        raw_rows = raw_i.where(F.col("bucket_date") == F.lit(m)).count()
        assert stats["impressions_processed"] == raw_rows and stats["impressions_batches"] == 1
        jobs.publish_minute(spark, roll_path, series, m, as_of="2024-02-01 00:00:00")
    final = lake.read_table_version(spark, series)
    assert final.count() == spark.read.parquet(roll_path).select("publishers_id").distinct().count()


def test_attribute_minute_prunes_partitions(spark, scratch):
    imp_path, conv_path = os.path.join(scratch, "imp"), os.path.join(scratch, "conv")
    lake.append_facts(adapters.impression_tracking(spark, SF_SMALL), imp_path, "timestamp", "publishers_id")
    lake.append_facts(adapters.conversion_tracking(spark, SF_SMALL), conv_path, "timestamp", "advertisers_id")
    out = jobs.attribute_minute(spark, imp_path, conv_path, dt.datetime(2024, 1, 10, 12, 0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(hour_key") >= 2
    assert "GreaterThanOrEqual(timestamp" in plan


def test_published_series_equal_batch(spark, scratch):
    """All four series: replaying the minutes gives the batch totals of those minutes."""
    raw_c = adapters.raw_conversions(spark, SF_SMALL)
    imp, conv = adapters.impression_tracking(spark, SF_SMALL), conversion_facts(raw_c)
    att = first_touch_attribution(imp, conv, as_of="2024-02-01 00:00:00")
    paths = {n: os.path.join(scratch, n) for n in ("imp", "conv", "att")}
    lake.append_facts(imp, paths["imp"], "timestamp", "publishers_id")
    lake.append_facts(conv, paths["conv"], "timestamp", "advertisers_id")
    lake.append_facts(att, paths["att"], "conversion_timestamp", "publishers_id")
    minutes = sorted({r[0] for r in att.select("impression_timestamp").collect()})[:2]
    minutes.append(minutes[0] + dt.timedelta(minutes=5))
    wanted = {("publishers", "impressions"): ("imp", rollup.entity_metric(imp, "publishers", "impressions")),
              ("advertisers", "impressions"): ("imp", rollup.entity_metric(imp, "advertisers", "impressions")),
              ("advertisers", "conversions"): ("conv", rollup.entity_metric(conv, "advertisers", "conversions")),
              ("publishers", "conversions"): ("att", rollup.publisher_conversions_trailing(att))}
    for (entity, metric), (table, batch) in wanted.items():
        base = os.path.join(scratch, f"{entity}-{metric}")
        for m in minutes:
            jobs.publish_minute(spark, paths[table], base, m, entity, as_of="2024-02-01 00:00:00", metric=metric)
        id_col = f"{entity}_id"
        got = {(r[0], int(t), n) for r in lake.read_table_version(spark, base).select(id_col, parse_series(metric)).collect() for t, n in r[1]}
        want = {(r[0], int(r[1].replace(tzinfo=dt.timezone.utc).timestamp()), r[2]) for r in
                batch.where(F.col("timestamp").isin(minutes)).select(id_col, "timestamp", f"total_{metric}").collect()}
        assert got == want, (entity, metric)
    assert want, "the trailing count must have rows"
