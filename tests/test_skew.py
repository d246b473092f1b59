"""Hot keys: one cookie with a large share of all rows must not land in one task."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import pytest

from clickpath.operators.lookup import earliest_lookup, range_lookup
from tests.conftest import CONV_SCHEMA, IMP_SCHEMA


@pytest.mark.parametrize("form", ["running", "sliding"])
def test_hot_cookie_spreads_over_window_partitions(spark, form):
    base = dt.datetime(2024, 1, 1)
    hot = [("P1", "A1", "HOT", base + dt.timedelta(minutes=m), 1) for m in range(0, 3000)]
    cold = [("P1", "A1", f"C{i}", base + dt.timedelta(minutes=i), 1) for i in range(3000)]
    imp = spark.createDataFrame(hot + cold, IMP_SCHEMA)
    conv = spark.createDataFrame([("A1", base + dt.timedelta(minutes=m + 1), "HOT") for m in range(0, 3000, 3)],
                                 CONV_SCHEMA).withColumnRenamed("timestamp", "conversion_timestamp")
    spark.conf.set("spark.sql.adaptive.enabled", "false")     # observe the raw hash partitioning
    try:
        args = (imp, conv, ["advertisers_id", "cookie_id"], "timestamp", "conversion_timestamp",
                F.struct("timestamp", "publishers_id"), -90 * 60 * 1_000_000, -1)
        out = earliest_lookup(*args) if form == "running" else range_lookup(*args, "min")
        per_task = (out.where(F.col("cookie_id") == "HOT").groupBy(F.spark_partition_id().alias("p")).count()
                    .collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    counts = sorted(r["count"] for r in per_task)
    assert sum(counts) == 1000                 # every hot conversion answered
    assert out.where(F.col("__hit").isNull()).count() == 0
    assert len(counts) >= 4                     # ... by several tasks
    assert counts[-1] <= 0.5 * sum(counts)      # no task holds most of the hot key
