"""Sinks and table maintenance round trips on scratch folders."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from clickpath.sources import lake as L
from clickpath.streaming.stateful import dual_write_sink
from tests.conftest import IMP_SCHEMA, ts


def _imps(spark):
    rows = [("P1", "A1", "C1", ts("2024-01-01 10:00"), 1), ("P2", "A1", "C2", ts("2024-01-01 11:30"), 2),
            ("P1", "A2", "C1", ts("2024-01-02 09:00"), 3)]
    return spark.createDataFrame(rows, IMP_SCHEMA)


def test_lake_write_and_pruned_scan(spark, scratch):
    path = os.path.join(scratch, "imp")
    L.append_facts(_imps(spark), path, "timestamp", "publishers_id")
    L.append_facts(_imps(spark), path, "timestamp", "publishers_id")       # append twice
    df = L.scan_lake_table(spark, path, "timestamp", "2024-01-01 11:00:00", "2024-01-02 00:00:00")
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "hour_key" in plan


def test_versioned_upsert_and_purge(spark, scratch):
    base = os.path.join(scratch, "kv")
    old = spark.createDataFrame([("a", "1", ts("2024-01-01 00:00")), ("b", "2", ts("2024-01-01 00:00"))],
                                "key string, value string, last_update timestamp_ntz")
    L.write_version(spark, old, base)
    new = spark.createDataFrame([("a", "9", ts("2024-01-01 00:05"))], "key string, value string, last_update timestamp_ntz")
    merged = L.upsert_by_key(L.read_table_version(spark, base), new, "key", "last_update")
    L.write_version(spark, merged, base)
    assert {r.key: r.value for r in L.read_table_version(spark, base).collect()} == {"a": "9", "b": "2"}
    assert L.latest_version(spark, base).endswith("v=1")
    for v in ("10", "11", "12"):
        L.write_version(spark, L.read_table_version(spark, base).withColumn("value", F.lit(v)), base)
    assert sorted(n for n in os.listdir(base) if n.startswith("v=")) == ["v=3", "v=4"]   # old versions are removed


def test_lake_table_lifecycle(spark, scratch):
    """Append, scan, purge and truncate on one layout."""
    path = os.path.join(scratch, "imp")
    L.append_facts(_imps(spark), path, "timestamp", "publishers_id")
    scan = lambda: L.scan_lake_table(spark, path, "timestamp")
    L.purge_table(spark, path, "timestamp", "2024-01-02 10:00:00")
    assert scan().count() == 3                                # the row exactly 24 h old is kept
    L.purge_table(spark, path, "timestamp", "2024-01-02 10:30:00")
    assert scan().count() == 2 and L.hours_of(spark, path) == [2024010111, 2024010209]
    L.purge_table(spark, path, "timestamp", "2024-01-02 11:30:00.000001")    # a fraction past the 11:30 row
    assert [r.impressions for r in scan().collect()] == [3]
    L.append_facts(_imps(spark), path, "timestamp", "publishers_id")
    assert scan().count() == 4
    assert L.truncate_all(spark, {"missing": os.path.join(scratch, "nope"), "imp": path})[1] == ("imp", "ok")
    assert scan().count() == 0 and "impressions" in scan().columns
    L.append_facts(_imps(spark), path, "timestamp", "publishers_id")
    L.purge_table(spark, path, "timestamp", "2025-01-01")
    assert scan().count() == 0


def test_a_purge_that_died_is_finished_by_the_next(spark, scratch):
    path = os.path.join(scratch, "imp")
    L.append_facts(_imps(spark), path, "timestamp", "publishers_id")
    staged = os.path.join(path, "_purge-x")
    edge = spark.read.parquet(path).where("hour_key = 2024010111")
    edge.withColumn("impressions", F.lit(9)).write.partitionBy("hour_key", "id_bucket").parquet(staged)
    L._fs(spark, path)[0].delete(L._fs(spark, path)[1](path, "hour_key=2024010111"), True)     # died before the rename
    L.purge_table(spark, path, "timestamp", "2024-01-02 10:00:00")
    assert sorted(r.impressions for r in L.scan_lake_table(spark, path, "timestamp").collect()) == [1, 3, 9]


def test_dual_write_is_idempotent(spark, scratch):
    sinks = {"all": (os.path.join(scratch, "all"), lambda b: b),
             "p1": (os.path.join(scratch, "p1"), lambda b: b.where(F.col("publishers_id") == "P1"))}
    fn = dual_write_sink(sinks)
    fn(_imps(spark), 0)
    fn(_imps(spark), 0)      # a retried batch rewrites, it does not duplicate
    assert spark.read.parquet(os.path.join(scratch, "all")).count() == 3
    assert spark.read.parquet(os.path.join(scratch, "p1")).count() == 2


def test_sample_rows_and_counts(spark):
    df = spark.createDataFrame([("x" * 40, b"abc")], "t string, b binary")
    r = L.sample_rows(df).first()
    assert r.t == "x" * 30 + "..." and r.b == "<binary: 3 bytes>"
    counts = {r.table_name: r.row_count for r in L.table_row_counts({"a": df, "b": df.limit(0)}).collect()}
    assert counts == {"a": 1, "b": 0}
    broken = lambda: spark.read.parquet("/nowhere/at/all")
    assert {r.table_name: r.row_count for r in L.table_row_counts({"a": lambda: df, "x": broken}).collect()} == {"a": 1, "x": -1}


def test_failed_version_write_is_invisible_and_retried(spark, scratch):
    base = os.path.join(scratch, "t")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    L.write_version(spark, df, base)
    # simulate a crash: files of v=1 without the _SUCCESS marker
    df.write.parquet(os.path.join(base, "v=1"))
    os.remove(os.path.join(base, "v=1", "_SUCCESS"))
    assert L.latest_version(spark, base).endswith("v=0")
    path = L.write_version(spark, df.withColumn("v", F.lit(2)), base)
    assert path.endswith("v=1") and L.read_table_version(spark, base).first().v == 2


def test_export_fraud_csv(spark, scratch):
    from clickpath.operators import fraud
    df = spark.createDataFrame([("C1", 12, 6, ["PID_001", "PID_002"])],
                               "cookie_id string, total_conversions_last_minute long, "
                               "unique_publishers_last_90m long, sample_publishers_90m array<string>")
    path = os.path.join(scratch, "csv")
    fraud.export_fraud_csv(fraud.fraud_report(df), path)
    back = spark.read.option("header", True).csv(path).collect()
    assert len(back) == 1
    r = back[0].asDict()
    assert r["Risk Level"] == "medium" and r["Sample Publishers"] == "PID_001; PID_002"
    assert r["Suspicious Patterns"] == "High conversion velocity; Diverse publisher activity" and r["Risk Score"] == "42"
