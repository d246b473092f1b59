"""Point reads that skip, bounds that reach the scans, upserts with a total order, repeatable appends."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from clickpath.operators import fraud as FR
from clickpath.operators import services as SV
from clickpath.plans import QUERIES
from clickpath.sources import lake as L
from clickpath.sources.pointread import point_read, write_sorted
from tests.conftest import CONV_SCHEMA, SF_SMALL

T0 = dt.datetime(2024, 1, 1)


def scanned(df) -> int:
    """Rows that the scans of an executed query have read."""
    qe = df._jdf.queryExecution()
    rows, left = 0, [qe.executedPlan()]
    assert df.collect() is not None
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
            continue
        if name.startswith("Scan"):
            rows += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return rows


def test_point_reads_skip_row_groups(spark, scratch):
    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("C"), F.lpad((F.col("id") % 5000).cast("string"), 5, "0")).alias("cookie_id"),
                               (F.col("id") * 7919 % n).alias("t"), F.concat(F.lit("x"), F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    by_cookie, by_time = os.path.join(scratch, "c"), os.path.join(scratch, "t")
    write_sorted(df, by_cookie, ["cookie_id", "t"], row_group_bytes=256 << 10)
    one = point_read(spark, by_cookie, cookie_id="C01234")
    assert one.count() == n // 5000 and scanned(point_read(spark, by_cookie, cookie_id="C01234")) < n // 10
    # a column that is not sorted by: only its Bloom filter can rule row groups out
    key = df.where("t = 77777").first().key
    for bloom in ((), ("key",)):
        write_sorted(df, by_time, ["t"], bloom=bloom, row_group_bytes=256 << 10, distinct=5000)
        assert point_read(spark, by_time, key=key).count() == 1
        read = scanned(point_read(spark, by_time, key=key))
        assert read < n // 5 if bloom else read > n // 2
        assert point_read(spark, by_time, key="none").count() == 0


def test_fraud_bounds_reach_all_scans(spark):
    for name in ("fraud_report", "fraud_stage2", "export_fraud_csv", "fraud_stage2_unfiltered"):
        df = QUERIES[name](spark, SF_SMALL)
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "events" in x]
        assert scans and all("GreaterThanOrEqual(ts" in x and "LessThan(ts,2024-01-31T00:00" in x for x in scans), name


def test_an_empty_cookie_list_filters_nothing_and_runs_no_job(spark):
    conv = spark.createDataFrame([("A", T0, "c1"), ("A", T0, "c2"), ("A", T0, None)], CONV_SCHEMA)
    cookies = spark.createDataFrame([("c2",), ("c2",), ("c9",)], "cookie_id string")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning"))
    spark.sparkContext.setJobGroup("planning", "planning")
    some, everything = FR._cookie_filter(conv, cookies), FR._cookie_filter(conv, cookies.limit(0))
    assert jobs() == 0
    spark.sparkContext.setJobGroup("rest", "rest")
    assert [r.cookie_id for r in some.collect()] == ["c2"]
    assert everything.count() == 3 and everything.columns == conv.columns


def test_upsert_takes_the_greatest_of_a_batch(spark):
    schema = "k string, a int, b string"
    old = spark.createDataFrame([("x", 1, "old"), ("y", 1, "old")], schema)
    new = [("x", 2, "p"), ("x", 3, "a"), ("x", 3, "q"), ("z", None, None), ("z", None, None)]
    for rows in (new, new[::-1]):
        got = L.upsert_by_key(old, spark.createDataFrame(rows, schema).repartition(3), "k")
        assert sorted((tuple(r) for r in got.collect()), key=str) == [("x", 3, "q"), ("y", 1, "old"), ("z", None, None)]
        by_time = L.upsert_by_key(old, spark.createDataFrame(rows, schema).repartition(3), "k", "a")
        assert {(r.k, r.a, r.b) for r in by_time.collect()} == {("x", 3, "q"), ("y", 1, "old"), ("z", None, None)}


def test_a_repeated_batch_append_adds_nothing(spark, scratch):
    rows = [("A", T0 + dt.timedelta(minutes=m), "c") for m in (5, 50, 70)]
    df = spark.createDataFrame(rows, CONV_SCHEMA)
    path = os.path.join(scratch, "lake")
    for batch in (0, 0, 1, 0):
        L.append_batch(df, path, "timestamp", batch)
    assert L.scan_lake_table(spark, path, "timestamp").count() == 6
    assert L.scan_lake_table(spark, path, "timestamp", T0 + dt.timedelta(hours=1), None).count() == 2


def test_stored_service_json_is_parsed(spark):
    rows = [("a", "d", '{"m":[[1.0,2.0],[3.0,4.5]]}', '{"x":"1"}'), ("b", "d", "no json", "{}"), ("c", "d", None, None)]
    got = SV.services_parsed(spark.createDataFrame(rows, "name string, description string, stats string, settings string")).collect()
    assert {tuple(r) for r in got} == {("a", "stat", "m", 2, "4.5"), ("a", "setting", "x", None, "1")}


def test_series_batches_rewrite_touched_buckets_only(spark, scratch):
    from clickpath.streaming.stateful import SeriesTable
    table = SeriesTable(spark, os.path.join(scratch, "s"), buckets=4)
    points = lambda *rows: spark.createDataFrame(list(rows), "publishers_id string, ts bigint, count bigint")
    write = table.sink("ck-1", as_of="2024-02-01")
    write(points(*[(f"P{i}", 60, i) for i in range(20)]), 0)
    first = table.versions()
    assert len(first) == 4 and all(v == [0] for v in first.values())
    write(points(("P3", 120, 7)), 1)
    write(points(("P3", 180, 8), ("P3", 120, 9)), 2)
    write(points(("P3", 180, 8), ("P3", 120, 9)), 2)               # a batch that runs again
    touched = [b for b, v in table.versions().items() if v != [0]]
    assert len(touched) == 1 and table.versions()[touched[0]] == [1, 2]
    got = {r.publishers_id: r.impressions for r in table.read().collect()}
    assert len(got) == 20 and got["P3"] == "[[60, 3], [120, 9], [180, 8]]" and got["P4"] == "[[60, 4]]"
    # a new checkpoint over the table starts at batch 0 and is not skipped
    table.sink("ck-2", as_of="2024-02-01")(points(("P3", 240, 1)), 0)
    table.sink("ck-2", as_of="2024-02-01")(points(("P3", 300, 1)), 1)
    got = {r.publishers_id: r.impressions for r in table.read().collect()}
    assert got["P3"] == "[[60, 3], [120, 9], [180, 8], [240, 1], [300, 1]]"
    assert all(len(v) <= 2 for v in table.versions().values())
