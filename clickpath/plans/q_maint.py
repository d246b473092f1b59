"""Registered queries: lake layout, upsert, TTL, retention, counts, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.timecols import time_slice
from ..session import shared_path
from ..sources import adapters
from ..sources import lake as L
from ..sources.tables import TABLES, read_table
from . import domain
from .registry import ADAPTER_SQL, AS_OF, back, register, with_ctes

A = f"TIMESTAMP '{AS_OF}'"
UPSERT_CUT = "2024-01-20 00:00:00"
UPSERT_FROM = "2024-01-18 00:00:00"


@register("lake_layout", with_ctes(ADAPTER_SQL) + """
SELECT *, CAST(strftime(timestamp, '%Y%m%d%H') AS INTEGER) AS hour_key,
       CAST(CAST('0x' || substr(md5(publishers_id), 1, 8) AS BIGINT) % 5 AS SMALLINT) AS id_bucket
FROM impression_tracking""")
def q_lake_layout(spark, sf):
    """Impression rows with their hour / id-bucket partition values."""
    return L.lake_layout(domain.impressions(spark, sf), "timestamp", "publishers_id")


@register("scan_lake_table", with_ctes(ADAPTER_SQL) + """
SELECT *, CAST(strftime(timestamp, '%Y%m%d%H') AS INTEGER) AS hour_key FROM impression_tracking
WHERE timestamp >= TIMESTAMP '2024-01-10 06:30:00' AND timestamp < TIMESTAMP '2024-01-12 18:00:00'""")
def q_scan_lake_table(spark, sf):
    """A range of the rollup's lake table: only the folders of its hours are listed and read."""
    path = domain.lake_table(spark, sf, "impression_tracking")
    return L.scan_lake_table(spark, path, "timestamp", "2024-01-10 06:30:00", "2024-01-12 18:00:00").drop("batch_id")


@register("lake_lifecycle", with_ctes(ADAPTER_SQL) + f"""
SELECT publishers_id, advertisers_id, cookie_id, timestamp, impressions FROM impression_tracking
WHERE timestamp >= {A} - INTERVAL 96 HOUR - INTERVAL 30 MINUTE AND timestamp < {A} - INTERVAL 24 HOUR""")
def q_lake_lifecycle(spark, sf):
    """The rollup's last week appended to a lake table, purged to 96 hours in the middle of
    an hour, and all but its last day scanned back."""
    path = shared_path(spark, "lake", uuid.uuid4().hex)
    L.append_facts(domain.impressions(spark, sf, back(7 * 86400), AS_OF), path, "timestamp", "publishers_id")
    L.purge_table(spark, path, "timestamp", back(1800), 96)
    return L.scan_lake_table(spark, path, "timestamp", None, back(86400)).drop("hour_key", "id_bucket")


@register("upsert_by_key", with_ctes(ADAPTER_SQL) + f"""
SELECT publishers_id, advertisers_id, cookie_id, timestamp,
       CASE WHEN timestamp >= TIMESTAMP '{UPSERT_FROM}' THEN impressions + 100 ELSE impressions END AS impressions
FROM impression_tracking""")
def q_upsert(spark, sf):
    """Old table (before the cut) upserted with a batch re-sending two overlapping days, with
    other values, and everything after: primary key (publisher, cookie, advertiser, minute)."""
    imp = domain.impressions(spark, sf)
    old = imp.where(time_slice("timestamp", None, UPSERT_CUT))
    new = imp.where(time_slice("timestamp", UPSERT_FROM, None)).withColumn("impressions", F.col("impressions") + 100)
    return L.upsert_by_key(old, new, ["publishers_id", "cookie_id", "advertisers_id", "timestamp"])


@register("kv_upsert")
def q_kv_upsert(spark, sf):
    """Conversion-rate windows stored under their key (JSON text: rows-only)."""
    from ..operators import reports as R
    rates = R.rates_json(R.conversion_rate_windows(domain.impressions(spark, sf), domain.conversions(spark, sf),
                                                   AS_OF))
    counts = L.table_counts_json(L.table_row_counts({"impression_tracking": domain.impressions(spark, sf),
                                                     "conversion_tracking": domain.conversions(spark, sf)}))
    store = L.kv_upsert(None, "presto_table_counts", counts, AS_OF)
    return L.kv_upsert(store, "publisher_all_conversion_rate", rates, AS_OF)


@register("kv_overwrite", with_ctes(ADAPTER_SQL) + f"""
SELECT 'table_counts' AS key, format('{{{{"conversion_tracking":{{}},"impression_tracking":{{}}}}}}',
         (SELECT count(*) FROM conversion_tracking), (SELECT count(*) FROM impression_tracking)) AS value, {A} AS last_update
UNION ALL
SELECT 'recent_counts', format('{{{{"impression_tracking":{{}}}}}}', (SELECT count(*) FROM impression_tracking
  WHERE timestamp >= {A} - INTERVAL 24 HOUR AND timestamp < {A})), {A}""")
def q_kv_overwrite(spark, sf):
    """Table counts written for the last day, under two keys; then one key is overwritten
    with the counts of the whole tables."""
    def counts(**tables):
        return L.table_counts_json(L.table_row_counts(tables))
    recent = counts(impression_tracking=domain.impressions(spark, sf, back(86400), AS_OF))
    whole = counts(impression_tracking=domain.impressions(spark, sf), conversion_tracking=domain.conversions(spark, sf))
    store = L.kv_upsert(L.kv_upsert(None, "table_counts", recent, back(60)), "recent_counts", recent, AS_OF)
    return L.kv_upsert(store, "table_counts", whole, AS_OF)


@register("ttl_filter", with_ctes(ADAPTER_SQL) + f"""
SELECT * FROM impression_tracking WHERE timestamp > {A} - INTERVAL 21600 SECOND""")
def q_ttl(spark, sf):
    return L.ttl_filter(domain.impressions(spark, sf, back(21600)), "timestamp", 21600, AS_OF)


@register("retention_purge", with_ctes(ADAPTER_SQL) + f"""
SELECT * FROM conversion_tracking WHERE timestamp >= {A} - INTERVAL 24 HOUR""")
def q_retention(spark, sf):
    return L.retention_purge(domain.conversions(spark, sf, back(86400)), "timestamp", AS_OF)


@register("purge_report", with_ctes(ADAPTER_SQL) + f"""
SELECT 'impression_tracking' AS table_name, count(*) AS count_before,
       count(*) FILTER (WHERE timestamp < {A} - INTERVAL 24 HOUR) AS deleted,
       count(*) - count(*) FILTER (WHERE timestamp < {A} - INTERVAL 24 HOUR) AS count_after, 24 AS cutoff_hours
FROM impression_tracking
UNION ALL
SELECT 'conversion_tracking', count(*), count(*) FILTER (WHERE timestamp < {A} - INTERVAL 24 HOUR),
       count(*) - count(*) FILTER (WHERE timestamp < {A} - INTERVAL 24 HOUR), 24
FROM conversion_tracking""")
def q_purge_report(spark, sf):
    return L.purge_report({"impression_tracking": domain.impressions(spark, sf),
                           "conversion_tracking": domain.conversions(spark, sf)}, "timestamp", AS_OF)


@register("table_row_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def q_table_counts(spark, sf):
    return L.table_row_counts({t: read_table(spark, sf, t) for t in TABLES})


@register("table_describe")
def q_describe(spark, sf):
    """Schema rows of the impression table (type names differ between engines: rows-only)."""
    return L.table_describe(spark, domain.impressions(spark, sf))


@register("sample_rows", with_ctes(ADAPTER_SQL) + """
SELECT CAST(bucket_date AS VARCHAR) AS bucket_date, CAST(ts AS VARCHAR) AS ts, publishers_id, advertisers_id,
       cookie_id, impression_id
FROM raw_impressions ORDER BY impression_id LIMIT 10""")
def q_sample(spark, sf):
    raw = adapters.raw_impressions(spark, sf).drop("bucket")
    return L.sample_rows(raw, 10, 30, order_by=["impression_id"])


@register("not_null_ids", with_ctes(ADAPTER_SQL) + """
SELECT advertisers_id, timestamp, cookie_id FROM conversion_tracking
WHERE advertisers_id IS NOT NULL AND cookie_id IS NOT NULL""")
def q_not_null(spark, sf):
    c = domain.conversions(spark, sf)
    return c.where(F.col("advertisers_id").isNotNull() & F.col("cookie_id").isNotNull())


@register("truncate_all", with_ctes(ADAPTER_SQL) + """
SELECT 'impressions_by_day' AS table_name, count(*) AS rows_before, 0 AS rows_after FROM impression_tracking
UNION ALL SELECT 'conversions_by_day', count(*), 0 FROM conversion_tracking""")
def q_truncate_all(spark, sf):
    """Two lake tables written, truncated and scanned again: no rows of the same schema."""
    facts = {"impressions_by_day": domain.impressions(spark, sf), "conversions_by_day": domain.conversions(spark, sf)}
    out = None
    for name, df in facts.items():
        path = shared_path(spark, "lake", f"{name}-{uuid.uuid4().hex}")
        L.append_batch(df.withColumn("day", F.date_trunc("day", "timestamp")), path, "day", 0)
        before = L.scan_lake_table(spark, path, "timestamp").count()
        L.truncate_all(spark, {name: path})
        after = L.scan_lake_table(spark, path, "timestamp").agg(F.count(F.lit(1)).cast("int").alias("rows_after"))
        one = after.select(F.lit(name).alias("table_name"), F.lit(before).cast("bigint").alias("rows_before"), "rows_after")
        out = one if out is None else out.unionByName(one)
    return out
