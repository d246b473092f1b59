"""Registered queries: sources, rollups, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import MINUTE, shift
from ..operators import attribution as att
from ..operators import rollup
from ..sources import adapters, lake
from . import domain
from .registry import ADAPTER_SQL, AS_OF, attributed_sql, register, with_ctes

ATTR_COLS = ("advertisers_id, publishers_id, cookie_id, conversion_timestamp, impression_timestamp, "
             "time_to_conversion_seconds, created_at")


@register("scan_minute_buckets", with_ctes(ADAPTER_SQL) + """
SELECT bucket_date, ts, publishers_id, advertisers_id, cookie_id, impression_id
FROM raw_impressions""")
def q_scan_minute_buckets(spark, sf):
    """All minutes of the raw facts, scanned from the lake table across salt buckets."""
    raw = lake.scan_lake_table(spark, domain.lake_table(spark, sf, "raw_impressions"), "bucket_date")
    return rollup.scan_minute_range(raw, None, None).drop("bucket", "hour_key", "batch_id")


@register("scan_busiest_minute", with_ctes(ADAPTER_SQL) + """
SELECT bucket_date, ts, publishers_id, advertisers_id, cookie_id, impression_id FROM raw_impressions
WHERE bucket_date = (SELECT bucket_date FROM raw_impressions GROUP BY bucket_date ORDER BY count(*) DESC, bucket_date LIMIT 1)""")
def q_scan_busiest_minute(spark, sf):
    """The minute with most rows, read across its salt buckets from its hour's folder only."""
    path = domain.lake_table(spark, sf, "raw_impressions")
    per_minute = lake.scan_lake_table(spark, path, "bucket_date").groupBy("bucket_date").agg(F.count(F.lit(1)).alias("n"))
    minute = per_minute.orderBy(F.col("n").desc(), "bucket_date").first()[0]
    raw = lake.scan_lake_table(spark, path, "bucket_date", minute, shift(minute, MINUTE))
    return rollup.scan_minute_buckets(raw, minute).drop("bucket", "hour_key", "batch_id")


@register("salt_bucket", with_ctes(ADAPTER_SQL) + """
SELECT CAST(CAST('0x' || substr(md5(publishers_id), 1, 8) AS BIGINT) % 10 AS SMALLINT) AS bucket, count(*) AS rows
FROM raw_impressions GROUP BY 1""")
def q_salt_bucket(spark, sf):
    """Rows per write bucket."""
    raw = adapters.raw_impressions(spark, sf)
    return raw.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))


@register("impression_rollup", with_ctes(ADAPTER_SQL) + """
SELECT publishers_id, advertisers_id, cookie_id, timestamp, impressions FROM impression_tracking""")
def q_impression_rollup(spark, sf):
    return domain.impressions(spark, sf)


@register("impression_rollup_by_cookie", with_ctes(ADAPTER_SQL) + """
SELECT publishers_id, cookie_id, bucket_date AS timestamp,
       arg_min(advertisers_id, (ts, impression_id)) AS advertisers_id,
       CAST(count(*) AS INTEGER) AS impressions
FROM raw_impressions GROUP BY publishers_id, cookie_id, bucket_date""")
def q_impression_rollup_by_cookie(spark, sf):
    return rollup.impression_rollup_by_cookie(adapters.raw_impressions(spark, sf))


@register("conversion_facts", with_ctes(ADAPTER_SQL) + """
SELECT advertisers_id, timestamp, cookie_id FROM conversion_tracking""")
def q_conversion_facts(spark, sf):
    return domain.conversions(spark, sf)


@register("first_touch_attribution", with_ctes(ADAPTER_SQL, attributed_sql())
          + f"\nSELECT {ATTR_COLS} FROM attributed")
def q_first_touch(spark, sf):
    return domain.attributed(spark, sf)


@register("first_touch_attribution_join", with_ctes(ADAPTER_SQL, attributed_sql())
          + f"\nSELECT {ATTR_COLS} FROM attributed")
def q_first_touch_join(spark, sf):
    return domain.attributed(spark, sf, strategy="join")


@register("first_touch_attribution_range", with_ctes(ADAPTER_SQL, attributed_sql())
          + f"\nSELECT {ATTR_COLS} FROM attributed")
def q_first_touch_range(spark, sf):
    """Sliding RANGE-frame form (kept for comparison with the running-frame default)."""
    return domain.attributed(spark, sf, strategy="range")


@register("first_touch_attribution_24h",
          with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR")) + f"\nSELECT {ATTR_COLS} FROM attributed")
def q_first_touch_24h(spark, sf):
    return domain.attributed(spark, sf, lookback_seconds=24 * 3600)


VOLUME_SQL = """
vol_imp AS (
  SELECT 'PID_' || CAST(l.l_suppkey AS VARCHAR) AS publishers_id,
         'AID_' || lpad(CAST(l.l_orderkey % 5 AS VARCHAR), 3, '0') AS advertisers_id,
         'CID_' || CAST(o.o_custkey AS VARCHAR) AS cookie_id,
         date_trunc('day', CAST(l.l_shipdate AS TIMESTAMP)) AS timestamp,
         CAST(count(*) AS INTEGER) AS impressions
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY ALL
),
vol_conv AS (
  SELECT 'AID_' || lpad(CAST(o_orderkey % 5 AS VARCHAR), 3, '0') AS advertisers_id,
         date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS timestamp,
         'CID_' || CAST(o_custkey AS VARCHAR) AS cookie_id
  FROM orders
)"""


@register("attribution_volume",
          with_ctes(VOLUME_SQL, attributed_sql("INTERVAL 90 DAY", "vol_imp", "vol_conv"))
          + f"\nSELECT {ATTR_COLS} FROM attributed")
def q_attribution_volume(spark, sf):
    return att.first_touch_attribution(adapters.volume_impressions(spark, sf),
                                       adapters.volume_conversions(spark, sf),
                                       lookback_seconds=90 * 86400, as_of=AS_OF)


@register("publisher_impressions_minute", with_ctes(ADAPTER_SQL) + """
SELECT publishers_id, timestamp, CAST(sum(impressions) AS BIGINT) AS total_impressions
FROM impression_tracking WHERE publishers_id IS NOT NULL GROUP BY publishers_id, timestamp""")
def q_pub_imp_minute(spark, sf):
    return rollup.entity_metric(domain.impressions(spark, sf), "publishers", "impressions")


@register("advertiser_impressions_minute", with_ctes(ADAPTER_SQL) + """
SELECT advertisers_id, timestamp, CAST(sum(impressions) AS BIGINT) AS total_impressions
FROM impression_tracking WHERE advertisers_id IS NOT NULL GROUP BY advertisers_id, timestamp""")
def q_adv_imp_minute(spark, sf):
    return rollup.entity_metric(domain.impressions(spark, sf), "advertisers", "impressions")


@register("advertiser_conversions_minute", with_ctes(ADAPTER_SQL) + """
SELECT advertisers_id, timestamp, count(*) AS total_conversions
FROM conversion_tracking WHERE advertisers_id IS NOT NULL GROUP BY advertisers_id, timestamp""")
def q_adv_conv_minute(spark, sf):
    return rollup.entity_metric(domain.conversions(spark, sf), "advertisers", "conversions")


@register("publisher_conversions_trailing", with_ctes(ADAPTER_SQL, attributed_sql()) + """
SELECT a.publishers_id, s.t AS timestamp, count(*) AS total_conversions
FROM attributed a,
     LATERAL (SELECT date_trunc('minute', a.impression_timestamp) + INTERVAL (g) MINUTE AS t
              FROM generate_series(0, 90) AS gs(g)) s
WHERE a.publishers_id IS NOT NULL
GROUP BY a.publishers_id, s.t""")
def q_pub_conv_trailing(spark, sf):
    return rollup.publisher_conversions_trailing(domain.attributed(spark, sf))


@register("publisher_conversions_minute", with_ctes(ADAPTER_SQL, attributed_sql()) + """
SELECT publishers_id, date_trunc('minute', impression_timestamp) AS timestamp, count(*) AS total_conversions
FROM attributed WHERE publishers_id IS NOT NULL GROUP BY ALL""")
def q_pub_conv_minute(spark, sf):
    return rollup.publisher_conversions_minute(domain.attributed(spark, sf))


@register("rollup_stats", with_ctes(ADAPTER_SQL) + """
SELECT timestamp, CAST(sum(impressions) AS BIGINT) AS impressions_processed,
       count(*) AS impressions_aggregated,
       CAST(ceil(count(*) / 10000.0) AS BIGINT) AS impressions_batches
FROM impression_tracking GROUP BY timestamp""")
def q_rollup_stats(spark, sf):
    return rollup.rollup_stats(adapters.raw_impressions(spark, sf))


ELIGIBLE_SQL = """
eligible AS (
  SELECT c.* FROM raw_conversions c
  WHERE c.cookie_id IS NOT NULL AND EXISTS (
    SELECT 1 FROM impression_tracking i
    WHERE i.cookie_id = c.cookie_id
      AND i.timestamp >= c.bucket_date - INTERVAL 90 MINUTE AND i.timestamp <= c.bucket_date)
)"""


@register("eligible_conversions", with_ctes(ADAPTER_SQL, ELIGIBLE_SQL) + """
SELECT advertisers_id, timestamp, cookie_id, conversion_id
FROM (SELECT advertisers_id, bucket_date AS timestamp, cookie_id, conversion_id FROM eligible)""")
def q_eligible(spark, sf):
    attempts = adapters.raw_conversions(spark, sf).select(
        "advertisers_id", F.col("bucket_date").alias("timestamp"), "cookie_id", "conversion_id")
    return att.eligible_conversions(domain.impressions(spark, sf), attempts)


@register("attribution_stats", with_ctes(ADAPTER_SQL, ELIGIBLE_SQL) + """
SELECT a.timestamp, a.attempted_conversions,
       CAST(coalesce(g.n, 0) AS BIGINT) AS successful_conversions,
       CASE WHEN a.attempted_conversions > 0
            THEN CAST(coalesce(g.n, 0) AS DOUBLE) / a.attempted_conversions ELSE 0.0 END AS attribution_rate
FROM (SELECT bucket_date AS timestamp, count(*) AS attempted_conversions FROM raw_conversions GROUP BY 1) a
LEFT JOIN (SELECT bucket_date AS timestamp, count(*) AS n FROM eligible GROUP BY 1) g
  ON a.timestamp = g.timestamp""")
def q_attribution_stats(spark, sf):
    attempts = adapters.raw_conversions(spark, sf).select(
        "advertisers_id", F.col("bucket_date").alias("timestamp"), "cookie_id", "conversion_id")
    return att.attribution_stats(domain.impressions(spark, sf), attempts)
