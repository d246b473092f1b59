"""Registered queries for the scalar helpers applied over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import parse_series, safe_rate
from ..functions.text import humanize_duration
from ..functions.timecols import DAY, MINUTE, add_seconds, minute_of
from ..operators import rollup
from ..sources import adapters
from . import domain, q_series
from .registry import ADAPTER_SQL, attributed_sql, register, with_ctes


@register("previous_full_minute", with_ctes(ADAPTER_SQL) + """
SELECT event_id, ts, date_trunc('minute', ts) - INTERVAL 1 MINUTE AS previous_full_minute FROM ev""")
def q_previous_full_minute(spark, sf):
    """The minute a job started at ``ts`` handles, for every event."""
    ev = adapters.keyed_events(spark, sf)
    return ev.select("event_id", "ts", add_seconds(minute_of("ts"), -MINUTE).alias("previous_full_minute"))


@register("rename_cast", with_ctes(ADAPTER_SQL) + """
SELECT publishers_id, advertisers_id, cookie_id, bucket_date AS timestamp,
       CAST(count(*) AS DOUBLE) AS impressions_double, CAST(count(*) AS BIGINT) AS impressions_bigint,
       CAST(bucket_date AS DATE) AS day
FROM raw_impressions GROUP BY publishers_id, advertisers_id, cookie_id, bucket_date""")
def q_rename_cast(spark, sf):
    roll = rollup.impression_rollup(adapters.raw_impressions(spark, sf))   # bucket_date -> timestamp
    return roll.select("publishers_id", "advertisers_id", "cookie_id", "timestamp",
                       F.col("impressions").cast("double").alias("impressions_double"),
                       F.col("impressions").cast("bigint").alias("impressions_bigint"),
                       F.col("timestamp").cast("date").alias("day"))


@register("safe_rate", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR")) + """
SELECT i.publishers_id, i.impressions, CAST(coalesce(c.n, 0) AS BIGINT) AS conversions,
       CASE WHEN i.impressions > 0 THEN CAST(coalesce(c.n, 0) AS DOUBLE) / CAST(i.impressions AS DOUBLE) * 100
            ELSE 0.0 END AS rate_pct
FROM (SELECT publishers_id, CAST(sum(impressions) AS BIGINT) AS impressions FROM impression_tracking GROUP BY 1) i
LEFT JOIN (SELECT publishers_id, count(*) AS n FROM attributed GROUP BY 1) c ON i.publishers_id = c.publishers_id""")
def q_safe_rate(spark, sf):
    imp = domain.impressions(spark, sf).groupBy("publishers_id").agg(
        F.sum("impressions").cast("bigint").alias("impressions"))
    conv = domain.attributed(spark, sf, lookback_seconds=DAY).groupBy("publishers_id").agg(
        F.count(F.lit(1)).alias("n"))
    j = imp.join(conv, "publishers_id", "left")
    c = F.coalesce("n", F.lit(0)).cast("bigint")
    return j.select("publishers_id", "impressions", c.alias("conversions"),
                    safe_rate(c, F.col("impressions")).alias("rate_pct"))


@register("parse_series", with_ctes(*q_series.PUB_CTES) + """
SELECT id AS publishers_id, ts, cnt AS count FROM pub_imp_top""")
def q_parse_series(spark, sf):
    """Served JSON series parsed back into (id, ts, count) rows."""
    t = q_series.publishers_table(spark, sf)
    return (t.select("publishers_id", F.explode(parse_series("impressions")).alias("p"))
            .select("publishers_id", F.col("p.ts").alias("ts"), F.col("p.count").alias("count")))


@register("humanize_duration", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR")) + """
SELECT advertisers_id, cookie_id, conversion_timestamp, time_to_conversion_seconds,
  CASE WHEN time_to_conversion_seconds IS NULL OR time_to_conversion_seconds = 0 THEN 'N/A'
       WHEN time_to_conversion_seconds < 60 THEN CAST(time_to_conversion_seconds AS VARCHAR) || 's'
       WHEN time_to_conversion_seconds < 3600 THEN CAST(time_to_conversion_seconds // 60 AS VARCHAR) || 'm '
            || CAST(time_to_conversion_seconds % 60 AS VARCHAR) || 's'
       ELSE CAST(time_to_conversion_seconds // 3600 AS VARCHAR) || 'h '
            || CAST((time_to_conversion_seconds % 3600) // 60 AS VARCHAR) || 'm' END AS time_to_conversion
FROM attributed""")
def q_humanize_duration(spark, sf):
    a = domain.attributed(spark, sf, lookback_seconds=DAY)
    return a.select("advertisers_id", "cookie_id", "conversion_timestamp", "time_to_conversion_seconds",
                    humanize_duration("time_to_conversion_seconds").alias("time_to_conversion"))


@register("entity_metric", with_ctes(ADAPTER_SQL) + """
SELECT 'publishers' AS entity, 'impressions' AS metric, publishers_id AS id, timestamp, CAST(sum(impressions) AS BIGINT) AS total
FROM impression_tracking WHERE publishers_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'advertisers', 'impressions', advertisers_id, timestamp, CAST(sum(impressions) AS BIGINT)
FROM impression_tracking WHERE advertisers_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'advertisers', 'conversions', advertisers_id, timestamp, count(*)
FROM conversion_tracking WHERE advertisers_id IS NOT NULL GROUP BY ALL""")
def q_entity_metric(spark, sf):
    """The generic (entity, metric) aggregate of all minutes, for the three pairs it answers."""
    facts = {"impressions": domain.impressions(spark, sf), "conversions": domain.conversions(spark, sf)}
    out = None
    for entity, metric in (("publishers", "impressions"), ("advertisers", "impressions"), ("advertisers", "conversions")):
        one = rollup.entity_metric(facts[metric], entity, metric).select(
            F.lit(entity).alias("entity"), F.lit(metric).alias("metric"), F.col(rollup.ENTITY_ID[entity]).alias("id"), "timestamp",
            F.col(f"total_{metric}").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out
