"""Registered queries: service statistics, health and the per-service query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import format_metric
from ..operators import services as SV
from ..sources import adapters
from . import domain
from .registry import ADAPTER_SQL, AS_OF, QUERY_LOG_SQL, attributed_sql, register, with_ctes

POINTS_SQL = """
points AS (
  SELECT 'generate_traffic' AS name, 'impressions_generated' AS metric, CAST(epoch(bucket_date) AS BIGINT) AS ts,
         CAST(count(*) AS DOUBLE) AS value FROM raw_impressions GROUP BY bucket_date
  UNION ALL
  SELECT 'generate_traffic', 'conversions_generated', CAST(epoch(bucket_date) AS BIGINT), CAST(count(*) AS DOUBLE)
  FROM raw_conversions GROUP BY bucket_date
  UNION ALL
  SELECT 'hcd_to_presto', 'impressions_aggregated', CAST(epoch(timestamp) AS BIGINT), CAST(count(*) AS DOUBLE)
  FROM impression_tracking GROUP BY timestamp
  UNION ALL
  SELECT 'hcd_to_presto', 'impressions_processed', CAST(epoch(timestamp) AS BIGINT), CAST(sum(impressions) AS DOUBLE)
  FROM impression_tracking GROUP BY timestamp
  UNION ALL
  SELECT 'presto_insights', 'conversions_identified', CAST(epoch(conversion_timestamp) AS BIGINT),
         CAST(count(*) AS DOUBLE) FROM attributed GROUP BY conversion_timestamp
  UNION ALL
  SELECT 'presto_to_hcd', 'publishers_updated', CAST(epoch(timestamp) AS BIGINT),
         CAST(count(DISTINCT publishers_id) AS DOUBLE)
  FROM impression_tracking WHERE publishers_id IS NOT NULL GROUP BY timestamp
),
capped AS (
  SELECT name, metric, ts, value FROM (
    SELECT *, row_number() OVER (PARTITION BY name, metric ORDER BY ts DESC) AS rn FROM points) WHERE rn <= 90
)"""

DESC_SQL = "descs AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{d}')" for n, d in domain.SERVICE_DESCRIPTIONS) + ") AS t(name, description))"

OVERVIEW_SQL = f"""
overview AS (
  SELECT d.name, d.description, CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) - l.last_ts AS age_seconds
  FROM descs d LEFT JOIN (SELECT name, max(ts) AS last_ts FROM capped GROUP BY name) l ON d.name = l.name
)"""

CTES = (ADAPTER_SQL, attributed_sql(), POINTS_SQL, DESC_SQL, OVERVIEW_SQL)


def _plural_sql(n, unit):
    return f"CAST({n} AS VARCHAR) || ' {unit}' || CASE WHEN {n} <> 1 THEN 's' ELSE '' END"


def points(spark, sf):
    return domain.service_points(spark, sf)


def services(spark, sf, with_log=False):
    log = adapters.query_log(spark, sf) if with_log else None
    svc = F.when(F.col("query_type") == "HCD", F.lit("presto_to_hcd")).otherwise(F.lit("presto_insights"))
    return SV.services_table(points(spark, sf), domain.service_descriptions(spark), log, svc)


@register("service_stat_series", with_ctes(*CTES) + "\nSELECT * FROM capped")
def q_stat_series(spark, sf):
    return SV.service_stat_series(points(spark, sf))


@register("latest_metric_value", with_ctes(*CTES) + """
SELECT name, metric, ts, value,
       CASE WHEN contains(metric, 'percent') OR contains(metric, 'rate') THEN printf('%.2f%%', value)
            WHEN contains(metric, 'seconds') THEN printf('%.3fs', value)
            WHEN contains(metric, 'time') OR contains(metric, 'latency') THEN printf('%.2fms', value)
            ELSE regexp_replace(format('{:,.3f}', value), '\\.?0+$', '') END AS display
FROM (SELECT name, metric, arg_max(ts, ts) AS ts, arg_max(value, ts) AS value FROM points GROUP BY 1, 2)""")
def q_latest(spark, sf):
    return SV.latest_metric_value(points(spark, sf))


@register("metric_chart", with_ctes(*CTES) + """
SELECT name, metric, ts, strftime(make_timestamp(ts * 1000000), '%b %-d, %H:%M') AS label,
       coalesce(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE), 0.0) AS value
FROM capped""")
def q_metric_chart(spark, sf):
    return SV.metric_chart(SV.service_stat_series(points(spark, sf)))


_OVERVIEW_SELECT = f"""
SELECT name, description, age_seconds,
       CASE WHEN age_seconds IS NULL OR age_seconds > 180 THEN 'red'
            WHEN age_seconds > 90 THEN 'yellow' ELSE 'green' END AS health_status,
       CASE WHEN age_seconds < 60 THEN {_plural_sql('age_seconds', 'second')}
            WHEN age_seconds < 3600 THEN {_plural_sql('CAST(floor(age_seconds / 60) AS BIGINT)', 'minute')}
            ELSE {_plural_sql('CAST(floor(age_seconds / 3600) AS BIGINT)', 'hour')} END AS age_text,
       CASE name WHEN 'generate_traffic' THEN 0 WHEN 'hcd_to_presto' THEN 1 WHEN 'presto_insights' THEN 2
                 WHEN 'presto_to_hcd' THEN 3 WHEN 'presto_cleanup' THEN 4 ELSE 5 END AS sort_order
FROM overview"""


@register("services_overview", with_ctes(*CTES) + _OVERVIEW_SELECT)
def q_overview(spark, sf):
    return SV.services_overview(services(spark, sf), AS_OF)


@register("health_status", with_ctes(*CTES) + "\nSELECT * FROM (" + _OVERVIEW_SELECT
          + ") WHERE health_status = 'green'")
def q_health(spark, sf):
    return SV.healthy_services(SV.services_overview(services(spark, sf), AS_OF))


@register("service_query_log", with_ctes(QUERY_LOG_SQL) + """
SELECT service_name, query_id, query_text, query_type, query_description, parameters,
       strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') AS start_time, strftime(end_time, '%Y-%m-%dT%H:%M:%S.%f') AS end_time,
       execution_time_ms, rows_returned, success, error_message, prepared, retry_count
FROM (SELECT *, CASE WHEN query_type = 'HCD' THEN 'presto_to_hcd' ELSE 'presto_insights' END AS service_name,
             row_number() OVER (PARTITION BY query_type ORDER BY start_time DESC, query_id DESC) AS rn
      FROM query_log) WHERE rn <= 50""")
def q_service_query_log(spark, sf):
    return SV.service_query_log(services(spark, sf, with_log=True))


SETTINGS = (("generate_traffic", "impression_types", "view,click"), ("generate_traffic", "conversion_types", "purchase,signup"),
            ("presto_insights", "lookback_minutes", "90"), ("presto_to_hcd", "series_points", "90"),
            ("presto_cleanup", "retention_hours", "24"))


@register("services_parsed", with_ctes(*CTES) + """
SELECT name, 'stat' AS kind, metric AS key, count(*) AS points, format('{:.1f}', arg_max(value, ts)) AS value FROM capped GROUP BY name, metric
UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{n}', 'setting', '{k}', NULL, '{v}')" for n, k, v in SETTINGS) + ")")
def q_services_parsed(spark, sf):
    """Stats and settings of every service, read back from the stored JSON."""
    stored = SV.services_table(points(spark, sf), domain.service_descriptions(spark),
                               settings=spark.createDataFrame(list(SETTINGS), "name string, setting string, value string"))
    return SV.services_parsed(stored)


@register("service_health_history", with_ctes(*CTES) + f"""
, runs AS (SELECT DISTINCT name, ts FROM points),
ages AS (
  SELECT name, coalesce(lead(ts) OVER (PARTITION BY name ORDER BY ts), CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT)) - ts AS age_seconds FROM runs
)
SELECT name, CASE WHEN age_seconds > 180 THEN 'red' WHEN age_seconds > 90 THEN 'yellow' ELSE 'green' END AS health_status,
       CASE WHEN age_seconds < 60 THEN {_plural_sql('age_seconds', 'second')}
            WHEN age_seconds < 3600 THEN {_plural_sql('CAST(floor(age_seconds / 60) AS BIGINT)', 'minute')}
            ELSE {_plural_sql('CAST(floor(age_seconds / 3600) AS BIGINT)', 'hour')} END AS age_text, count(*) AS runs
FROM ages GROUP BY ALL""")
def q_health_history(spark, sf):
    """Every colour is reached: the services' runs follow the events, which leave gaps."""
    return SV.health_history(points(spark, sf), AS_OF)


_KINDS = ("error_percent", "memory_bytes", "run_seconds", "latency", "rows")


@register("format_metric_kinds", with_ctes(ADAPTER_SQL) + """
, v AS (
  SELECT metric, k, round(k * pow(37, k % 7) / 7.0, 4) AS value
  FROM (SELECT DISTINCT k FROM ev), (SELECT unnest(['error_percent', 'memory_bytes', 'run_seconds', 'latency', 'rows']) AS metric)
), b AS (SELECT *, CAST(greatest(least(floor(ln(greatest(value, 1.0)) / ln(1024.0)), 4), 0) AS INTEGER) AS i FROM v)
SELECT metric, k, CASE metric WHEN 'error_percent' THEN printf('%.2f%%', value) WHEN 'run_seconds' THEN printf('%.3fs', value)
         WHEN 'latency' THEN printf('%.2fms', value)
         WHEN 'memory_bytes' THEN CASE WHEN value = 0 THEN '0 Bytes' ELSE
           regexp_replace(printf('%.2f', round(value / pow(1024.0, i), 2)), '\\.?0+$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB', 'TB'][i + 1] END
         ELSE regexp_replace(format('{:,.3f}', value), '\\.?0+$', '') END AS display
FROM b""")
def q_format_metric_kinds(spark, sf):
    """Every kind of metric text, over the values of the event keys in seven orders of magnitude."""
    k = adapters.keyed_events(spark, sf).select("k").distinct()
    value = F.round(F.col("k") * F.pow(F.lit(37.0), F.col("k") % 7) / 7.0, 4)
    rows = k.select("k", F.explode(F.array(*[F.lit(m) for m in _KINDS])).alias("metric"), value.alias("value"))
    return rows.select("metric", "k", format_metric("value", "metric").alias("display"))
