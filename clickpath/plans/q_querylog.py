"""Registered queries: query-log analytics over the event-derived statement log."""

from __future__ import annotations

from ..functions.text import query_fingerprint
from ..operators import querylog as QL
from ..sources import adapters
from .registry import QUERY_LOG_SQL, fingerprint_sql, register, with_ctes

ORD = "(start_time, query_id)"
PATTERNS_SQL = f"""
patterns AS (
  SELECT fp AS simplified_query_text, count(*) AS repeat_count,
         arg_min(query_id, {ORD}) AS query_id, arg_min(query_text, {ORD}) AS query_text,
         arg_min(query_type, {ORD}) AS query_type, arg_min(query_description, {ORD}) AS query_description,
         max(start_time) AS start_time,
         arg_max_null(execution_time_ms, {ORD}) AS execution_time_ms,
         arg_max_null(rows_returned, {ORD}) AS rows_returned,
         arg_max_null(success, {ORD}) AS success
  FROM (SELECT *, {fingerprint_sql('query_text')} AS fp FROM query_log) GROUP BY fp
)"""

SUMMARY_COLS = """count(*) AS total_queries,
       count(*) FILTER (WHERE success) AS successful_queries,
       count(*) FILTER (WHERE NOT success) AS failed_queries,
       coalesce(round(avg(execution_time_ms) FILTER (WHERE success), 2), 0.0) AS average_execution_time_ms,
       CAST(coalesce(sum(rows_returned) FILTER (WHERE success), 0) AS BIGINT) AS total_rows_returned"""

LOG_COLS = ("query_id, query_text, query_description, query_type, parameters, start_time, end_time, "
            "execution_time_ms, rows_returned, success, error_message, prepared, retry_count")
DISPLAY_WIDTH = 80


def _log(spark, sf):
    return adapters.query_log(spark, sf)


@register("query_fingerprint", with_ctes(QUERY_LOG_SQL) + f"""
SELECT query_id, {fingerprint_sql('query_text')} AS simplified_query_text FROM query_log""")
def q_fingerprint(spark, sf):
    return _log(spark, sf).select("query_id", query_fingerprint("query_text").alias("simplified_query_text"))


@register("query_log_patterns", with_ctes(QUERY_LOG_SQL, PATTERNS_SQL) + "\nSELECT * FROM patterns")
def q_patterns(spark, sf):
    return QL.query_log_patterns(_log(spark, sf))


@register("query_log_summary", with_ctes(QUERY_LOG_SQL, PATTERNS_SQL) + f"\nSELECT {SUMMARY_COLS} FROM patterns")
def q_summary(spark, sf):
    return QL.query_log_summary(QL.query_log_patterns(_log(spark, sf)))


@register("query_log_by_engine", with_ctes(QUERY_LOG_SQL, PATTERNS_SQL)
          + f"\nSELECT query_type, {SUMMARY_COLS} FROM patterns GROUP BY query_type")
def q_by_engine(spark, sf):
    return QL.query_log_summary(QL.query_log_patterns(_log(spark, sf)), by_engine=True)


@register("query_log_top_patterns", with_ctes(QUERY_LOG_SQL, PATTERNS_SQL) + """
SELECT simplified_query_text, CAST(sum(repeat_count) AS BIGINT) AS total_executions,
       avg(coalesce(execution_time_ms, 0.0)) AS avg_execution_time_ms
FROM patterns GROUP BY simplified_query_text
ORDER BY total_executions DESC, simplified_query_text LIMIT 5""")
def q_top_patterns(spark, sf):
    return QL.query_log_top_patterns(QL.query_log_patterns(_log(spark, sf)))


@register("slow_queries", with_ctes(QUERY_LOG_SQL) + f"""
SELECT {LOG_COLS} FROM query_log WHERE execution_time_ms > 1000.0""")
def q_slow(spark, sf):
    return QL.slow_queries(_log(spark, sf))


@register("recent_queries", with_ctes(QUERY_LOG_SQL) + f"""
SELECT {LOG_COLS} FROM query_log ORDER BY start_time DESC, query_id DESC LIMIT 50""")
def q_recent(spark, sf):
    return QL.recent_queries(_log(spark, sf))


@register("query_log_display", with_ctes(QUERY_LOG_SQL) + f"""
SELECT query_id,
       CASE WHEN length(query_text) > {DISPLAY_WIDTH}
            THEN rtrim(substr(query_text, 1, {DISPLAY_WIDTH})) || '... [truncated from '
                 || CAST(length(query_text) AS VARCHAR) || ' chars]'
            ELSE query_text END AS query_text,
       query_description, query_type,
       list_transform(list_slice(parameters, 1, 10),
                      lambda x: CASE WHEN length(x) > 15 THEN substr(x, 1, 12) || '...' ELSE x END) AS parameters,
       start_time, end_time, execution_time_ms, rows_returned, success, error_message, prepared, retry_count,
       {fingerprint_sql('query_text')} AS simplified_query_text
FROM query_log""")
def q_display(spark, sf):
    return QL.query_log_display(_log(spark, sf), max_length=DISPLAY_WIDTH)
