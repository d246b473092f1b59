"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the supplied tables; the
matching SQL computes the same result in DuckDB over the same parquet views.
Parameters that would be ``now()`` in the reference are pinned to ``AS_OF``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import FINGERPRINT_RULES
from ..functions.timecols import shift

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the registered queries.
AS_OF = "2024-01-31 00:00:00"           # end of the supplied event month
WINDOW_START = "2024-01-01 00:00:00"


def back(seconds: int) -> str:
    """``AS_OF`` less some seconds, as a literal bound."""
    return shift(AS_OF, -seconds)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------------------------------
# DuckDB form of the domain adapter (mirrors clickpath.sources.adapters).
ADAPTER_SQL = """
ev AS (
  SELECT event_id, ts, event_type, k,
         'PID_' || lpad(CAST(k % 20 AS VARCHAR), 3, '0') AS publishers_id,
         'AID_' || lpad(CAST(k % 5 AS VARCHAR), 3, '0') AS advertisers_id,
         'CID_' || CAST(user_id AS VARCHAR) AS cookie_id
  FROM (SELECT event_id, ts, event_type, user_id,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
),
raw_impressions AS (
  SELECT date_trunc('minute', ts) AS bucket_date, ts, publishers_id, advertisers_id, cookie_id,
         CAST(event_id AS VARCHAR) AS impression_id
  FROM ev WHERE event_type IN ('view', 'click')
),
raw_conversions AS (
  SELECT date_trunc('minute', ts) AS bucket_date, ts, publishers_id, advertisers_id, cookie_id,
         CAST(event_id AS VARCHAR) AS conversion_id
  FROM ev WHERE event_type IN ('purchase', 'signup')
),
impression_tracking AS (
  SELECT publishers_id, advertisers_id, cookie_id, bucket_date AS timestamp,
         CAST(count(*) AS INTEGER) AS impressions
  FROM raw_impressions GROUP BY publishers_id, advertisers_id, cookie_id, bucket_date
),
conversion_tracking AS (
  SELECT advertisers_id, bucket_date AS timestamp, cookie_id FROM raw_conversions
)"""


def attributed_sql(lookback: str = "INTERVAL 90 MINUTE", imp: str = "impression_tracking",
                   conv: str = "conversion_tracking", name: str = "attributed") -> str:
    """CTE of first-touch attribution: per distinct conversion the least
    (time, publisher) among the impressions under its look-back."""
    first = "arg_min({}, (seen.timestamp, seen.publishers_id))"
    return f"""
{name} AS (
  SELECT done.advertisers_id, {first.format('seen.publishers_id')} AS publishers_id, done.cookie_id,
         done.at AS conversion_timestamp, {first.format('seen.timestamp')} AS impression_timestamp,
         CAST(epoch(done.at) - epoch(min(seen.timestamp)) AS BIGINT) AS time_to_conversion_seconds,
         TIMESTAMP '{AS_OF}' AS created_at
  FROM (SELECT advertisers_id, cookie_id, timestamp AS at FROM {conv} GROUP BY ALL) done, {imp} seen
  WHERE (done.advertisers_id, done.cookie_id) = (seen.advertisers_id, seen.cookie_id)
    AND seen.timestamp < done.at AND seen.timestamp + {lookback} >= done.at AND seen.publishers_id IS NOT NULL
  GROUP BY done.advertisers_id, done.cookie_id, done.at
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


QUERY_LOG_SQL = """
query_log AS (
  SELECT
    CASE WHEN event_type IN ('view', 'signup') THEN 'cql_' ELSE 'presto_' END || CAST(event_id AS VARCHAR)
      AS query_id,
    CASE
      WHEN event_type = 'view' AND k % 2 = 0 THEN format('DELETE FROM shelf_tally WHERE shelf = ''{}'' AND days_old = 7.5', pub)
      WHEN event_type = 'view' THEN format('EXPLAIN SELECT price FROM tags WHERE tag_no IN ({}, 77) OR colour = ''red''', k)
      WHEN event_type = 'click' THEN
        format('UPDATE guests SET last_press = TIMESTAMP ''{}'', presses = presses + 1 WHERE guest = "{}"', minute_txt, cookie)
      WHEN event_type = 'purchase' THEN
        format('INSERT INTO receipts TABLE till WHERE till_no BETWEEN {} AND {} OR closed >= ''{}''', k, k + 9, minute_txt)
      WHEN event_type = 'signup' THEN 'MERGE INTO members m USING joined j ON m.card = ? WHEN NOT MATCHED THEN INSERT VALUES (?, ?)'
      ELSE format('ALTER TABLE receipts DROP PARTITION (branch = ''{}'', lot IN (''{}'', ''spare''))', pub, cookie)
    END AS query_text,
    'pipeline ' || event_type || ' statement' AS query_description,
    CASE WHEN event_type IN ('view', 'signup') THEN 'HCD' ELSE 'Presto' END AS query_type,
    CASE WHEN event_type = 'signup' THEN ['[[' || CAST(user_id AS VARCHAR) || ', 1]]', minute_txt, adv] END
      AS parameters,
    ts AS start_time,
    ts + to_microseconds(CAST(floor(value * 40.0 * 1000) AS BIGINT)) AS end_time,
    value * 40.0 AS execution_time_ms,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(k AS BIGINT) END AS rows_returned,
    event_type <> 'error' AS success,
    CASE WHEN event_type = 'error' THEN 'Query exceeded maximum time limit' END AS error_message,
    event_type = 'signup' AS prepared,
    CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS retry_count
  FROM (
    SELECT event_id, ts, user_id, event_type, value, k,
           'PID_' || lpad(CAST(k % 20 AS VARCHAR), 3, '0') AS pub,
           'AID_' || lpad(CAST(k % 5 AS VARCHAR), 3, '0') AS adv,
           'CID_' || CAST(user_id AS VARCHAR) AS cookie,
           strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute_txt
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
)"""


def fingerprint_sql(col: str) -> str:
    """DuckDB form of clickpath.functions.text.query_fingerprint, from the same rule list."""
    s = f"upper(trim({col}))"
    for pattern, repl in (*FINGERPRINT_RULES, (r"\s+", " ")):
        quoted = pattern.replace("'", "''")
        s = f"regexp_replace({s}, '{quoted}', '{repl.replace('$', chr(92))}', 'g')"
    return f"trim({s})"
