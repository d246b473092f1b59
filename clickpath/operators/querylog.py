"""Query-log analytics: pattern collapse, summaries, top patterns, slow queries.

A log row is one executed statement: query_id, query_text, query_description,
query_type (engine), parameters, start_time, end_time, execution_time_ms,
rows_returned, success, error_message, prepared, retry_count.

The reference keeps one metrics object per fingerprint and overwrites its
timing on every repeat; here that is a two-level group-by (exact text, then
fingerprint) with first/last taken over ``(start_time, query_id)`` -- a
distributed aggregate with map-side combine, however hot a pattern is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SERVICE_TRUNCATE, query_fingerprint, sanitize_params, truncate_text

SLOW_MS = 1000.0        # fixed value: slow-query threshold
RECENT_QUERIES = 50     # fixed value: log entries kept per service


def with_fingerprint(log: DataFrame) -> DataFrame:
    return log.withColumn("simplified_query_text", query_fingerprint("query_text"))


def query_log_patterns(log: DataFrame) -> DataFrame:
    """One row per fingerprint: repeat_count, the first statement's id/text/type,
    and the latest execution's start, time, rows and outcome.

    Two-level aggregation: statements are first combined per exact text (map-side,
    cheap string hashing), so the fingerprint regexes run once per distinct text
    rather than once per execution; the per-text partials then merge per
    fingerprint.  First/last are ``min``/``max`` of structs led by
    ``(start_time, query_id)`` -- a total order, as ``min_by``/``max_by`` would give.
    """
    per_text = log.groupBy("query_text").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("start_time", "query_id", "query_type", "query_description")).alias("first"),
        F.max(F.struct("start_time", "query_id", "execution_time_ms", "rows_returned", "success")).alias("last"))
    fp = per_text.withColumn("simplified_query_text", query_fingerprint("query_text"))
    g = fp.groupBy("simplified_query_text").agg(
        F.sum("n").alias("repeat_count"),
        F.min(F.struct(F.col("first.start_time").alias("t"), F.col("first.query_id").alias("i"),
                       F.col("query_text").alias("text"), F.col("first.query_type").alias("type"),
                       F.col("first.query_description").alias("desc"))).alias("f"),
        F.max("last").alias("l"))
    return g.select(
        "simplified_query_text", "repeat_count",
        F.col("f.i").alias("query_id"), F.col("f.text").alias("query_text"), F.col("f.type").alias("query_type"),
        F.col("f.desc").alias("query_description"), F.col("l.start_time").alias("start_time"),
        F.col("l.execution_time_ms").alias("execution_time_ms"), F.col("l.rows_returned").alias("rows_returned"),
        F.col("l.success").alias("success"))


def query_log_summary(patterns: DataFrame, by_engine: bool = False) -> DataFrame:
    """total_queries (patterns), successful, failed, average ms of the successful
    ones (2 decimals; 0 when none) and their rows returned."""
    ok = F.col("success")
    aggs = [F.count(F.lit(1)).alias("total_queries"),
            F.count_if(ok).alias("successful_queries"),
            F.count_if(~ok).alias("failed_queries"),
            F.coalesce(F.round(F.avg(F.when(ok, F.col("execution_time_ms"))), 2), F.lit(0.0))
            .alias("average_execution_time_ms"),
            F.coalesce(F.sum(F.when(ok, F.col("rows_returned"))), F.lit(0)).cast("bigint")
            .alias("total_rows_returned")]
    return patterns.groupBy("query_type").agg(*aggs) if by_engine else patterns.agg(*aggs)


def query_log_top_patterns(patterns: DataFrame, limit: int = 5) -> DataFrame:
    """Patterns by executions (sum of repeat_count) desc with their mean ms; top ``limit``."""
    g = patterns.groupBy("simplified_query_text").agg(
        F.sum("repeat_count").cast("bigint").alias("total_executions"),
        F.avg(F.coalesce("execution_time_ms", F.lit(0.0))).alias("avg_execution_time_ms"))
    return g.orderBy(F.col("total_executions").desc(), F.col("simplified_query_text")).limit(limit)


def slow_queries(log: DataFrame, threshold_ms: float = SLOW_MS) -> DataFrame:
    return log.where(F.col("execution_time_ms") > F.lit(float(threshold_ms)))


def recent_queries(log: DataFrame, limit: int = RECENT_QUERIES) -> DataFrame:
    """The newest ``limit`` log entries (ties by query_id)."""
    return log.orderBy(F.col("start_time").desc(), F.col("query_id").desc()).limit(limit)


def query_log_display(log: DataFrame, max_length: int = SERVICE_TRUNCATE) -> DataFrame:
    """Log rows as served: truncated text, sanitised parameters, fingerprint."""
    return with_fingerprint(log).select(
        "query_id", truncate_text("query_text", max_length).alias("query_text"), "query_description",
        "query_type", sanitize_params("parameters").alias("parameters"), "start_time", "end_time",
        "execution_time_ms", "rows_returned", "success", "error_message", "prepared", "retry_count",
        "simplified_query_text")
