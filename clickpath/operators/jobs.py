"""The per-minute jobs over lake tables: roll up, attribute, publish.

Each function handles one minute (the reference's "previous full minute") and
reads the lake tables with pruned scans (hour partitions from the time bounds,
time predicates pushed into Parquet), so a job touches only the partitions its
window needs -- one minute of rollup input, look-back + one minute of
impressions -- however long the tables grow.  A minute that runs again replaces
what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import MINUTE, epoch_seconds, ntz, shift, time_slice
from ..sources import lake
from .attribution import LOOKBACK_SECONDS, first_touch_attribution
from .rollup import ENTITY_ID, WRITE_BATCH_ROWS, entity_metric, impression_rollup, scan_minute_buckets
from .series import entity_series_merge


def rollup_minute(raw_impressions: DataFrame, minute, lake_path: str) -> dict:
    """Roll up one minute of raw impressions, write it as that minute of the lake table and return
    the run statistics (raw rows read, groups written, write batches).

    The statistics are collected with ``observe`` while the write runs -- one job,
    instead of counting the data again after writing it.
    """
    from pyspark.sql import Observation
    obs = Observation("rollup_minute")
    roll = impression_rollup(scan_minute_buckets(raw_impressions, minute))
    roll = roll.observe(obs, F.count(F.lit(1)).alias("impressions_aggregated"),
                        F.coalesce(F.sum("impressions"), F.lit(0)).cast("bigint").alias("impressions_processed"))
    lake.write_minute(roll, lake_path, "timestamp")
    stats = dict(obs.get)
    stats["impressions_batches"] = -(-stats["impressions_aggregated"] // WRITE_BATCH_ROWS)
    return stats


def attribute_minute(spark: SparkSession, impressions_path: str, conversions_path: str, minute,
                     attributed_path: str | None = None, lookback_seconds: int = LOOKBACK_SECONDS,
                     as_of=None) -> DataFrame:
    """First-touch attribution of the conversions in ``[minute, minute + 1)``.

    Impressions are read for ``[minute - lookback, minute + 1)`` only; with
    ``attributed_path`` the result is written as that minute of the attributed table.
    """
    end = shift(minute, MINUTE)
    imp = lake.scan_lake_table(spark, impressions_path, "timestamp", shift(minute, -lookback_seconds), end)
    conv = lake.scan_lake_table(spark, conversions_path, "timestamp", minute, end)
    out = first_touch_attribution(imp, conv, lookback_seconds=lookback_seconds, as_of=as_of,
                                  conv_start=minute, conv_end=end)
    if attributed_path is not None:
        lake.write_minute(out, attributed_path, "conversion_timestamp")
    return out


def publish_minute(spark: SparkSession, facts_path: str, series_base: str, minute, entity: str = "publishers",
                   as_of=None, metric: str = "impressions", lookback_minutes: int = LOOKBACK_SECONDS // MINUTE) -> str:
    """Merge one minute of per-entity totals into the versioned series table.

    ``facts_path`` is the lake table behind the metric: the impression rollup, the
    conversion facts (advertisers' conversions), or the attributed conversions
    (publishers' conversions: a trailing count by impression time over the look-back
    and the minute itself, so one look-back of attributed rows is read).
    """
    id_col = ENTITY_ID[entity]
    end = shift(minute, MINUTE)
    if (entity, metric) == ("publishers", "conversions"):
        pts = _trailing_minute(spark, facts_path, minute, lookback_minutes)
    else:
        pts = entity_metric(lake.scan_lake_table(spark, facts_path, "timestamp", minute, end), entity, metric, minute, end).select(
            id_col, epoch_seconds("timestamp").alias("ts"), F.col(f"total_{metric}").alias("count"))
    prev = lake.latest_version(spark, series_base)
    existing = (spark.read.parquet(prev) if prev else
                spark.createDataFrame([], f"{id_col} string, impressions string, conversions string, "
                                          "last_updated timestamp_ntz"))
    merged = entity_series_merge(existing, pts, id_col, metric, as_of=as_of)
    return lake.write_version(spark, merged.select(id_col, "impressions", "conversions", "last_updated"), series_base)


def _trailing_minute(spark: SparkSession, attributed_path: str, minute, lookback_minutes: int) -> DataFrame:
    """(publishers_id, ts, count): attributed conversions whose impression lies in
    ``[minute - look-back, minute + 1)``.  Their conversions follow the impression by
    one look-back at most, which bounds the scan of the attributed table."""
    span = lookback_minutes * MINUTE
    start, end = shift(minute, -span), shift(minute, MINUTE)
    rows = lake.scan_lake_table(spark, attributed_path, "conversion_timestamp", start, shift(end, span))
    recent = rows.where(F.col("publishers_id").isNotNull() & time_slice("impression_timestamp", start, end))
    return recent.groupBy("publishers_id").agg(F.count(F.lit(1)).alias("count")).select(
        "publishers_id", epoch_seconds(ntz(minute)).alias("ts"), "count")
