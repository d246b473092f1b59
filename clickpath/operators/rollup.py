"""Minute rollups and per-entity minute aggregates.

All aggregates are plain ``groupBy().agg()`` so Spark does a map-side partial
aggregation before the shuffle: a hot publisher or cookie is reduced to one row
per (key, minute) per task before anything moves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import MINUTE, epoch_micros, from_epoch_micros, time_slice

ENTITY_ID = {"publishers": "publishers_id", "advertisers": "advertisers_id"}
WRITE_BATCH_ROWS = 10_000   # fixed value: rows per write statement in the reference


def scan_minute_buckets(raw: DataFrame, minute) -> DataFrame:
    """One minute of raw facts across all salt buckets, however many the writer used.

    One predicate instead of one read per bucket: on a table partitioned by
    (bucket_date, bucket) Catalyst prunes to exactly those partitions.
    """
    from ..functions.timecols import ntz
    return raw.where(F.col("bucket_date") == ntz(minute))


def scan_minute_range(raw: DataFrame, start, end) -> DataFrame:
    """All minutes in ``[start, end)`` across salt buckets (a backfill of the minute scan)."""
    return raw.where(time_slice("bucket_date", start, end))


def impression_rollup(raw_impressions: DataFrame) -> DataFrame:
    """Count raw impressions per (publisher, advertiser, cookie, minute)."""
    return (raw_impressions
            .groupBy("publishers_id", "advertisers_id", "cookie_id", "bucket_date")
            .agg(F.count(F.lit(1)).cast("int").alias("impressions"))
            .withColumnRenamed("bucket_date", "timestamp"))


def impression_rollup_by_cookie(raw_impressions: DataFrame) -> DataFrame:
    """Per (publisher, cookie, minute): count, advertiser of the first impression
    (earliest ts, then impression_id)."""
    first = F.min_by("advertisers_id", F.struct("ts", "impression_id"))
    return (raw_impressions
            .groupBy("publishers_id", "cookie_id", "bucket_date")
            .agg(first.alias("advertisers_id"), F.count(F.lit(1)).cast("int").alias("impressions"))
            .withColumnRenamed("bucket_date", "timestamp"))


def conversion_facts(raw_conversions: DataFrame) -> DataFrame:
    """Raw conversions mapped 1:1 to (advertiser, minute, cookie); no grouping."""
    return raw_conversions.select("advertisers_id", F.col("bucket_date").alias("timestamp"), "cookie_id")


def entity_impressions_minute(impressions: DataFrame, entity: str = "publishers",
                              start=None, end=None) -> DataFrame:
    """SUM(impressions) per entity and minute (the per-minute job run for every minute)."""
    idc = ENTITY_ID[entity]
    return (impressions.where(F.col(idc).isNotNull() & time_slice("timestamp", start, end))
            .groupBy(idc, "timestamp")
            .agg(F.sum("impressions").cast("bigint").alias("total_impressions")))


def advertiser_conversions_minute(conversions: DataFrame, start=None, end=None) -> DataFrame:
    """COUNT(*) per advertiser and minute."""
    return (conversions.where(F.col("advertisers_id").isNotNull() & time_slice("timestamp", start, end))
            .groupBy("advertisers_id", "timestamp")
            .agg(F.count(F.lit(1)).alias("total_conversions")))


def entity_metric(facts: DataFrame, entity: str, metric: str, start=None, end=None) -> DataFrame:
    """Generic (entity x metric) minute aggregate: impressions = SUM, conversions = COUNT.

    Publisher conversions cannot be answered from the conversion facts (they carry
    no publisher); use ``publisher_conversions_trailing`` on attributed rows.
    """
    if entity not in ENTITY_ID:
        raise ValueError(f"unknown entity {entity!r}")
    if metric == "impressions":
        return entity_impressions_minute(facts, entity, start, end)
    if metric == "conversions":
        if entity != "advertisers":
            raise ValueError("conversions per publisher need attributed rows")
        return advertiser_conversions_minute(facts, start, end)
    raise ValueError(f"unknown metric {metric!r}")


def publisher_conversions_trailing(attributed: DataFrame, lookback_minutes: int = 90) -> DataFrame:
    """Attributed conversions per publisher by impression time over ``[t - 90m, t + 1m)``,
    stamped ``t``, for every minute ``t`` with a non-zero count (a rolling sum).

    Change-point form, proportional to the output: a (publisher, impression minute)
    count ``n`` adds ``+n`` at that minute and ``-n`` one look-back + 1 minute later.
    A running sum over each publisher's change points gives the count on every
    segment between consecutive change points, and only segments with a positive
    count are expanded into their minutes -- each output minute is produced once,
    instead of spreading every input row over 91 minutes.  The window holds two
    rows per active minute of a publisher (bounded by time, not by volume).
    """
    step = MINUTE * 1_000_000
    m = epoch_micros("impression_timestamp")
    per_minute = (attributed.where(F.col("publishers_id").isNotNull())
                  .groupBy("publishers_id", (m - F.pmod(m, F.lit(step))).alias("__m"))
                  .agg(F.count(F.lit(1)).alias("__n")))
    span = F.lit((int(lookback_minutes) + 1) * step)
    deltas = per_minute.select(
        "publishers_id",
        F.explode(F.array(F.struct(F.col("__m").alias("c"), F.col("__n").alias("d")),
                          F.struct((F.col("__m") + span).alias("c"), (-F.col("__n")).alias("d")))).alias("e"))
    changes = (deltas.groupBy("publishers_id", F.col("e.c").alias("c")).agg(F.sum("e.d").alias("d")))
    w = Window.partitionBy("publishers_id").orderBy("c")
    seg = (changes.withColumn("v", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("next", F.lead("c").over(w))
           .where((F.col("v") > 0) & F.col("next").isNotNull()))
    minutes = F.sequence(F.col("c"), F.col("next") - F.lit(step), F.lit(step))
    return seg.select("publishers_id", F.explode(minutes).alias("__t"), "v").select(
        "publishers_id", from_epoch_micros(F.col("__t")).alias("timestamp"),
        F.col("v").cast("bigint").alias("total_conversions"))


def publisher_conversions_minute(attributed: DataFrame) -> DataFrame:
    """True per-minute attributed conversions per publisher (by impression minute)."""
    step = MINUTE * 1_000_000
    m = epoch_micros("impression_timestamp")
    return (attributed.where(F.col("publishers_id").isNotNull())
            .groupBy("publishers_id", from_epoch_micros(m - F.pmod(m, F.lit(step))).alias("timestamp"))
            .agg(F.count(F.lit(1)).alias("total_conversions")))


def rollup_stats(raw_impressions: DataFrame, batch_rows: int = WRITE_BATCH_ROWS) -> DataFrame:
    """Per minute batch: raw rows read, groups written, write batches, impressions.

    One pass over the rollup instead of the reference's repeated actions.
    """
    roll = impression_rollup(raw_impressions)
    per = roll.groupBy("timestamp").agg(
        F.sum("impressions").cast("bigint").alias("impressions_processed"),
        F.count(F.lit(1)).alias("impressions_aggregated"))
    return per.withColumn(
        "impressions_batches",
        F.ceil(F.col("impressions_aggregated") / F.lit(float(batch_rows))).cast("bigint"))


def write_batches(rows: int, batch_rows: int = WRITE_BATCH_ROWS) -> int:
    return int(math.ceil(rows / batch_rows)) if rows else 0
