"""Report aggregations over the impression / conversion / attributed tables.

Every report is a single declarative plan: the caller bounds the raw ``ts`` of its
source (the minute is computed, a bound on it alone would not reach the Parquet
scan), aggregates combine map-side,
and the only joins are between already-aggregated frames (one row per
publisher, or one row in total), never between raw facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cookie_class, publisher_cohort
from ..functions.series import safe_rate
from ..functions.timecols import DAY, MINUTE, add_seconds, minute_of, ntz, previous_full_minute, trunc_to

RATE_WINDOWS = (30, 60, 90, 180)   # fixed values: conversion-rate windows in minutes


def _since(col: str, as_of, seconds: int, inclusive_end: bool = False):
    end = ntz(as_of)
    lo = F.col(col) >= add_seconds(end, -int(seconds))
    return lo & ((F.col(col) <= end) if inclusive_end else (F.col(col) < end))


def conversion_rate_window(impressions: DataFrame, conversions: DataFrame, as_of,
                           window_minutes: int = 90) -> DataFrame:
    """total_impressions, total_conversions, conversion_rate_percent over
    ``[trunc(as_of) - w, trunc(as_of))`` -- two one-row aggregates, cross-joined."""
    end = minute_of(ntz(as_of))
    start = add_seconds(end, -window_minutes * MINUTE)
    imp = (impressions.where((F.col("timestamp") >= start) & (F.col("timestamp") < end)
                             & F.col("publishers_id").isNotNull())
           .agg(F.sum("impressions").cast("bigint").alias("total_impressions")))
    conv = (conversions.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
            .agg(F.count(F.lit(1)).alias("total_conversions")))
    j = imp.crossJoin(conv)   # 1 x 1 rows
    return j.select("total_impressions", "total_conversions",
                    safe_rate("total_conversions", "total_impressions").alias("conversion_rate_percent"))


def conversion_rate_windows(impressions: DataFrame, conversions: DataFrame, as_of,
                            windows=RATE_WINDOWS) -> DataFrame:
    """One row per window: window_key ``{w}_min_pct``, rate rounded to 4 (0.0 without data).

    One scan per table with conditional sums for all windows at once.
    """
    end = minute_of(ntz(as_of))
    widest = max(windows)
    lo = add_seconds(end, -widest * MINUTE)

    def within(w):
        return F.col("timestamp") >= add_seconds(end, -w * MINUTE)

    imp = (impressions.where((F.col("timestamp") >= lo) & (F.col("timestamp") < end)
                             & F.col("publishers_id").isNotNull())
           .agg(*[F.sum(F.when(within(w), F.col("impressions"))).alias(f"i{w}") for w in windows]))
    conv = (conversions.where((F.col("timestamp") >= lo) & (F.col("timestamp") < end))
            .agg(*[F.count_if(within(w)).alias(f"c{w}") for w in windows]))
    j = imp.crossJoin(conv)
    rows = F.array(*[F.struct(F.lit(f"{w}_min_pct").alias("window_key"),
                              F.round(safe_rate(F.col(f"c{w}"), F.col(f"i{w}")), 4).alias("conversion_rate"))
                     for w in windows])
    return j.select(F.inline(rows))


def rates_json(rates: DataFrame) -> DataFrame:
    """Collapse window rows into the stored JSON value ``{"90_min_pct": r, ...}`` (one row)."""
    return rates.agg(F.to_json(F.map_from_entries(F.sort_array(
        F.collect_list(F.struct("window_key", "conversion_rate"))))).alias("value"))


def top_publishers(impressions: DataFrame, as_of, seconds: int = DAY, limit: int = 10,
                   distinct_of: str = "advertisers_id") -> DataFrame:
    """publishers_id, total_impressions, unique_{advertisers|cookies} over the last day, top ``limit``."""
    name = "unique_advertisers" if distinct_of == "advertisers_id" else "unique_cookies"
    g = (impressions.where(_since("timestamp", as_of, seconds))
         .groupBy("publishers_id")
         .agg(F.sum("impressions").cast("bigint").alias("total_impressions"),
              F.countDistinct(distinct_of).alias(name)))
    return g.orderBy(F.col("total_impressions").desc(), F.col("publishers_id")).limit(limit)


def approx_reach(impressions: DataFrame, as_of, seconds: int = 7 * DAY, rsd: float = 0.05) -> DataFrame:
    """Approximate distinct cookies and impressions per publisher (HyperLogLog++)."""
    return (impressions.where(_since("timestamp", as_of, seconds)).groupBy("publishers_id")
            .agg(F.approx_count_distinct("cookie_id", rsd).alias("approx_unique_users"),
                 F.sum("impressions").cast("bigint").alias("total_impressions")))


def entity_daily(impressions: DataFrame, id_col: str, as_of, days: int, entity_id=None,
                 with_reach: bool = True) -> DataFrame:
    """Per (entity, day): impressions (and distinct cookies) over the last ``days`` days."""
    df = impressions.where(_since("timestamp", as_of, days * DAY))
    if entity_id is not None:
        df = df.where(F.col(id_col) == F.lit(entity_id))
    aggs = [F.sum("impressions").cast("bigint").alias("daily_impressions")]
    if with_reach:
        aggs.append(F.countDistinct("cookie_id").alias("unique_users"))
    return df.groupBy(id_col, F.to_date(trunc_to("timestamp", DAY)).alias("date")).agg(*aggs)


def historical_publisher_baseline(impressions: DataFrame, as_of, days: int = 7) -> DataFrame:
    """publishers_id, avg_impressions, avg_conversion_rate = COUNT(*)*100/AVG; HAVING AVG > 0."""
    g = (impressions.where(_since("timestamp", as_of, days * DAY)).groupBy("publishers_id")
         .agg(F.avg(F.col("impressions").cast("double")).alias("avg_impressions"),
              F.count(F.lit(1)).alias("__n")))
    return (g.where(F.col("avg_impressions") > 0)
            .select("publishers_id", "avg_impressions",
                    (F.col("__n") * 100.0 / F.col("avg_impressions")).alias("avg_conversion_rate")))


def realtime_vs_history(raw_impressions: DataFrame, impressions: DataFrame, as_of,
                        recent_seconds: int = 5 * MINUTE, days: int = 7) -> DataFrame:
    """Recent raw counts per publisher joined with the 7-day baseline;
    predicted_conversions = round(recent x rate / 100, 2).  Both sides are
    per-publisher aggregates, so the join is between small frames."""
    recent = (raw_impressions.where(F.col("bucket_date") >= add_seconds(ntz(as_of), -recent_seconds))
              .groupBy("publishers_id").agg(F.count(F.lit(1)).alias("recent_impressions")))
    base = historical_publisher_baseline(impressions, as_of, days)
    j = recent.join(base, "publishers_id")
    return j.select("publishers_id", "recent_impressions", "avg_conversion_rate",
                    F.round(F.col("recent_impressions") * F.col("avg_conversion_rate") / 100, 2)
                    .alias("predicted_conversions"))


def suspect_cookie_profile(impressions: DataFrame, as_of, days: int = 7, min_publishers: int = 10) -> DataFrame:
    """Cookies seen at more than ``min_publishers`` publishers in ``days`` days, with
    publisher_count, advertiser_count, total_impressions (one pass + HAVING)."""
    g = (impressions.where(_since("timestamp", as_of, days * DAY)).groupBy("cookie_id")
         .agg(F.countDistinct("publishers_id").alias("publisher_count"),
              F.countDistinct("advertisers_id").alias("advertiser_count"),
              F.sum("impressions").cast("bigint").alias("total_impressions")))
    return g.where(F.col("publisher_count") > min_publishers)


def publisher_conversion_rates(impressions: DataFrame, attributed: DataFrame) -> DataFrame:
    """Per (publisher, advertiser): impressions, attributed conversions, rate %."""
    imp = impressions.groupBy("publishers_id", "advertisers_id").agg(
        F.sum("impressions").cast("bigint").alias("impressions"))
    conv = attributed.groupBy("publishers_id", "advertisers_id").agg(F.count(F.lit(1)).alias("conversions"))
    j = imp.join(conv, ["publishers_id", "advertisers_id"], "left")
    c = F.coalesce("conversions", F.lit(0)).cast("bigint")
    return j.select("publishers_id", "advertisers_id", "impressions", c.alias("conversions"),
                    F.round(safe_rate(c, F.col("impressions")), 4).alias("conversion_rate"))


def traffic_class_counts(impressions: DataFrame) -> DataFrame:
    """Aggregated rows and impressions by cookie class (FRAUD / cohort / RANDOM / OTHER)."""
    return (impressions.groupBy(cookie_class("cookie_id").alias("cookie_class"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("impressions").cast("bigint").alias("impressions")))


def cohort_distribution(impressions: DataFrame, cohort_of=publisher_cohort) -> DataFrame:
    """Publishers per cohort."""
    pubs = impressions.select("publishers_id").distinct()
    return pubs.groupBy(cohort_of("publishers_id").alias("cohort")).agg(
        F.count(F.lit(1)).alias("publishers"))


def publish_stats(impressions: DataFrame, conversions: DataFrame, attributed: DataFrame) -> DataFrame:
    """Per publish task: entities touched and the total published."""
    per = impressions.groupBy("publishers_id", "advertisers_id").agg(F.sum("impressions").alias("n"))

    def total_of(idc):
        known = F.col(idc).isNotNull()
        return F.struct(F.countDistinct(idc).alias("entities"), F.sum(F.when(known, F.col("n"))).cast("bigint").alias("total"))

    # one pass over the rollup gives both impression tasks
    both = per.agg(total_of("publishers_id").alias("publisher_impressions"), total_of("advertisers_id").alias("advertiser_impressions"))
    tasks = ("publisher_impressions", "advertiser_impressions")
    rolled = both.select(F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("s")) for t in tasks])).alias("x")).select(
        "x.task", "x.s.entities", "x.s.total")

    def task(df, name, idc):
        return df.where(F.col(idc).isNotNull()).agg(
            F.lit(name).alias("task"), F.countDistinct(idc).alias("entities"), F.count(F.lit(1)).alias("total"))
    return (rolled.unionByName(task(conversions, "advertiser_conversions", "advertisers_id"))
            .unionByName(task(attributed, "publisher_conversions", "publishers_id")))


def overview_counts(impressions: DataFrame, conversions: DataFrame, as_of) -> DataFrame:
    """Landing page numbers: previous-minute impressions, conversions, active
    publishers and advertisers, and 24-hour impressions (one conditional aggregate per table)."""
    pm = previous_full_minute(as_of)
    last = F.col("timestamp") == pm
    imp = (impressions.where(_since("timestamp", as_of, DAY))
           .agg(F.coalesce(F.sum(F.when(last, F.col("impressions"))), F.lit(0)).cast("bigint").alias("impressions"),
                F.countDistinct(F.when(last, F.col("publishers_id"))).alias("active_publishers"),
                F.coalesce(F.sum("impressions"), F.lit(0)).cast("bigint").alias("impressions_24h")))
    conv = (conversions.where(last)
            .agg(F.count(F.lit(1)).alias("conversions"),
                 F.countDistinct("advertisers_id").alias("active_advertisers")))
    return imp.crossJoin(conv)


def cookie_window_stats(raw_impressions: DataFrame, as_of, window_seconds: int = 90 * MINUTE) -> DataFrame:
    """eligible_cookies_count, total_recent_impressions (ts >= as_of - window, up to as_of)
    and total_impressions_tracked (all up to as_of)."""
    df = raw_impressions.where(F.col("ts") <= ntz(as_of))
    recent = F.col("ts") >= add_seconds(ntz(as_of), -window_seconds)
    return df.agg(F.countDistinct(F.when(recent, F.col("cookie_id"))).alias("eligible_cookies_count"),
                  F.count_if(recent).alias("total_recent_impressions"),
                  F.count(F.lit(1)).alias("total_impressions_tracked"))
