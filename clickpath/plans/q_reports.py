"""Registered queries: report aggregations, predicates and timelines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.timecols import DAY, MINUTE, time_slice
from ..operators import fraud as FR
from ..operators import partials as PA
from ..operators import reports as R
from ..operators import timeline as TL
from ..session import shared_path
from ..sources import adapters
from . import domain
from .registry import ADAPTER_SQL, AS_OF, attributed_sql, back, register, with_ctes

A = f"TIMESTAMP '{AS_OF}'"


def _since(col, interval):
    return f"{col} >= {A} - INTERVAL {interval} AND {col} < {A}"


@register("conversion_rate_window", with_ctes(ADAPTER_SQL) + f"""
SELECT i.total_impressions, c.total_conversions,
       CASE WHEN i.total_impressions > 0
            THEN CAST(c.total_conversions AS DOUBLE) / CAST(i.total_impressions AS DOUBLE) * 100
            ELSE 0.0 END AS conversion_rate_percent
FROM (SELECT CAST(sum(impressions) AS BIGINT) AS total_impressions FROM impression_tracking
      WHERE {_since('timestamp', '90 MINUTE')} AND publishers_id IS NOT NULL) i
CROSS JOIN (SELECT count(*) AS total_conversions FROM conversion_tracking
            WHERE {_since('timestamp', '90 MINUTE')}) c""")
def q_rate_window(spark, sf):
    return R.conversion_rate_window(domain.impressions(spark, sf, back(90 * MINUTE), AS_OF), domain.conversions(spark, sf, back(90 * MINUTE), AS_OF), AS_OF, 90)


def _rate_sql(w):
    return f"""
SELECT '{w}_min_pct' AS window_key,
       round(CASE WHEN i.t > 0 THEN CAST(c.n AS DOUBLE) / CAST(i.t AS DOUBLE) * 100 ELSE 0.0 END, 4)
         AS conversion_rate
FROM (SELECT sum(impressions) AS t FROM impression_tracking
      WHERE {_since('timestamp', f'{w} MINUTE')} AND publishers_id IS NOT NULL) i
CROSS JOIN (SELECT count(*) AS n FROM conversion_tracking WHERE {_since('timestamp', f'{w} MINUTE')}) c"""


@register("conversion_rate_windows", with_ctes(ADAPTER_SQL) + "\nUNION ALL".join(
    _rate_sql(w) for w in R.RATE_WINDOWS))
def q_rate_windows(spark, sf):
    return R.conversion_rate_windows(domain.impressions(spark, sf, back(180 * MINUTE), AS_OF), domain.conversions(spark, sf, back(180 * MINUTE), AS_OF), AS_OF)


@register("top_publishers", with_ctes(ADAPTER_SQL) + f"""
SELECT publishers_id, CAST(sum(impressions) AS BIGINT) AS total_impressions,
       count(DISTINCT advertisers_id) AS unique_advertisers
FROM impression_tracking WHERE {_since('timestamp', '1 DAY')}
GROUP BY publishers_id ORDER BY total_impressions DESC, publishers_id LIMIT 10""")
def q_top_publishers(spark, sf):
    return R.top_publishers(domain.impressions(spark, sf, back(DAY), AS_OF), AS_OF)


@register("top_publishers_reach", with_ctes(ADAPTER_SQL) + f"""
SELECT publishers_id, CAST(sum(impressions) AS BIGINT) AS total_impressions,
       count(DISTINCT cookie_id) AS unique_cookies
FROM impression_tracking WHERE {_since('timestamp', '1 DAY')}
GROUP BY publishers_id ORDER BY total_impressions DESC, publishers_id LIMIT 10""")
def q_top_publishers_reach(spark, sf):
    return R.top_publishers(domain.impressions(spark, sf, back(DAY), AS_OF), AS_OF, distinct_of="cookie_id")


@register("approx_reach")
def q_approx_reach(spark, sf):
    """HyperLogLog estimate: rows-only check (DuckDB's sketch differs)."""
    return R.approx_reach(domain.impressions(spark, sf, back(7 * DAY), AS_OF), AS_OF)


@register("advertiser_daily", with_ctes(ADAPTER_SQL) + f"""
SELECT advertisers_id, CAST(date_trunc('day', timestamp) AS DATE) AS date,
       CAST(sum(impressions) AS BIGINT) AS daily_impressions, count(DISTINCT cookie_id) AS unique_users
FROM impression_tracking WHERE {_since('timestamp', '7 DAY')} GROUP BY 1, 2""")
def q_advertiser_daily(spark, sf):
    return R.entity_daily(domain.impressions(spark, sf, back(7 * DAY), AS_OF), "advertisers_id", AS_OF, 7)


@register("publisher_daily", with_ctes(ADAPTER_SQL) + f"""
SELECT publishers_id, CAST(date_trunc('day', timestamp) AS DATE) AS date,
       CAST(sum(impressions) AS BIGINT) AS daily_impressions
FROM impression_tracking WHERE {_since('timestamp', '30 DAY')} GROUP BY 1, 2""")
def q_publisher_daily(spark, sf):
    return R.entity_daily(domain.impressions(spark, sf, back(30 * DAY), AS_OF), "publishers_id", AS_OF, 30, with_reach=False)


BASELINE_SQL = f"""
baseline AS (
  SELECT publishers_id, mean AS avg_impressions, n * 100.0 / mean AS avg_conversion_rate
  FROM (SELECT publishers_id, avg(impressions) AS mean, CAST(count(*) AS DOUBLE) AS n
        FROM impression_tracking WHERE {_since('timestamp', '7 DAY')} GROUP BY publishers_id)
  WHERE mean > 0
)"""


@register("historical_publisher_baseline", with_ctes(ADAPTER_SQL, BASELINE_SQL) + "\nSELECT * FROM baseline")
def q_baseline(spark, sf):
    return R.historical_publisher_baseline(domain.impressions(spark, sf, back(7 * DAY), AS_OF), AS_OF)


@register("realtime_vs_history", with_ctes(ADAPTER_SQL, BASELINE_SQL) + f"""
SELECT r.publishers_id, r.recent_impressions, b.avg_conversion_rate,
       round(r.recent_impressions * b.avg_conversion_rate / 100, 2) AS predicted_conversions
FROM (SELECT publishers_id, count(*) AS recent_impressions FROM raw_impressions
      WHERE bucket_date >= {A} - INTERVAL 60 MINUTE GROUP BY publishers_id) r
JOIN baseline b ON r.publishers_id = b.publishers_id""")
def q_realtime_vs_history(spark, sf):
    return R.realtime_vs_history(adapters.raw_impressions(spark, sf, back(60 * MINUTE)), domain.impressions(spark, sf, back(7 * DAY), AS_OF), AS_OF,
                                 recent_seconds=60 * MINUTE)


SUSPECT_SQL = f"""
SELECT cookie_id, count(DISTINCT publishers_id) AS publisher_count,
       count(DISTINCT advertisers_id) AS advertiser_count,
       CAST(sum(impressions) AS BIGINT) AS total_impressions
FROM impression_tracking WHERE {_since('timestamp', '7 DAY')}
GROUP BY cookie_id HAVING count(DISTINCT publishers_id) > 10"""


@register("suspect_cookie_profile", with_ctes(ADAPTER_SQL) + SUSPECT_SQL)
def q_suspect(spark, sf):
    return R.suspect_cookie_profile(domain.impressions(spark, sf, back(7 * DAY), AS_OF), AS_OF)


@register("having", with_ctes(ADAPTER_SQL) + f"""
SELECT cookie_id, count(*) AS rows FROM impression_tracking WHERE {_since('timestamp', '7 DAY')}
GROUP BY cookie_id HAVING count(*) >= 5""")
def q_having(spark, sf):
    imp = domain.impressions(spark, sf, back(7 * DAY), AS_OF)
    return imp.groupBy("cookie_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= 5)


@register("publisher_conversion_rates", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR")) + """
SELECT i.publishers_id, i.advertisers_id, i.impressions, CAST(coalesce(c.n, 0) AS BIGINT) AS conversions,
       round(CASE WHEN i.impressions > 0 THEN CAST(coalesce(c.n, 0) AS DOUBLE) / i.impressions * 100
                  ELSE 0.0 END, 4) AS conversion_rate
FROM (SELECT publishers_id, advertisers_id, CAST(sum(impressions) AS BIGINT) AS impressions
      FROM impression_tracking GROUP BY 1, 2) i
LEFT JOIN (SELECT publishers_id, advertisers_id, count(*) AS n FROM attributed GROUP BY 1, 2) c
  ON i.publishers_id = c.publishers_id AND i.advertisers_id = c.advertisers_id""")
def q_publisher_conversion_rates(spark, sf):
    return R.publisher_conversion_rates(domain.impressions(spark, sf),
                                        domain.attributed(spark, sf, lookback_seconds=DAY))


@register("traffic_class_counts", with_ctes(ADAPTER_SQL) + """
SELECT CASE WHEN starts_with(cookie_id, 'CID_FRAUD_') THEN 'FRAUD'
            WHEN starts_with(cookie_id, 'CID_TECH_') THEN 'TECH'
            WHEN starts_with(cookie_id, 'CID_FASHION_') THEN 'FASHION'
            WHEN starts_with(cookie_id, 'CID_HEALTH_') THEN 'HEALTH'
            WHEN starts_with(cookie_id, 'CID_FINANCE_') THEN 'FINANCE'
            WHEN starts_with(cookie_id, 'CID_TRAVEL_') THEN 'TRAVEL'
            WHEN starts_with(cookie_id, 'CID_RANDOM_') THEN 'RANDOM' ELSE 'OTHER' END AS cookie_class,
       count(*) AS rows, CAST(sum(impressions) AS BIGINT) AS impressions
FROM impression_tracking GROUP BY 1""")
def q_traffic_class(spark, sf):
    return R.traffic_class_counts(domain.impressions(spark, sf))


@register("cohort_distribution", with_ctes(ADAPTER_SQL) + """
SELECT CASE WHEN regexp_extract(publishers_id, '^PID_([A-Z]+)_[0-9]+$', 1) <> ''
              THEN regexp_extract(publishers_id, '^PID_([A-Z]+)_[0-9]+$', 1)
            WHEN regexp_extract(publishers_id, '([0-9]+)$', 1) <> ''
              THEN ['TECH', 'FASHION', 'HEALTH', 'FINANCE', 'TRAVEL'][
                     CAST(regexp_extract(publishers_id, '([0-9]+)$', 1) AS BIGINT) % 5 + 1] END AS cohort,
       count(*) AS publishers
FROM (SELECT DISTINCT publishers_id FROM impression_tracking) GROUP BY 1""")
def q_cohort_distribution(spark, sf):
    return R.cohort_distribution(domain.impressions(spark, sf), adapters.mapped_cohort)


@register("traffic_class_prefixed", with_ctes(ADAPTER_SQL) + """
SELECT ['FRAUD', 'TECH', 'FASHION', 'HEALTH', 'FINANCE', 'TRAVEL', 'RANDOM', 'OTHER'][
         CAST(CAST(substr(cookie_id, 5) AS BIGINT) % 8 + 1 AS INTEGER)] AS cookie_class,
       count(*) AS rows, CAST(sum(impressions) AS BIGINT) AS impressions
FROM impression_tracking GROUP BY 1""")
def q_traffic_class_prefixed(spark, sf):
    """Cookie classes over ids that carry them: every class is reached."""
    return R.traffic_class_counts(adapters.prefixed_facts(domain.impressions(spark, sf)))


@register("cohort_distribution_prefixed", with_ctes(ADAPTER_SQL) + """
SELECT ['TECH', 'FASHION', 'HEALTH', 'FINANCE', 'TRAVEL', NULL][CAST(CAST(substr(publishers_id, 5) AS BIGINT) % 6 + 1 AS INTEGER)] AS cohort,
       count(*) AS publishers
FROM (SELECT DISTINCT publishers_id FROM impression_tracking) GROUP BY 1""")
def q_cohort_distribution_prefixed(spark, sf):
    """Embedded cohorts of publishers, and the publishers without one."""
    return R.cohort_distribution(adapters.prefixed_facts(domain.impressions(spark, sf)))


@register("publish_stats", with_ctes(ADAPTER_SQL, attributed_sql()) + """
SELECT 'publisher_impressions' AS task, count(DISTINCT publishers_id) AS entities,
       CAST(sum(impressions) AS BIGINT) AS total FROM impression_tracking WHERE publishers_id IS NOT NULL
UNION ALL
SELECT 'advertiser_impressions', count(DISTINCT advertisers_id), CAST(sum(impressions) AS BIGINT)
FROM impression_tracking WHERE advertisers_id IS NOT NULL
UNION ALL
SELECT 'advertiser_conversions', count(DISTINCT advertisers_id), count(*)
FROM conversion_tracking WHERE advertisers_id IS NOT NULL
UNION ALL
SELECT 'publisher_conversions', count(DISTINCT publishers_id), count(*)
FROM attributed WHERE publishers_id IS NOT NULL""")
def q_publish_stats(spark, sf):
    return R.publish_stats(domain.impressions(spark, sf), domain.conversions(spark, sf),
                           domain.attributed(spark, sf))


@register("overview_counts", with_ctes(ADAPTER_SQL) + f"""
SELECT * FROM
 (SELECT CAST(coalesce(sum(impressions) FILTER (WHERE timestamp = {A} - INTERVAL 1 MINUTE), 0) AS BIGINT)
           AS impressions,
         count(DISTINCT publishers_id) FILTER (WHERE timestamp = {A} - INTERVAL 1 MINUTE) AS active_publishers,
         CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions_24h
  FROM impression_tracking WHERE {_since('timestamp', '1 DAY')}) i
CROSS JOIN
 (SELECT count(*) AS conversions, count(DISTINCT advertisers_id) AS active_advertisers
  FROM conversion_tracking WHERE timestamp = {A} - INTERVAL 1 MINUTE) c""")
def q_overview(spark, sf):
    return R.overview_counts(domain.impressions(spark, sf, back(DAY), AS_OF), domain.conversions(spark, sf, back(MINUTE), AS_OF), AS_OF)


@register("cookie_window_stats", with_ctes(ADAPTER_SQL) + f"""
SELECT count(DISTINCT cookie_id) FILTER (WHERE ts >= {A} - INTERVAL 90 MINUTE) AS eligible_cookies_count,
       count(*) FILTER (WHERE ts >= {A} - INTERVAL 90 MINUTE) AS total_recent_impressions,
       count(*) AS total_impressions_tracked
FROM raw_impressions WHERE ts <= {A}""")
def q_cookie_window_stats(spark, sf):
    return R.cookie_window_stats(adapters.raw_impressions(spark, sf), AS_OF)


@register("time_slice", with_ctes(ADAPTER_SQL) + """
SELECT * FROM impression_tracking
WHERE timestamp >= TIMESTAMP '2024-01-08 00:00:00' AND timestamp < TIMESTAMP '2024-01-15 00:00:00'""")
def q_time_slice(spark, sf):
    start, end = "2024-01-08 00:00:00", "2024-01-15 00:00:00"
    return domain.impressions(spark, sf, start, end).where(time_slice("timestamp", start, end))


@register("cookie_in_list", with_ctes(ADAPTER_SQL) + f"""
SELECT advertisers_id, timestamp, cookie_id FROM conversion_tracking
WHERE cookie_id IN (SELECT cookie_id FROM raw_conversions
                    WHERE bucket_date >= {A} - INTERVAL 1 DAY AND bucket_date < {A}
                    GROUP BY cookie_id ORDER BY count(*) DESC, cookie_id LIMIT 100)""")
def q_cookie_in_list(spark, sf):
    top = FR.fraud_stage1(adapters.raw_conversions(spark, sf, back(DAY), AS_OF), AS_OF, window_seconds=DAY)
    return FR._cookie_filter(domain.conversions(spark, sf), top)


TIMELINE_SQL = """
tl AS (
  SELECT i.advertisers_id, i.cookie_id, i.publishers_id, i.timestamp, i.impressions, a.conversion_timestamp,
         row_number() OVER (PARTITION BY i.advertisers_id, i.cookie_id
                            ORDER BY i.timestamp, i.publishers_id, a.conversion_timestamp) AS rn
  FROM impression_tracking i JOIN attributed a
    ON i.advertisers_id = a.advertisers_id AND i.cookie_id = a.cookie_id
  WHERE i.timestamp BETWEEN a.impression_timestamp AND a.conversion_timestamp
),
timeline AS (
  SELECT advertisers_id, cookie_id, publishers_id, timestamp, impressions, conversion_timestamp,
         strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS formatted_time
  FROM tl WHERE rn <= 100
)"""


def _timeline(spark, sf):
    return TL.conversion_timeline(domain.impressions(spark, sf),
                                  domain.attributed(spark, sf, lookback_seconds=DAY), lookback_seconds=DAY, first_touch=True)


@register("conversion_timeline", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR"), TIMELINE_SQL)
          + "\nSELECT * FROM timeline")
def q_timeline(spark, sf):
    return _timeline(spark, sf)


@register("timeline_summary", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR"), TIMELINE_SQL) + """
SELECT advertisers_id, cookie_id, count(*) AS total_impressions, count(DISTINCT publishers_id) AS unique_publishers
FROM timeline GROUP BY 1, 2""")
def q_timeline_summary(spark, sf):
    return TL.timeline_summary(_timeline(spark, sf))


@register("advertiser_conversions", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR")) + """
SELECT advertisers_id, publishers_id, cookie_id, conversion_timestamp, impression_timestamp,
       time_to_conversion_seconds, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY advertisers_id
                               ORDER BY conversion_timestamp DESC, cookie_id, publishers_id) AS rn
  FROM attributed) WHERE rn <= 100""")
def q_advertiser_conversions(spark, sf):
    return TL.advertiser_conversions(domain.attributed(spark, sf, lookback_seconds=DAY))


# --- reports from hourly partial states -------------------------------------------------------

def _partials(spark, sf, days):
    """The month's partials written to the lake (one pass over the facts), read for some days."""
    path = shared_path(spark, "lake", f"publisher-hours-{uuid.uuid4().hex[:12]}")
    PA.write_partials(PA.hourly_partials(domain.impressions(spark, sf), "publishers_id"), path)
    return lambda d: PA.read_partials(spark, path, back(d * DAY), AS_OF)


@register("baseline_from_partials", with_ctes(ADAPTER_SQL, BASELINE_SQL) + "\nSELECT * FROM baseline")
def q_baseline_from_partials(spark, sf):
    return PA.baseline(_partials(spark, sf, 7)(7))


@register("publisher_daily_from_partials", with_ctes(ADAPTER_SQL) + f"""
SELECT publishers_id, CAST(date_trunc('day', timestamp) AS DATE) AS date,
       CAST(sum(impressions) AS BIGINT) AS daily_impressions
FROM impression_tracking WHERE {_since('timestamp', '30 DAY')} GROUP BY 1, 2""")
def q_daily_from_partials(spark, sf):
    return PA.daily(_partials(spark, sf, 30)(30))


@register("reach_from_sketches", with_ctes(ADAPTER_SQL) + """
SELECT publishers_id, days, CAST(sum(impressions) AS BIGINT) AS impressions, count(DISTINCT cookie_id) AS unique_users, true AS within_error
FROM impression_tracking, (SELECT unnest([1, 7, 30]) AS days)
WHERE timestamp >= """ + A + """ - days * INTERVAL 1 DAY AND timestamp < """ + A + """ GROUP BY ALL""")
def q_reach_from_sketches(spark, sf):
    """Reach of every publisher over three windows from one set of sketches, beside the exact
    count and whether the estimate keeps the stated error."""
    window = _partials(spark, sf, 30)
    out = None
    for days in (1, 7, 30):
        exact = (domain.impressions(spark, sf, back(days * DAY), AS_OF).groupBy("publishers_id")
                 .agg(F.countDistinct("cookie_id").alias("unique_users")))
        near = F.abs(F.col("approx_unique_users") - F.col("unique_users")) <= F.ceil(F.col("unique_users") * PA.STATED_ERROR)
        one = PA.reach(window(days)).join(exact, "publishers_id").select(
            "publishers_id", F.lit(days).alias("days"), "impressions", "unique_users", near.alias("within_error"))
        out = one if out is None else out.unionByName(one)
    return out
