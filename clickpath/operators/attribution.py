"""First-touch attribution and conversion eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import localtime_or, seconds_between, shift, time_slice
from .lookup import _OUT, earliest_lookup, join_lookup, range_lookup

LOOKBACK_SECONDS = 90 * 60   # fixed value: 90-minute attribution look-back

ATTRIBUTED_COLUMNS = ("advertisers_id", "publishers_id", "cookie_id", "conversion_timestamp",
                      "impression_timestamp", "time_to_conversion_seconds", "created_at")


def first_touch_attribution(impressions: DataFrame, conversions: DataFrame,
                            lookback_seconds: int = LOOKBACK_SECONDS, as_of=None,
                            conv_start=None, conv_end=None, strategy: str = "window",
                            span_factor: int = 4) -> DataFrame:
    """Attribute every conversion to the earliest impression of the same cookie and
    advertiser in ``[conversion - lookback, conversion)``.

    ``impressions``: publishers_id, advertisers_id, cookie_id, timestamp (rollup rows).
    ``conversions``: advertisers_id, timestamp, cookie_id.
    Equal (advertiser, cookie, timestamp) conversions collapse to one row; ties on
    the impression time go to the smallest publishers_id; unmatched conversions
    are dropped.  ``conv_start``/``conv_end`` restrict the conversions handled (the
    per-minute job is ``[m, m + 1 minute)``) and prune the impression scan with
    literal bounds so the filter reaches Parquet.
    ``strategy``: "window" (running frame, O(n) per partition), "range" (sliding RANGE
    frame) or "join" (equi-join + residual); all three give the same rows.
    """
    keys = ["advertisers_id", "cookie_id"]
    conv = conversions.where(F.col("advertisers_id").isNotNull() & F.col("cookie_id").isNotNull()
                             & F.col("timestamp").isNotNull())
    imp = impressions.where(F.col("advertisers_id").isNotNull() & F.col("cookie_id").isNotNull()
                            & F.col("publishers_id").isNotNull() & F.col("timestamp").isNotNull())
    if conv_start is not None or conv_end is not None:
        conv = conv.where(time_slice("timestamp", conv_start, conv_end))
        imp = imp.where(time_slice("timestamp",
                                   shift(conv_start, -lookback_seconds) if conv_start is not None else None,
                                   conv_end))
    # Collapse duplicates before the shuffle: one conversion per (advertiser, cookie, time);
    # per (advertiser, cookie, time) only the smallest publisher can win a tie.  After this
    # a hot cookie has at most one row per distinct timestamp on each side.
    conv = conv.select(*keys, F.col("timestamp").alias("conversion_timestamp")).distinct()
    imp = imp.groupBy(*keys, "timestamp").agg(F.min("publishers_id").alias("publishers_id"))

    lo = -int(lookback_seconds) * 1_000_000
    hi = -1
    payload = F.struct(F.col("timestamp").alias("t"), F.col("publishers_id").alias("p"))
    if strategy == "window":
        hit = earliest_lookup(imp, conv, keys, "timestamp", "conversion_timestamp", payload, lo, hi, span_factor,
                              unique_fact_times=True)   # one impression row per (keys, time) above
    else:
        lookup = range_lookup if strategy == "range" else join_lookup
        hit = lookup(imp, conv, keys, "timestamp", "conversion_timestamp", payload, lo, hi, "min", span_factor)
    hit = hit.where(F.col(_OUT).isNotNull())
    return hit.select(
        "advertisers_id",
        F.col(f"{_OUT}.p").alias("publishers_id"),
        "cookie_id",
        "conversion_timestamp",
        F.col(f"{_OUT}.t").alias("impression_timestamp"),
        seconds_between(F.col(f"{_OUT}.t"), F.col("conversion_timestamp")).cast("bigint")
        .alias("time_to_conversion_seconds"),
        localtime_or(as_of).alias("created_at"),
    )


def eligible_conversions(impressions: DataFrame, conversion_attempts: DataFrame,
                         window_seconds: int = LOOKBACK_SECONDS, span_factor: int = 4) -> DataFrame:
    """Keep conversion attempts whose cookie has an impression (any advertiser) in
    ``[t - window, t]`` (the generator's tracker keeps ``ts >= now - 90 min``).

    Attempts with the same (cookie, time) share one answer, so only distinct keys
    go through the range lookup (a hot cookie adds no window rows), and the
    attempts are semi-joined back; AQE splits a skewed key on that join.
    """
    attempts = conversion_attempts.where(F.col("cookie_id").isNotNull())
    probes = attempts.select("cookie_id", "timestamp").distinct()
    imp = impressions.where(F.col("cookie_id").isNotNull()).select("cookie_id", "timestamp").distinct()
    lo = -int(window_seconds) * 1_000_000
    hit = earliest_lookup(imp, probes.withColumn("__probe_ts", F.col("timestamp")), ["cookie_id"],
                          "timestamp", "__probe_ts", F.col("timestamp"), lo, 0, span_factor,
                          unique_fact_times=True)   # imp is distinct on (cookie, timestamp)
    ok = hit.where(F.col(_OUT).isNotNull()).select("cookie_id", "timestamp")
    return attempts.join(ok, ["cookie_id", "timestamp"], "left_semi")


def attribution_stats(impressions: DataFrame, conversion_attempts: DataFrame,
                      window_seconds: int = LOOKBACK_SECONDS) -> DataFrame:
    """Per conversion minute: attempted, successful (eligible) and their rate (0 if none)."""
    ok = eligible_conversions(impressions, conversion_attempts, window_seconds)
    attempted = conversion_attempts.groupBy("timestamp").agg(
        F.count(F.lit(1)).alias("attempted_conversions"))
    good = ok.groupBy("timestamp").agg(F.count(F.lit(1)).alias("successful_conversions"))
    out = attempted.join(good, "timestamp", "left")   # both sides one row per minute
    succ = F.coalesce(F.col("successful_conversions"), F.lit(0)).cast("bigint")
    return out.select(
        "timestamp", "attempted_conversions", succ.alias("successful_conversions"),
        F.when(F.col("attempted_conversions") > 0, succ / F.col("attempted_conversions"))
        .otherwise(F.lit(0.0)).alias("attribution_rate"))
