"""Customer-path timelines and per-advertiser conversion lists.

``conversion_timeline`` pairs each attributed conversion with the impressions
of the same (advertiser, cookie) between its first-touch impression and the
conversion -- an impression appears once per conversion it lies under -- and
keeps the first rows of each path.  Only the impressions that can reach the cut
are paired: a running count of open conversions per (path, time bucket) says how
many rows an impression gives, and all beyond the cut go before the join.  A hot
cookie is split over its time buckets; each hands at most ``limit`` impressions on.

First-touch spans begin at an impression of their path, so every span gives a row at
its start and the first ``limit`` spans of a path hold its first ``limit`` rows
(``first_touch=True``): those spans travel as one short list per (path, time bucket),
impressions look them up, and no conversion is paired beyond the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import epoch_micros

TIMELINE_ROWS = 100      # fixed value: rows per timeline
CONVERSION_ROWS = 100    # fixed value: rows per advertiser conversion list


def conversion_timeline(impressions: DataFrame, attributed: DataFrame, lookback_seconds: int,
                        advertiser=None, cookie=None, limit: int = TIMELINE_ROWS,
                        span_factor: int = 4, first_touch: bool = False) -> DataFrame:
    """advertisers_id, cookie_id, publishers_id, timestamp, impressions, conversion_timestamp,
    formatted_time; the first ``limit`` rows per (advertiser, cookie) by time
    (ties: publisher, conversion time).  ``advertiser``/``cookie`` narrow to one path.
    ``first_touch`` states that every ``impression_timestamp`` is the time of an impression
    of its path in ``impressions``, as ``first_touch_attribution`` gives it."""
    keys = ["advertisers_id", "cookie_id"]
    imp, att = impressions, attributed
    for k, v in (("advertisers_id", advertiser), ("cookie_id", cookie)):
        if v is not None:
            imp = imp.where(F.col(k) == F.lit(v))
            att = att.where(F.col(k) == F.lit(v))
    span = max(1, int(lookback_seconds)) * 1_000_000
    width = span * max(1, int(span_factor))
    it = imp.select(*keys, "publishers_id", "timestamp", "impressions", epoch_micros("timestamp").alias("__t"))
    it = it.withColumn("__b", F.floor(F.col("__t") / F.lit(width)))
    if first_touch:
        att = _first_spans(att, keys, width, limit)
    # a conversion is copied into every bucket that its span touches (two at most)
    spans = att.select(*keys, F.col("impression_timestamp").alias("__first"), "conversion_timestamp",
                       epoch_micros("impression_timestamp").alias("__from"), epoch_micros("conversion_timestamp").alias("__to"))
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__from") / F.lit(width)), F.floor(F.col("__to") / F.lit(width)))))
    if first_touch:
        return _timeline_rows(_under_listed_spans(it, spans, keys, limit), keys, limit)
    kept = _reach_the_cut(it, spans, keys, limit)
    ct = spans.select(*[F.col(k).alias(f"__c_{k}") for k in keys], "__first", "conversion_timestamp", F.col("__b").alias("__cb"))
    cond = [kept[k] == ct[f"__c_{k}"] for k in keys] + [
        kept["__b"] == ct["__cb"],
        kept["timestamp"] >= ct["__first"], kept["timestamp"] <= ct["conversion_timestamp"]]
    return _timeline_rows(kept.join(ct, cond), keys, limit)


def _timeline_rows(pairs: DataFrame, keys: list, limit: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("timestamp", "publishers_id", "conversion_timestamp")
    top = pairs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit)
    return top.select(*keys, "publishers_id", "timestamp", "impressions", "conversion_timestamp",
                      F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("formatted_time"))


def _first_spans(attributed: DataFrame, keys: list, width: int, limit: int) -> DataFrame:
    """The first ``limit`` spans of each path by start and end, cut in the time bucket of
    their start and then in their path, so a hot path's spans are sorted bucket by bucket."""
    order = ["impression_timestamp", "conversion_timestamp"]
    spans = attributed.select(*keys, *order, F.floor(epoch_micros("impression_timestamp") / F.lit(width)).alias("__b"))
    here = Window.partitionBy(*keys, "__b").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__rn", F.row_number().over(here)).where(F.col("__rn") <= limit)
    return spans.withColumn("__before", F.count(F.lit(1)).over(before)).where(F.col("__before") < limit).select(*keys, *order)


def _under_listed_spans(impressions: DataFrame, spans: DataFrame, keys: list, limit: int) -> DataFrame:
    """(impression, conversion) rows of the first ``limit`` impressions of each path that lie
    under one of its spans; a path has ``limit`` spans at most, listed per time bucket."""
    span = F.struct(F.col("__from").alias("from"), F.col("__to").alias("to"), "conversion_timestamp")
    lists = spans.groupBy(*keys, "__b").agg(F.collect_list(span).alias("__spans"))
    under = impressions.join(lists, [*keys, "__b"]).withColumn(
        "__open", F.filter("__spans", lambda x: (x["from"] <= F.col("__t")) & (x["to"] >= F.col("__t")))).where(F.size("__open") > 0)
    path = Window.partitionBy(*keys).orderBy("timestamp", "publishers_id")
    first = under.withColumn("__rn", F.row_number().over(path)).where(F.col("__rn") <= limit)
    return first.select(*keys, "publishers_id", "timestamp", "impressions", F.explode("__open.conversion_timestamp").alias("conversion_timestamp"))


def _reach_the_cut(impressions: DataFrame, spans: DataFrame, keys: list, limit: int) -> DataFrame:
    """The impressions that give a row among the first ``limit`` of their path.

    In time order a span adds one open conversion at its start and takes it away
    after its end (start, impression, end at one time); the running sum at an
    impression is the number of its rows.  Impressions stay while the rows before
    them, in their bucket and then in their path, are below ``limit``.
    """
    nothing = [F.lit(None).cast("string").alias("publishers_id"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
               F.lit(None).cast("int").alias("impressions")]
    edge = F.explode(F.array(
        F.struct(F.col("__from").alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("d")),
        F.struct(F.col("__to").alias("t"), F.lit(2).alias("kind"), F.lit(-1).alias("d"))))
    edges = spans.withColumn("__e", edge).select(
        *keys, "__b", F.col("__e.t").alias("__t"), F.col("__e.kind").alias("__kind"), F.col("__e.d").alias("__d"), *nothing)
    seen = impressions.select(*keys, "__b", "__t", F.lit(1).alias("__kind"), F.lit(0).alias("__d"),
                              "publishers_id", "timestamp", "impressions")
    order = ["__t", "__kind", "publishers_id"]
    here = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = seen.unionByName(edges).withColumn("__open", F.sum("__d").over(here))
    rows = F.when(F.col("__kind") == 1, F.col("__open")).otherwise(F.lit(0))
    counted = counted.withColumn("__rows", rows).withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    first = counted.where((F.col("__rows") > 0) & (F.col("__before") < limit))
    path = Window.partitionBy(*keys).orderBy("__t", "publishers_id").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("__before", F.coalesce(F.sum("__rows").over(path), F.lit(0))).where(F.col("__before") < limit)
    return first.select(*keys, "publishers_id", "timestamp", "impressions", "__b")


def timeline_summary(timeline: DataFrame) -> DataFrame:
    """Per path: total_impressions (= timeline rows) and unique_publishers."""
    return timeline.groupBy("advertisers_id", "cookie_id").agg(
        F.count(F.lit(1)).alias("total_impressions"),
        F.countDistinct("publishers_id").alias("unique_publishers"))


def advertiser_conversions(attributed: DataFrame, advertiser=None, limit: int = CONVERSION_ROWS) -> DataFrame:
    """Newest ``limit`` attributed conversions per advertiser (ties: cookie, publisher)."""
    df = attributed if advertiser is None else attributed.where(F.col("advertisers_id") == F.lit(advertiser))
    w = Window.partitionBy("advertisers_id").orderBy(F.col("conversion_timestamp").desc(), "cookie_id",
                                                      "publishers_id")
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("__rn")
