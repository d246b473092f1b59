"""Payouts under rates with dates: what was paid, what it brought, and what has no rate.

``asof_lookup`` finds for every probe the newest change at or before it, without pairs and
without a partition per key: time is cut into buckets; what a bucket starts with comes from
a window over one row per (key, bucket), and the changes inside it from a window over the
bucket.  So a key with a third of all probes is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import DAY, epoch_micros

_T, _B, _KIND, _VALUE = "__t", "__bucket", "__kind", "__value"


def asof_lookup(changes: DataFrame, probes: DataFrame, keys, change_time: str, probe_time: str, payload, name: str,
                bucket_seconds: int = DAY) -> DataFrame:
    """``probes`` (distinct on keys and time) with ``name``: ``payload`` of the newest change of
    the same key that is not after the probe; null if there is none.

    Changes of one key at one time: the greatest payload counts.  Null keys and times never match.
    """
    keys = list(keys)
    width = int(bucket_seconds) * 1_000_000

    def placed(df, time, kind, value):
        out = df.where(F.col(time).isNotNull()).select(*keys, epoch_micros(time).alias(_T), F.lit(kind).alias(_KIND), value.alias(_VALUE))
        return out.withColumn(_B, F.floor(F.col(_T) / F.lit(width)))

    c = placed(changes, change_time, 1, payload)
    none = F.lit(None).cast(c.schema[_VALUE].dataType)
    p = placed(probes, probe_time, 2, none).distinct()
    # what the buckets with probes start with: the last change of the buckets before
    ends = c.groupBy(*keys, _B).agg(F.max(F.struct(_T, _VALUE))[_VALUE].alias(_VALUE)).withColumn(_KIND, F.lit(1))
    starts = p.select(*keys, _B).distinct().withColumn(_VALUE, none).withColumn(_KIND, F.lit(0))
    before = Window.partitionBy(*keys).orderBy(_B, _KIND).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (ends.unionByName(starts).withColumn(_VALUE, F.last(_VALUE, ignorenulls=True).over(before))
               .where(F.col(_KIND) == 0).withColumn(_T, F.col(_B) * F.lit(width)))
    inside = Window.partitionBy(*keys, _B).orderBy(_T, _KIND, _VALUE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (c.unionByName(p).unionByName(carried).withColumn(_VALUE, F.last(_VALUE, ignorenulls=True).over(inside))
             .where(F.col(_KIND) == 2).select(*[F.col(k).alias(f"__p_{k}") for k in keys], _T, F.col(_VALUE).alias(name)))
    at = probes.withColumn(_T, epoch_micros(probe_time))
    cond = [at[k] == found[f"__p_{k}"] for k in keys] + [at[_T] == found[_T]]
    return at.join(found, cond, "left").select(*[at[c] for c in probes.columns], name)


def payout_report(attributed: DataFrame, rates: DataFrame) -> DataFrame:
    """Per (publisher, advertiser): conversions, unrated_conversions, payout, value, roi.

    ``rates``: advertisers_id, valid_from, payout_cents, value_cents; a rate holds from
    ``valid_from`` until the advertiser's next one.  A conversion before the first rate is
    counted as unrated and is no part of the sums; ``roi`` is (value - payout) / payout,
    null where nothing was paid.  Sums are whole cents.
    """
    n = attributed.groupBy("publishers_id", "advertisers_id", "conversion_timestamp").agg(F.count(F.lit(1)).alias("n"))
    probes = n.select("advertisers_id", "conversion_timestamp").distinct()
    rated = asof_lookup(rates, probes, ["advertisers_id"], "valid_from", "conversion_timestamp",
                        F.struct("payout_cents", "value_cents"), "rate")
    j = n.join(rated, ["advertisers_id", "conversion_timestamp"])
    total = lambda c: F.coalesce(F.sum(F.col("n") * F.col(f"rate.{c}")), F.lit(0))
    sums = j.groupBy("publishers_id", "advertisers_id").agg(
        F.sum("n").alias("conversions"), F.coalesce(F.sum(F.when(F.col("rate").isNull(), F.col("n"))), F.lit(0)).alias("unrated_conversions"),
        total("payout_cents").alias("paid"), total("value_cents").alias("brought"))
    return sums.select("publishers_id", "advertisers_id", "conversions", "unrated_conversions",
                       (F.col("paid") / 100).alias("payout"), (F.col("brought") / 100).alias("value"),
                       F.when(F.col("paid") > 0, F.round((F.col("brought") - F.col("paid")) / F.col("paid"), 6)).alias("roi"))


def dated_order_rates(orders: DataFrame, month_start: str, advertiser_mod: int = 5, late_advertiser: int = 4) -> DataFrame:
    """Rates from order values, three a month and advertiser: mean order value of the orders of
    the month's first, second and last ten days, and one per cent of it as payout.  One
    advertiser has no rate in the first third."""
    from ..sources.adapters import _padded
    third = F.least(F.floor((F.dayofmonth("o_orderdate") - 1) / 10), F.lit(2))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    g = orders.groupBy((F.col("o_orderkey") % advertiser_mod).alias("a"), third.cast("int").alias("third")).agg(
        cents.alias("cents"), F.count(F.lit(1)).alias("n"))
    g = g.where((F.col("a") != late_advertiser) | (F.col("third") > 0))
    return g.select(_padded("AID_", F.col("a")).alias("advertisers_id"),
                    F.timestamp_add("DAY", F.col("third") * 10, F.lit(month_start).cast("timestamp_ntz")).alias("valid_from"),
                    F.expr("cents div (n * 100)").alias("payout_cents"), F.expr("cents div n").alias("value_cents"))
