"""Roadmap analyses named by the reference: fraud cohorts, similar advertisers,
cohort traffic, payouts, the publisher x advertiser matrix and rate anomalies.

None of them pairs raw rows: each starts from per-key aggregates (cookies,
publishers, advertisers, hours), and window functions run over those aggregates
partitioned by a dimension key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import publisher_cohort
from ..functions.timecols import HOUR, epoch_seconds, trunc_to
from ..sources.scratch import stored
from .graph import connected_components

LIFT = 3


def fraud_cohorts(impressions: DataFrame, suspects: DataFrame, sample: int = 10,
                  cohort_of=publisher_cohort) -> DataFrame:
    """Group suspect cookies by the set of publisher cohorts they were seen in.

    cohort_key (sorted cohort names joined by ','), suspects, impressions and the
    first ``sample`` cookie ids.  A cookie's cohort set is bounded by the number of
    cohorts, and the sample is a partial top-k, so no group is collected whole.
    """
    s = impressions.join(suspects.select("cookie_id"), "cookie_id", "left_semi")
    per_cookie = (s.groupBy("cookie_id")
                  .agg(F.array_join(F.array_sort(F.collect_set(cohort_of("publishers_id"))), ",")
                       .alias("cohort_key"),
                       F.sum("impressions").cast("bigint").alias("impressions")))
    rn = F.row_number().over(Window.partitionBy("cohort_key").orderBy("cookie_id"))
    samples = (per_cookie.withColumn("__rn", rn).where(F.col("__rn") <= sample)
               .groupBy("cohort_key").agg(F.array_sort(F.collect_list("cookie_id")).alias("sample_cookies")))
    sizes = per_cookie.groupBy("cohort_key").agg(F.count(F.lit(1)).alias("suspects"),
                                                 F.sum("impressions").cast("bigint").alias("impressions"))
    return sizes.join(samples, "cohort_key")


def cookie_links(impressions: DataFrame, suspects: DataFrame, lift: int = LIFT) -> tuple[DataFrame, DataFrame]:
    """Per (cookie, publisher) of the suspects the impressions and whether it is a link, and
    per cookie the impressions.

    A publisher links a cookie that spends there ``lift`` times the publisher's share of
    all suspects' impressions.  A hub has a large share, so hardly any cookie is linked by
    it, though its rows count in every figure; integers only, so no rounding decides."""
    seen = impressions.join(suspects.select("cookie_id"), "cookie_id", "left_semi")
    per_pair, _ = stored(seen.groupBy("cookie_id", "publishers_id").agg(F.sum("impressions").cast("bigint").alias("n")), "cookie-publishers")
    per_cookie = per_pair.groupBy("cookie_id").agg(F.sum("n").alias("cookie_n"))
    per_publisher = per_pair.groupBy("publishers_id").agg(F.sum("n").alias("publisher_n"))
    total = per_publisher.agg(F.sum("publisher_n").alias("total"))      # one row
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    linked = wide("n") * wide("total") >= F.lit(int(lift)) * (wide("cookie_n") * wide("publisher_n"))
    pairs = per_pair.join(per_cookie, "cookie_id").join(per_publisher, "publishers_id").crossJoin(F.broadcast(total))
    return pairs.select("cookie_id", "publishers_id", "n", linked.alias("linked")), per_cookie


def _linked(impressions: DataFrame, suspects: DataFrame, lift: int):
    pairs, per_cookie = cookie_links(impressions, suspects, lift)
    links = pairs.where("linked").select("cookie_id", "publishers_id", "n")
    # a cookie is a node by a loop, so that those without a link have a component too
    edges = links.select(F.concat(F.lit("0"), "cookie_id").alias("a"), F.concat(F.lit("1"), "publishers_id").alias("b")).union(
        per_cookie.select(F.concat(F.lit("0"), "cookie_id").alias("a"), F.concat(F.lit("0"), "cookie_id").alias("b")))
    found = connected_components(edges, "a", "b").where(F.substring("node", 1, 1) == "0")
    cohort = found.select(F.expr("substring(node, 2)").alias("cookie_id"), F.expr("substring(component, 2)").alias("cohort_id"))
    mine = links.groupBy("cookie_id").agg(F.count(F.lit(1)).alias("linked_publishers"), F.sum("n").alias("linked_impressions"))
    members = per_cookie.join(cohort, "cookie_id").join(mine, "cookie_id", "left").select(
        "cohort_id", "cookie_id", F.coalesce("linked_publishers", F.lit(0)).alias("linked_publishers"),
        F.col("cookie_n").alias("impressions"), F.coalesce("linked_impressions", F.lit(0)).alias("linked_impressions"))
    return members, links, cohort


def linked_cohort_members(impressions: DataFrame, suspects: DataFrame, lift: int = LIFT) -> DataFrame:
    """Suspect cookies by connected components of the cookie-publisher links: cohort_id (its
    least cookie), linked_publishers, impressions, linked_impressions, linked_share (of the
    cookie's impressions) and cohort_share (of the cohort's).  A cookie without a link is a
    cohort of one."""
    members, _, _ = _linked(impressions, suspects, lift)
    total = members.groupBy("cohort_id").agg(F.sum("impressions").alias("total"))
    return members.join(total, "cohort_id").select(
        "cohort_id", "cookie_id", "linked_publishers", "impressions", "linked_impressions",
        F.round(F.col("linked_impressions") / F.col("impressions"), 6).alias("linked_share"),
        F.round(F.col("impressions") / F.col("total"), 6).alias("cohort_share"))


def linked_cohorts(impressions: DataFrame, suspects: DataFrame, lift: int = LIFT) -> DataFrame:
    """One row per cohort of ``linked_cohort_members``: cookies, linking publishers, impressions."""
    members, links, cohort = _linked(impressions, suspects, lift)
    publishers = (links.join(cohort, "cookie_id").select("cohort_id", "publishers_id").distinct()
                  .groupBy("cohort_id").agg(F.count(F.lit(1)).alias("publishers")))
    sums = members.groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("cookies"), F.sum("impressions").alias("impressions"), F.sum("linked_impressions").alias("linked_impressions"))
    return sums.join(publishers, "cohort_id", "left").select(
        "cohort_id", "cookies", F.coalesce("publishers", F.lit(0)).alias("publishers"), "impressions", "linked_impressions",
        F.round(F.col("linked_impressions") / F.col("impressions"), 6).alias("linked_share"))


def similar_advertisers(impressions: DataFrame, target) -> DataFrame:
    """Cookie-overlap Jaccard of every advertiser with the ``target`` advertiser(s).

    ``target`` is an advertiser id or a one-column DataFrame of ids.  The target's
    cookies are semi-joined to the impressions, so the work is one pass and no
    pair of rows is formed.
    """
    pairs = impressions.select("advertisers_id", "cookie_id").distinct()
    if isinstance(target, DataFrame):
        tgt = target.select(F.col("advertisers_id").alias("target_id"))
    else:
        tgt = pairs.sparkSession.createDataFrame([(str(target),)], "target_id string")
    tc = pairs.join(tgt, pairs.advertisers_id == tgt.target_id).select("target_id", "cookie_id")
    sizes = pairs.groupBy("advertisers_id").agg(F.count(F.lit(1)).alias("cookies"))
    shared = (pairs.join(tc, "cookie_id").where(F.col("advertisers_id") != F.col("target_id"))
              .groupBy("target_id", "advertisers_id").agg(F.count(F.lit(1)).alias("shared_cookies")))
    tsize = sizes.select(F.col("advertisers_id").alias("target_id"), F.col("cookies").alias("target_cookies"))
    j = shared.join(sizes, "advertisers_id").join(tsize, "target_id")
    union = F.col("cookies") + F.col("target_cookies") - F.col("shared_cookies")
    return j.select("target_id", "advertisers_id", "shared_cookies", "cookies", "target_cookies",
                    F.round(F.col("shared_cookies") / union, 6).alias("jaccard"))


def cohort_traffic(impressions: DataFrame, cohort_of=publisher_cohort) -> DataFrame:
    """Per (cohort, publisher): impressions and share of the cohort's impressions."""
    g = (impressions.groupBy(cohort_of("publishers_id").alias("cohort"), "publishers_id")
         .agg(F.sum("impressions").cast("bigint").alias("impressions")))
    # a sum joined back, not a window: there are few cohorts and each has many publishers
    total = g.groupBy(F.col("cohort").alias("c")).agg(F.sum("impressions").alias("total"))
    j = g.join(total, F.col("cohort").eqNullSafe(F.col("c")))
    return j.select("cohort", "publishers_id", "impressions",
                    F.round(F.col("impressions") / F.col("total"), 6).alias("cohort_share"))


def payouts(attributed: DataFrame, rates: DataFrame) -> DataFrame:
    """Commission per (publisher, advertiser): attributed conversions x rate.

    ``rates``: advertisers_id, rate (money per conversion; caller-supplied).
    Advertisers without a rate pay 0.
    """
    c = attributed.groupBy("publishers_id", "advertisers_id").agg(F.count(F.lit(1)).alias("conversions"))
    j = c.join(rates.select("advertisers_id", "rate"), "advertisers_id", "left")
    return j.select("publishers_id", "advertisers_id", "conversions",
                    F.coalesce("rate", F.lit(0.0)).alias("rate"),
                    F.round(F.col("conversions") * F.coalesce("rate", F.lit(0.0)), 2).alias("payout"))


def order_value_rates(orders: DataFrame, advertiser_mod: int = 5, share: float = 0.01) -> DataFrame:
    """A rate table from order values: ``share`` of the mean order total per advertiser."""
    from ..sources.adapters import _padded
    return (orders.groupBy(_padded("AID_", F.col("o_orderkey") % advertiser_mod).alias("advertisers_id"))
            .agg(F.round(F.avg("o_totalprice") * share, 2).alias("rate")))


def publisher_advertiser_matrix(attributed: DataFrame) -> DataFrame:
    """Long-form matrix: conversions per (publisher, advertiser) and the share of the
    publisher's conversions (``pivot`` it for a wide view)."""
    g = attributed.groupBy("publishers_id", "advertisers_id").agg(F.count(F.lit(1)).alias("conversions"))
    total = F.sum("conversions").over(Window.partitionBy("publishers_id"))
    return g.withColumn("publisher_share", F.round(F.col("conversions") / total, 6))


def rate_anomalies(impressions: DataFrame, conversions: DataFrame, grain_seconds: int = HOUR,
                   trailing_seconds: int = 24 * HOUR, z_threshold: float = 3.0) -> DataFrame:
    """Per advertiser and hour: conversion rate %, mean and stddev of the rates in the
    trailing window (RANGE frame, current hour excluded), z-score and anomaly flag."""
    imp = (impressions.groupBy("advertisers_id", trunc_to("timestamp", grain_seconds).alias("period"))
           .agg(F.sum("impressions").cast("bigint").alias("impressions")))
    conv = (conversions.groupBy("advertisers_id", trunc_to("timestamp", grain_seconds).alias("period"))
            .agg(F.count(F.lit(1)).alias("conversions")))
    j = imp.join(conv, ["advertisers_id", "period"], "full_outer").select(
        "advertisers_id", "period", F.coalesce("impressions", F.lit(0)).alias("impressions"),
        F.coalesce("conversions", F.lit(0)).alias("conversions"))
    rate = F.when(F.col("impressions") > 0, F.col("conversions") * 100.0 / F.col("impressions")).otherwise(0.0)
    j = j.withColumn("rate", rate).withColumn("__t", epoch_seconds("period"))
    w = Window.partitionBy("advertisers_id").orderBy("__t").rangeBetween(-int(trailing_seconds), -1)
    mean, sd = F.avg("rate").over(w), F.stddev_samp("rate").over(w)
    out = j.withColumn("trailing_mean", mean).withColumn("trailing_stddev", sd)
    z = F.when(F.col("trailing_stddev") > 0,
               (F.col("rate") - F.col("trailing_mean")) / F.col("trailing_stddev"))
    return out.select(
        "advertisers_id", "period", "impressions", "conversions", F.round("rate", 6).alias("rate"),
        F.round("trailing_mean", 6).alias("trailing_mean"), F.round("trailing_stddev", 6).alias("trailing_stddev"),
        F.round(z, 6).alias("z_score"),
        F.coalesce(F.abs(z) > F.lit(z_threshold), F.lit(False)).alias("anomaly"))
