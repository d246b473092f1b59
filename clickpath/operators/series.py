"""Capped per-entity time series, their merge, charts and totals.

Scale notes: "keep the newest ``cap`` points" is ``row_number() <= cap`` over
the entity; Catalyst turns it into a partial ``WindowGroupLimit`` that runs
before the shuffle, so even an entity holding a third of all rows ships at most
``cap`` rows per map task.  The collected arrays are therefore bounded by
``cap`` -- nothing unbounded is gathered per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import parse_series, series_json, series_total
from ..functions.timecols import epoch_seconds, from_epoch_micros, localtime_or

SERIES_CAP = 90   # fixed value: points kept per entity series


def keep_last_n(df: DataFrame, key, order_col: str, n: int) -> DataFrame:
    """Rows with the ``n`` largest ``order_col`` per key (partial top-k before the shuffle)."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def entity_series(points: DataFrame, id_col: str, ts_col: str = "timestamp", count_col: str = "count",
                  cap: int = SERIES_CAP) -> DataFrame:
    """(id, minute, count) points -> id, series (ascending, newest ``cap`` minutes).

    ``points`` must hold one row per (id, minute); a rewrite of a minute is the
    job of ``entity_series_merge``.
    """
    p = points.select(F.col(id_col), epoch_seconds(ts_col).alias("ts"),
                      F.col(count_col).cast("bigint").alias("count"))
    top = keep_last_n(p, id_col, "ts", cap)
    return (top.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct("ts", "count"))).alias("series")))


def entity_table(impression_points: DataFrame, conversion_points: DataFrame, id_col: str,
                 as_of=None, cap: int = SERIES_CAP, impressions_count: str = "total_impressions",
                 conversions_count: str = "total_conversions") -> DataFrame:
    """Served entity rows: id, impressions JSON, conversions JSON, last_updated.

    An entity with only one metric gets ``[]`` for the other.
    """
    imp = entity_series(impression_points, id_col, count_col=impressions_count, cap=cap) \
        .withColumnRenamed("series", "__imp")
    conv = entity_series(conversion_points, id_col, count_col=conversions_count, cap=cap) \
        .withColumnRenamed("series", "__conv")
    both = imp.join(conv, id_col, "full_outer")
    empty = F.array().cast("array<struct<ts:bigint,count:bigint>>")
    return both.select(
        F.col(id_col),
        series_json(F.coalesce("__imp", empty)).alias("impressions"),
        series_json(F.coalesce("__conv", empty)).alias("conversions"),
        localtime_or(as_of).alias("last_updated"))


def entity_series_merge(existing: DataFrame, updates: DataFrame, id_col: str, metric: str,
                        as_of=None, cap: int = SERIES_CAP, other_metric: str | None = None) -> DataFrame:
    """Merge new (id, ts, count) points into the JSON series column ``metric``.

    Per (id, ts) the newest write wins (updates beat existing points), the result is
    sorted ascending and capped at ``cap``; the other metric column is kept as is,
    and an entity seen for the first time starts with ``[]`` for it.
    ``updates``: id_col, ts (epoch seconds, bigint), count.
    """
    other = other_metric or ("conversions" if metric == "impressions" else "impressions")
    # version = (is_update, position): updates beat stored points, and within a stored
    # series a later element beats an earlier one for the same timestamp.
    old = (existing.select(id_col, F.posexplode(parse_series(metric)).alias("__pos", "p"))
           .select(id_col, F.col("p.ts").alias("ts"), F.col("p.count").alias("count"),
                   F.struct(F.lit(0).alias("u"), F.col("__pos").alias("pos")).alias("__v")))
    new = updates.select(id_col, F.col("ts").cast("bigint"), F.col("count").cast("bigint"),
                         F.struct(F.lit(1).alias("u"), F.lit(0).alias("pos")).alias("__v"))
    pts = (old.unionByName(new).groupBy(id_col, "ts")
           .agg(F.max_by("count", "__v").alias("count")))
    series = (keep_last_n(pts, id_col, "ts", cap).groupBy(id_col)
              .agg(F.array_sort(F.collect_list(F.struct("ts", "count"))).alias("series")))
    keep = existing.select(id_col, F.col(other).alias("__other"))
    merged = series.join(keep, id_col, "full_outer")
    return merged.select(
        id_col,
        F.coalesce(series_json("series"), F.lit("[]")).alias(metric),
        F.coalesce("__other", F.lit("[]")).alias(other),
        localtime_or(as_of).alias("last_updated"))


def entity_totals(entities: DataFrame, id_col: str) -> DataFrame:
    """id, total_impressions, total_conversions, conversion_rate (% to 2 decimals)."""
    from ..functions.series import conversion_rate_pct
    t = entities.select(id_col, series_total("impressions").alias("total_impressions"),
                        series_total("conversions").alias("total_conversions"))
    return t.withColumn("conversion_rate", conversion_rate_pct("total_conversions", "total_impressions"))


def entity_chart(entities: DataFrame, id_col: str) -> DataFrame:
    """Long-form chart rows: id, ts, label (HH:mm UTC), impressions, conversions.

    Both series are aligned on their timestamps (missing -> 0); when a series
    repeats a timestamp the later element wins.  Union + group-by, no join.
    """
    def points(col, name):
        return (entities.select(id_col, F.posexplode(parse_series(col)).alias("__pos", "p"))
                .select(id_col, F.col("p.ts").alias("ts"), "__pos",
                        F.col("p.count").alias(name),
                        F.lit(None).cast("bigint").alias("conversions" if name == "impressions" else "impressions")))
    u = points("impressions", "impressions").unionByName(points("conversions", "conversions"))
    g = u.groupBy(id_col, "ts").agg(
        F.max_by("impressions", F.when(F.col("impressions").isNotNull(), F.col("__pos"))).alias("impressions"),
        F.max_by("conversions", F.when(F.col("conversions").isNotNull(), F.col("__pos"))).alias("conversions"))
    return g.select(
        id_col, "ts",
        F.date_format(from_epoch_micros(F.col("ts") * F.lit(1_000_000)), "HH:mm").alias("label"),
        F.coalesce("impressions", F.lit(0)).cast("bigint").alias("impressions"),
        F.coalesce("conversions", F.lit(0)).cast("bigint").alias("conversions"))


def top_entities(entities: DataFrame, id_col: str, limit: int = 10) -> DataFrame:
    """Top ``limit`` by (total conversions, total impressions) desc, id asc: id, name."""
    t = entity_totals(entities, id_col)
    return (t.orderBy(F.col("total_conversions").desc(), F.col("total_impressions").desc(), F.col(id_col))
            .limit(limit)
            .select(id_col, F.col(id_col).alias("name"), "total_conversions", "total_impressions"))


def entity_sample(entities: DataFrame, id_col: str, limit: int = 10, seed: int = 42) -> DataFrame:
    """Random ``limit`` entities with their totals (the reference's shuffled pick).

    All entities are candidates, ordered by a hash of id and seed: the pick does not
    depend on partitioning.
    """
    t = entity_totals(entities, id_col)
    return t.orderBy(F.md5(F.concat(F.col(id_col), F.lit(f":{seed}")).cast("binary")), id_col).limit(limit).select(
        id_col, F.col(id_col).alias("name"), "total_impressions", "total_conversions")


def entity_lookup(entities: DataFrame, id_col: str, entity_id: str) -> DataFrame:
    """Point read: the entity row, or no row when absent."""
    return entities.where(F.col(id_col) == F.lit(entity_id))


def entity_list(entities: DataFrame, id_col: str) -> DataFrame:
    """All ids with display name = id."""
    return entities.select(id_col, F.col(id_col).alias("name"))
