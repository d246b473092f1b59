"""Hourly partial states of entities in the lake, merged over any window.

Per (entity, hour): impressions, rows, and an HLL sketch of the cookies.  Sums add and
sketches unite, so a report over days reads entities x hours, whatever the facts' volume,
and a changed window reads no fact.  A day's folder is replaced as a whole when the day is
computed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import DAY, HOUR, time_slice, trunc_to

LG_K = 12
#: Four standard errors of a united sketch (1.04 / sqrt(2 ** LG_K) each).
STATED_ERROR = 4 * 1.04 / 2 ** (LG_K / 2)


def hourly_partials(impressions: DataFrame, id_col: str) -> DataFrame:
    """(id, hour, impressions, rows, reach): ``reach`` is the sketch of the hour's cookies.
    Rows without an id belong to no entity; null cookies count no reach."""
    hour = trunc_to("timestamp", HOUR)
    return (impressions.where(F.col(id_col).isNotNull())
            .groupBy(id_col, hour.alias("hour"))
            .agg(F.sum("impressions").cast("bigint").alias("impressions"), F.count(F.lit(1)).alias("rows"),
                 F.hll_sketch_agg("cookie_id", LG_K).alias("reach")))


def write_partials(partials: DataFrame, path: str) -> None:
    """Write by day; days that are there already are replaced, others stay."""
    keyed = partials.withColumn("day_key", F.date_format("hour", "yyyyMMdd").cast("int"))
    (keyed.hint("rebalance", F.col("day_key")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day_key").parquet(path))


def read_partials(spark: SparkSession, path: str, start, end) -> DataFrame:
    """The hours in ``[start, end)``; only the days' folders are read."""
    day = lambda t: F.date_format(F.lit(str(t)).cast("timestamp_ntz"), "yyyyMMdd").cast("int")
    return spark.read.parquet(path).where(time_slice("hour", start, end) & (F.col("day_key") >= day(start)) & (F.col("day_key") <= day(end)))


def merged(partials: DataFrame, *keys) -> DataFrame:
    """The partials of each group united: impressions, rows, reach (sketch)."""
    return partials.groupBy(*keys).agg(F.sum("impressions").alias("impressions"), F.sum("rows").alias("rows"),
                                       F.hll_union_agg("reach").alias("reach"))


def baseline(partials: DataFrame, id_col: str = "publishers_id") -> DataFrame:
    """``historical_publisher_baseline`` from partials: mean impressions a row, and the rate from it."""
    g = partials.groupBy(id_col).agg(F.sum("impressions").alias("s"), F.sum("rows").alias("n"))
    mean = F.col("s") / F.col("n")
    return g.where(F.col("s") > 0).select(id_col, mean.alias("avg_impressions"), (F.col("n") * 100.0 / mean).alias("avg_conversion_rate"))


def daily(partials: DataFrame, id_col: str = "publishers_id") -> DataFrame:
    """Impressions per (entity, day) from partials."""
    return partials.groupBy(id_col, F.to_date(trunc_to("hour", DAY)).alias("date")).agg(F.sum("impressions").alias("daily_impressions"))


def reach(partials: DataFrame, id_col: str = "publishers_id") -> DataFrame:
    """(id, impressions, approx_unique_users): distinct cookies within ``STATED_ERROR``."""
    return merged(partials, id_col).select(id_col, "impressions", F.hll_sketch_estimate("reach").alias("approx_unique_users"))
