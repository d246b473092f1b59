"""Domain DataFrames for the registered queries (lazy; nothing is collected)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.timecols import shift
from ..operators.attribution import first_touch_attribution
from ..session import shared_path
from ..sources import adapters, lake
from .registry import AS_OF


def impressions(spark: SparkSession, sf: str, start=None, end=None) -> DataFrame:
    return adapters.impression_tracking(spark, sf, start, end)


def conversions(spark: SparkSession, sf: str, start=None, end=None) -> DataFrame:
    return adapters.conversion_tracking(spark, sf, start, end)


def attributed(spark: SparkSession, sf: str, lookback_seconds: int = 5400,
               strategy: str = "window", start=None, end=None, cookies: DataFrame | None = None) -> DataFrame:
    """conversions_identified over the whole event month (every minute's job at once).

    ``start``/``end`` bound the conversions, and the impressions by one look-back more; both
    bounds reach the scans.  ``cookies`` restricts both sides before anything is attributed."""
    imp = impressions(spark, sf, shift(start, -lookback_seconds) if start is not None else None, end)
    conv = conversions(spark, sf, start, end)
    if cookies is not None:
        imp, conv = (df.join(cookies.select("cookie_id"), "cookie_id", "left_semi") for df in (imp, conv))
    return first_touch_attribution(imp, conv, lookback_seconds=lookback_seconds, as_of=AS_OF, strategy=strategy)


def lake_table(spark: SparkSession, sf: str, name: str) -> str:
    """Path of a fact table in the lake (hour folders, one repeatable append), written by the first
    reader of a session and data folder: ``raw_impressions`` or ``impression_tracking``."""
    build, ts = {"raw_impressions": (adapters.raw_impressions, "bucket_date"),
                 "impression_tracking": (adapters.impression_tracking, "timestamp")}[name]
    key = hashlib.md5(f"{spark.sparkContext.applicationId}:{os.path.abspath(sf)}".encode()).hexdigest()[:16]
    path = shared_path(spark, "lake", f"{name}-{key}")
    if not lake.is_written(spark, path):
        lake.append_batch(build(spark, sf), path, ts, 0)
    return path


# --- service run statistics derived from the pipeline's own outputs --------------------------
SERVICE_DESCRIPTIONS = (
    ("generate_traffic", "Raw impression and conversion intake"),
    ("hcd_to_presto", "Minute rollup of raw impressions into the lake"),
    ("presto_insights", "First-touch attribution of conversions"),
    ("presto_to_hcd", "Per-entity series publishing"),
    ("presto_cleanup", "Retention purge of lake tables"),
)


def service_points(spark: SparkSession, sf: str) -> DataFrame:
    """Long-form stats (name, metric, ts epoch seconds, value): one point per minute run."""
    from pyspark.sql import functions as F

    from ..functions.timecols import epoch_seconds

    def pts(df, name, metric, ts_col, value):
        return df.groupBy(ts_col).agg(value.cast("double").alias("value")).select(
            F.lit(name).alias("name"), F.lit(metric).alias("metric"),
            epoch_seconds(ts_col).alias("ts"), "value")
    # the four rollup metrics of a minute from one pass over the rollup
    per_publisher = impressions(spark, sf).groupBy("timestamp", "publishers_id").agg(
        F.sum("impressions").alias("n"), F.count(F.lit(1)).alias("groups"))
    per_minute = per_publisher.groupBy("timestamp").agg(
        F.sum("n").alias("n"), F.sum("groups").alias("groups"), F.count("publishers_id").alias("publishers"))
    metrics = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value"))
                        for name, metric, c in (("generate_traffic", "impressions_generated", "n"),
                                                ("hcd_to_presto", "impressions_aggregated", "groups"),
                                                ("hcd_to_presto", "impressions_processed", "n"),
                                                ("presto_to_hcd", "publishers_updated", "publishers"))])
    rolled = per_minute.select(epoch_seconds("timestamp").alias("ts"), F.explode(metrics).alias("m")).where(
        "m.metric <> 'publishers_updated' OR m.value > 0").select("m.name", "m.metric", "ts", "m.value")
    return (rolled
            .unionByName(pts(adapters.raw_conversions(spark, sf), "generate_traffic", "conversions_generated", "bucket_date",
                             F.count(F.lit(1))))
            .unionByName(pts(attributed(spark, sf), "presto_insights", "conversions_identified",
                             "conversion_timestamp", F.count(F.lit(1)))))


def service_descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SERVICE_DESCRIPTIONS), "name string, description string")
