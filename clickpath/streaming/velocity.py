"""Conversion velocity in update mode: levels are known while their window is still open.

Update mode emits a window's count again whenever it changes.  ``updates_sink`` writes a
micro-batch's changed rows under its batch id, so a batch that runs again replaces its own
rows; ``current`` merges them by key, the newest batch winning.  Every update stays
readable: ``levels`` tells how a key rose.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import risk_level
from ..sources.adapters import CONVERSION_TYPES
from .pipeline import counted, of_types

KEY = ("cookie_id", "timestamp")
UPDATES = "cookie_id string, timestamp timestamp_ntz, conversion_count bigint, risk_level string, batch_id bigint"


def velocity_updates(dom: DataFrame, window: str = "1 minute") -> DataFrame:
    """Conversions per cookie and window so far, with the conversions-only risk level."""
    g = counted(of_types(dom, CONVERSION_TYPES).groupBy(F.window("ts", window), "cookie_id"), "conversion_count")
    return g.select("cookie_id", F.col("window.start").cast("timestamp_ntz").alias("timestamp"), "conversion_count",
                    risk_level(F.col("conversion_count"), F.lit(None).cast("bigint")).alias("risk_level"))


def updates_sink(base: str):
    """``foreachBatch`` function: one folder a micro-batch, replaced if the batch runs again."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(base, f"batch_id={batch_id}"))
    return fn


def updates(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(UPDATES).parquet(base)


def current(updates: DataFrame) -> DataFrame:
    """The newest row of every key and the number of its updates (map-side combined)."""
    newest = F.max_by(F.struct("conversion_count", "risk_level"), "batch_id").alias("row")
    return updates.groupBy(*KEY).agg(newest, F.count(F.lit(1)).alias("updates")).select(*KEY, "row.*", "updates")


def levels(updates: DataFrame) -> DataFrame:
    """(key, levels): the levels a key reached, in order (at most one each: counts only grow)."""
    first = updates.groupBy(*KEY, "risk_level").agg(F.min("batch_id").alias("since"))
    rose = F.array_sort(F.collect_list(F.struct("since", "risk_level")))
    return first.groupBy(*KEY).agg(F.array_join(F.transform(rose, lambda x: x["risk_level"]), ">").alias("levels"))
