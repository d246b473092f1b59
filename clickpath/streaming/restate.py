"""Late rows restated: rollup and attribution stay equal to the batch result.

``intake`` is a ``foreachBatch`` function.  Its clock is the latest event time of the
batches before, less the delay: periods (hours by default) that ended before it are
published.  A row of a published period is late; it goes to a side table (``late``) instead
of being dropped.  All rows, late ones too, stay in ``raw``.  ``restate`` then recomputes
only what late rows touch and replaces it by dynamic partition overwrite:

* the rollup of the periods with late impressions;
* the attribution of the periods with late conversions, and of those that hold a conversion
  within one look-back after a late impression.

Tables (under one folder): ``raw`` and ``late`` by batch and period, ``progress`` by batch,
``rollup`` and ``attributed`` by period.  Every write replaces its own partitions, so a
batch that runs again, or a restatement that runs twice, changes nothing.  Periods are
chosen by joins and bounds on the partition column, so only their folders are read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import HOUR, epoch_seconds
from ..operators.attribution import LOOKBACK_SECONDS, first_touch_attribution
from ..operators.rollup import impression_rollup
from ..sources.adapters import CONVERSION_TYPES, IMPRESSION_TYPES

FACTS = "event_id bigint, timestamp timestamp_ntz, event_type string, publishers_id string, advertisers_id string, cookie_id string"
ROLLUP = "publishers_id string, advertisers_id string, cookie_id string, timestamp timestamp_ntz, impressions int"
ATTRIBUTED = ("advertisers_id string, publishers_id string, cookie_id string, conversion_timestamp timestamp_ntz, "
              "impression_timestamp timestamp_ntz, time_to_conversion_seconds bigint, created_at timestamp_ntz")


def _read(spark: SparkSession, base: str, name: str, columns: str) -> DataFrame:
    by_batch = ", batch_id bigint" if name in ("raw", "late") else ""
    return spark.read.schema(f"{columns}{by_batch}, period bigint").parquet(os.path.join(base, name))


def _write_periods(df: DataFrame, path: str, mode: str = "dynamic") -> None:
    (df.hint("rebalance", F.col("period")).write.mode("overwrite").option("partitionOverwriteMode", mode)
     .partitionBy("period").parquet(path))


def _between(start: int | None, end: int | None):
    """``period`` in ``[start, end)``; None is open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("period") >= start)
    return cond if end is None else cond & (F.col("period") < end)


class Restated:
    """The tables under ``base`` and the jobs on them; a period is ``seconds`` long."""

    def __init__(self, spark: SparkSession, base: str, seconds: int = HOUR, delay_seconds: int = 5,
                 lookback_seconds: int = LOOKBACK_SECONDS, as_of=None):
        self.spark, self.base, self.seconds, self.as_of = spark, base, int(seconds), as_of
        self.delay, self.lookback = int(delay_seconds), int(lookback_seconds)

    def _path(self, *parts: str) -> str:
        return os.path.join(self.base, *parts)

    def _period(self, ts, shift_seconds: int = 0):
        return F.floor((epoch_seconds(ts) + shift_seconds) / F.lit(self.seconds)).cast("bigint")

    def closed_until(self, before_batch: int | None = None) -> int | None:
        """Periods before this one are published by the batches before ``before_batch`` (None:
        by all of them); None if none is."""
        if before_batch == 0:
            return None
        rows = self.spark.read.schema("latest timestamp_ntz, batch_id bigint").parquet(self._path("progress"))
        if before_batch is not None:
            rows = rows.where(F.col("batch_id") < before_batch)
        return rows.agg(self._period(F.max("latest"), -self.delay)).first()[0]

    def intake(self, dom: DataFrame, batch_id: int) -> None:
        """One micro-batch of domain rows: stored, late ones noted, newly closed periods published."""
        closed = self.closed_until(batch_id)
        rows = dom.where(F.col("event_type").isin(*IMPRESSION_TYPES, *CONVERSION_TYPES)).select(
            F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"),
            "event_type", "publishers_id", "advertisers_id", "cookie_id")
        _write_periods(rows.withColumn("period", self._period("timestamp")), self._path("raw", f"batch_id={batch_id}"), "static")
        stored = _read(self.spark, self.base, "raw", FACTS).where(F.col("batch_id") == batch_id)
        late = stored.where(_between(None, closed)) if closed is not None else stored.limit(0)
        _write_periods(late.drop("batch_id"), self._path("late", f"batch_id={batch_id}"), "static")
        (dom.agg(F.max("ts").cast("timestamp_ntz").alias("latest")).where("latest is not null")
         .write.mode("overwrite").parquet(self._path("progress", f"batch_id={batch_id}")))
        until = self.closed_until(batch_id + 1)
        if until is not None and until != closed:
            self.publish(closed, until)

    def publish(self, start: int | None, end: int | None = None) -> None:
        """Rollup and attribution of the periods ``[start, end)`` (None: open)."""
        self._rollup(lambda df: df.where(_between(start, end)))
        reach = None if start is None else start - -(-self.lookback // self.seconds)
        self._attribute(lambda df: df.where(_between(start, end)), lambda df: df.where(_between(reach, end)))

    def finish(self) -> None:
        """Publish the periods that are still open (end of a finite replay)."""
        self.publish(self.closed_until())

    def restate(self) -> None:
        """Recompute the published periods that late rows touch; open ones are published later,
        late rows included."""
        late = _read(self.spark, self.base, "late", FACTS)
        seen = late.where(F.col("event_type").isin(*IMPRESSION_TYPES))
        done = late.where(F.col("event_type").isin(*CONVERSION_TYPES)).select("period")
        self._rollup(lambda df: df.join(seen.select("period").distinct(), "period", "left_semi"))
        # conversions up to one look-back after a late impression
        reached = seen.select("period", self._period("timestamp", self.lookback).alias("last")).distinct().select(
            F.explode(F.sequence("period", "last")).alias("period"))
        touched = done.union(reached).distinct().where(_between(None, self.closed_until()))
        back = -(-self.lookback // self.seconds)
        read = touched.select(F.explode(F.sequence(F.col("period") - back, F.col("period"))).alias("period")).distinct()
        self._attribute(lambda df: df.join(touched, "period", "left_semi"), lambda df: df.join(read, "period", "left_semi"))

    def _facts(self, types) -> DataFrame:
        return _read(self.spark, self.base, "raw", FACTS).where(F.col("event_type").isin(*types))

    def _rollup(self, chosen) -> None:
        out = impression_rollup(chosen(self._facts(IMPRESSION_TYPES)).withColumnRenamed("timestamp", "bucket_date"))
        _write_periods(out.withColumn("period", self._period("timestamp")), self._path("rollup"))

    def _attribute(self, chosen, reachable) -> None:
        conv = chosen(self._facts(CONVERSION_TYPES)).select("advertisers_id", "timestamp", "cookie_id")
        out = first_touch_attribution(reachable(self.rollup()), conv, lookback_seconds=self.lookback, as_of=self.as_of)
        _write_periods(out.withColumn("period", self._period("conversion_timestamp")), self._path("attributed"))

    def rollup(self) -> DataFrame:
        return _read(self.spark, self.base, "rollup", ROLLUP)

    def attributed(self) -> DataFrame:
        return _read(self.spark, self.base, "attributed", ATTRIBUTED)

    def late(self) -> DataFrame:
        return _read(self.spark, self.base, "late", FACTS)
