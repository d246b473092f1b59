"""Stateful streaming: first-touch attribution as per-key state, series publishing through
``foreachBatch`` into a versioned table, and the multi-sink dual write.
"""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.ids import salt_bucket
from ..functions.timecols import epoch_seconds
from ..operators.attribution import LOOKBACK_SECONDS
from ..operators.series import entity_series_merge
from ..sources.adapters import CONVERSION_TYPES, IMPRESSION_TYPES
from ..sources.lake import KEEP_VERSIONS
from .pipeline import counted, of_types

def publisher_minute_stream(dom: DataFrame) -> DataFrame:
    """Finalised per-minute impression totals per publisher (append mode)."""
    g = counted(of_types(dom, IMPRESSION_TYPES).groupBy(F.window("ts", "1 minute"), "publishers_id"), "count")
    return g.select("publishers_id", epoch_seconds(F.col("window.start").cast("timestamp_ntz")).alias("ts"), "count")


SERIES_BUCKETS = 16


class SeriesTable:
    """Served entity rows in id buckets, each with versions of its own: ``base/id_bucket=b/v=n``.

    A micro-batch rewrites only the buckets of the ids it touches and leaves the other
    buckets' files alone; a bucket keeps its newest version and the one before it, which
    readers may still use.  Versions count per stream: a stream (its checkpoint) takes an
    offset above all versions it finds when it first writes, so a new checkpoint over an
    old table never meets an old batch's number, and a batch that runs again writes the
    versions it wrote before, from the same versions below them.
    """

    def __init__(self, spark: SparkSession, base: str, id_col: str = "publishers_id", buckets: int = SERIES_BUCKETS):
        self.spark, self.base, self.id_col, self.buckets = spark, base, id_col, buckets
        self.schema = f"{id_col} string, impressions string, conversions string, last_updated timestamp_ntz"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path
        return at(self.base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> dict[int, list[int]]:
        """Finished versions of each bucket, ascending."""
        fs, at = self._fs()
        out: dict[int, list[int]] = {}
        for st in fs.globStatus(at(os.path.join(self.base, "id_bucket=*", "v=*", "_SUCCESS"))) or ():
            version = st.getPath().getParent()
            bucket = int(version.getParent().getName().removeprefix("id_bucket="))
            out.setdefault(bucket, []).append(int(version.getName().removeprefix("v=")))
        return {b: sorted(v) for b, v in out.items()}

    def _path(self, bucket: int, version: int) -> str:
        return os.path.join(self.base, f"id_bucket={bucket}", f"v={version}")

    def _offset(self, checkpoint: str) -> int:
        fs, at = self._fs()
        name = hashlib.md5(checkpoint.encode()).hexdigest()
        found = fs.globStatus(at(os.path.join(self.base, "_streams", f"{name}-*"))) or ()
        for st in found:
            return int(st.getPath().getName().rsplit("-", 1)[1])
        offset = max((v[-1] for v in self.versions().values()), default=-1) + 1
        fs.mkdirs(at(os.path.join(self.base, "_streams", f"{name}-{offset}")))
        return offset

    def read(self, below: int | None = None, buckets=None) -> DataFrame:
        """The newest rows of all (or the given) buckets, of versions below ``below``."""
        paths = []
        for b, known in self.versions().items():
            usable = [v for v in known if below is None or v < below]
            if usable and (buckets is None or b in buckets):
                paths.append(self._path(b, usable[-1]))
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, points: DataFrame, version: int, metric: str, as_of=None) -> None:
        """Merge (id, ts, count) points as ``version`` of the buckets they touch."""
        bucket = salt_bucket(self.id_col, self.buckets).cast("int")
        touched = sorted(r[0] for r in points.select(bucket.alias("b")).distinct().collect())    # SERIES_BUCKETS at most
        if not touched:
            return
        merged = entity_series_merge(self.read(version, touched), points, self.id_col, metric, as_of=as_of)
        merged = merged.select(self.id_col, "impressions", "conversions", "last_updated").withColumn("__b", bucket).persist()
        fs, at = self._fs()
        try:
            for b in touched:
                merged.where(F.col("__b") == b).drop("__b").write.mode("overwrite").parquet(self._path(b, version))
        finally:
            merged.unpersist()
        for b, known in self.versions().items():
            for old in known[:-KEEP_VERSIONS] if b in touched else ():
                fs.delete(at(self._path(b, old)), True)

    def sink(self, checkpoint: str, metric: str = "impressions", as_of=None):
        """``foreachBatch`` function of the stream with this checkpoint."""
        def fn(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, self._offset(checkpoint) + batch_id, metric, as_of)
        return fn


def dual_write_sink(sinks: dict):
    """``foreachBatch`` function writing one micro-batch to several sinks.

    ``sinks`` maps a name to ``(path, transform)``; the batch is persisted once and
    each sink gets ``transform(batch)`` under ``path/batch_id=<id>`` (overwrite), so a
    retried batch rewrites the same directories instead of duplicating rows.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for _name, (path, transform) in sinks.items():
                transform(batch).write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
        finally:
            batch.unpersist()
    return fn


def minutes_of_batches(spark: SparkSession, path: str, keys: list, count_col: str = "impressions") -> DataFrame:
    """A rollup written per micro-batch by ``dual_write_sink``, whole: the partial counts
    of a minute that came in several batches are summed."""
    parts = spark.read.parquet(path)
    return parts.groupBy(*keys).agg(F.sum(count_col).cast(parts.schema[count_col].dataType).alias(count_col))


# --- first-touch attribution as per-key state (no pairs) -------------------------------------

ATTR_OUT = ("advertisers_id string, publishers_id string, cookie_id string, conversion_us bigint, "
            "impression_us bigint, time_to_conversion_seconds bigint")
ATTR_STATE = ("imp_advs array<string>, imp_minutes array<bigint>, imp_pubs array<string>, "
              "conv_advs array<string>, pending array<bigint>")


def _attribution_fn(lookback_seconds: int):
    span = int(lookback_seconds) * 1_000_000

    def fn(key, pdfs, state):
        cookie = key[0]
        books, pend = {}, {}        # by advertiser: publisher of each minute; minutes of waiting conversions
        if state.exists:
            advs, minutes, pubs, conv_advs, pending = state.get
            for adv, t, pub in zip(advs, minutes, pubs):
                books.setdefault(adv, {})[t] = pub
            for adv, t in zip(conv_advs, pending):
                pend.setdefault(adv, set()).add(t)
        for pdf in pdfs:
            if cookie is None or not len(pdf):
                continue
            # plain values: a group has few rows, for which pandas calls cost more than the loop
            for adv, t, kind, pub in zip(*(pdf[c].tolist() for c in ("advertisers_id", "__us", "event_type", "publishers_id"))):
                if t is None or t != t:     # no time
                    continue
                if kind in CONVERSION_TYPES:
                    pend.setdefault(adv, set()).add(int(t))         # equal conversions collapse
                elif kind in IMPRESSION_TYPES and isinstance(pub, str):
                    book = books.setdefault(adv, {})
                    book[int(t)] = min(pub, book.get(int(t), pub))  # per minute the smallest publisher
        wm = state.getCurrentWatermarkMs() * 1000
        out, kept, waits, wake = [], [], [], []
        for adv in {**books, **pend}:
            book, waiting = books.get(adv, {}), pend.get(adv, set())
            ready = sorted(c for c in waiting if c < wm)    # no impression before c can still arrive
            if ready and book:
                ms = sorted(book)
                for c in ready:
                    i = bisect_left(ms, c - span)
                    if i < len(ms) and ms[i] < c:
                        out.append((adv, book[ms[i]], cookie, c, ms[i], (c - ms[i]) // 1_000_000))
            waiting = sorted(waiting.difference(ready))
            # keep only impressions a pending or future conversion can still reach
            horizon = (waiting[0] if waiting else wm) - span
            left = sorted(m for m in book if m >= horizon)
            kept += [(adv, m, book[m]) for m in left]
            waits += [(adv, c) for c in waiting]
            if waiting or left:
                wake.append(waiting[0] if waiting else left[-1] + span)
        if out:
            yield pd.DataFrame(out, columns=["advertisers_id", "publishers_id", "cookie_id",
                                             "conversion_us", "impression_us", "time_to_conversion_seconds"])
        if not wake:
            if state.exists:
                state.remove()
            return
        state.update((*([r[i] for r in kept] for i in range(3)), *([r[i] for r in waits] for i in range(2))))
        state.setTimeoutTimestamp(max(min(wake) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    return fn


def stream_attribution_state(dom: DataFrame, lookback_seconds: int = LOOKBACK_SECONDS, as_of=None) -> DataFrame:
    """First-touch attribution as per-cookie state: one entry per advertiser and
    impression minute for one look-back, conversions held until the watermark passes
    them, then answered by a sorted search.  No (conversion x impression) pairs are
    formed, and state per key is bounded by the look-back in minutes per advertiser.

    A call per key costs more than the work in it, so a cookie's advertisers share one."""
    rows = of_types(dom, (*IMPRESSION_TYPES, *CONVERSION_TYPES)).select(
        "cookie_id", "ts", "advertisers_id", F.unix_micros("ts").alias("__us"), "event_type", "publishers_id")
    out = rows.groupBy("cookie_id").applyInPandasWithState(
        _attribution_fn(lookback_seconds), ATTR_OUT, ATTR_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    created = F.lit(str(as_of)).cast("timestamp_ntz") if as_of is not None else F.localtimestamp()
    return out.select(
        "advertisers_id", "publishers_id", "cookie_id",
        F.timestamp_micros("conversion_us").cast("timestamp_ntz").alias("conversion_timestamp"),
        F.timestamp_micros("impression_us").cast("timestamp_ntz").alias("impression_timestamp"),
        "time_to_conversion_seconds", created.alias("created_at"))
