"""Per-cookie eligibility of conversions on event-time timers (``transformWithState``).

The state of a cookie is two lists: the minutes with impressions, and the conversions
that wait.  A conversion is judged when the watermark has passed its minute: until then
an impression under its look-back may still arrive on time, in whatever micro-batch.  So
the answer does not depend on how the input is cut into batches, and equals the batch
operator ``eligible_conversions`` over the rows that came on time.

One timer a cookie and batch stands at the first time at which something can leave: the
earliest waiting conversion's minute, or the oldest impression minute plus the look-back.
When it fires, judged conversions and minutes that no on-time conversion can reach leave the
state, and a timer is set for the next time; a cookie without either has none.  Calls of the
state and its timers cost more than the work, and a cookie takes a handful a batch.  So after
any batch the state holds exactly the impression minutes of the last look-back before the
watermark (or before the oldest waiting conversion), however hot the cookie.  ``state_left``
reads it back from the checkpoint.

State with timers is kept by Spark's RocksDB store, which ``rocksdb_state`` selects for
the queries started under it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.attribution import LOOKBACK_SECONDS
from ..sources.adapters import CONVERSION_TYPES, IMPRESSION_TYPES
from .pipeline import of_types

OUT = "cookie_id string, us bigint, advertisers_id string, conversion_id string, eligible boolean"
SEEN, WAITING = "impression_minutes", "waiting_conversions"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class CookieWindow(StatefulProcessor):
    def __init__(self, window_seconds: int):
        self.window = int(window_seconds) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState(SEEN, "us bigint")
        self.waiting = handle.getListState(WAITING, "us bigint, advertisers_id string, conversion_id string")

    def _minutes(self) -> np.ndarray:
        return np.array(sorted(r[0] for r in self.seen.get()), np.int64)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        minutes, waiting = set(), []
        for pdf in rows:
            # plain values: a group has few rows, for which pandas calls cost more than the loop
            for us, kind, adv, event in zip(*(pdf[c].tolist() for c in ("us", "event_type", "advertisers_id", "event_id"))):
                if us is None or us != us:      # no time
                    continue
                if kind in IMPRESSION_TYPES:
                    minutes.add(int(us))
                elif kind in CONVERSION_TYPES:
                    waiting.append((int(us), adv, event))
        if key[0] is None:
            return iter(())
        wake = [w[0] for w in waiting]
        if minutes:
            known = set(self._minutes().tolist())
            new = sorted(minutes - known)
            if new:
                self.seen.appendList([(m,) for m in new])
                if not known or new[0] < min(known):
                    wake.append(new[0] + self.window)       # the later timer finds what is left
        if waiting:
            self.waiting.appendList(waiting)
        if wake:
            self.handle.registerTimer(min(wake) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000        # rows up to here come no more
        known = self._minutes()
        waiting = [tuple(w) for w in self.waiting.get()]
        due = [w for w in waiting if w[0] < passed]
        if due:
            waiting = [w for w in waiting if w[0] >= passed]
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
            us = np.array([w[0] for w in due], np.int64)
            # the first impression minute under the look-back; eligible if it is not later
            at = np.searchsorted(known, us - self.window)
            ok = np.zeros(len(us), bool)
            has = at < len(known)
            ok[has] = known[at[has]] <= us[has]
            yield pd.DataFrame({"cookie_id": key[0], "us": us, "advertisers_id": [w[1] for w in due],
                                "conversion_id": [w[2] for w in due], "eligible": ok})
        wake = [w[0] for w in waiting]
        reached = min([passed, *wake]) - self.window
        kept = known[known >= reached]
        if len(kept) < len(known):
            if len(kept):
                self.seen.put([(m,) for m in kept.tolist()])
            else:
                self.seen.clear()
        if len(kept):
            wake.append(int(kept[0]) + self.window)
        if wake:
            # nothing changes before the watermark moves; the timer that fired is deleted after this
            self.handle.registerTimer(max(min(wake) // 1000, passed // 1000 + 1))

    def close(self) -> None:
        pass


def stream_cookie_window(dom: DataFrame, window_seconds: int = LOOKBACK_SECONDS) -> DataFrame:
    """Conversion attempts with ``eligible``: an impression of the cookie (any advertiser)
    lies in ``[t - window, t]``.  Emitted once the watermark has passed their minute."""
    rows = of_types(dom, (*IMPRESSION_TYPES, *CONVERSION_TYPES)).select(
        "cookie_id", "ts", F.unix_micros("ts").alias("us"), "event_type", "advertisers_id",
        F.col("event_id").cast("string").alias("event_id"))
    out = rows.groupBy("cookie_id").transformWithStateInPandas(CookieWindow(window_seconds), OUT, "Append", "EventTime")
    return out.select("cookie_id", F.timestamp_micros("us").alias("timestamp"), "advertisers_id", "conversion_id", "eligible")


def state_left(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(state, cookie_id, timestamp): what the last committed batch left in the tracker's state."""
    out = None
    for name in (SEEN, WAITING):
        rows = (spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", True).load(checkpoint)
                .select(F.lit(name).alias("state"), F.col("key.cookie_id").alias("cookie_id"),
                        F.timestamp_micros("list_element.us").cast("timestamp_ntz").alias("timestamp")))
        out = rows if out is None else out.unionByName(rows)
    return out
