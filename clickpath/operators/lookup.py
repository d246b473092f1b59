"""Backward-looking time-range lookups without emitting pairs.

``range_lookup`` answers, for every *probe* row, an aggregate over the *fact*
rows that share its keys and whose time lies in ``[t + lo, t + hi]`` (``lo <= hi
<= 0``, microseconds).  It is the building block for first-touch attribution,
conversion eligibility and the cookie window counters.

Plan shape (one shuffle of facts ∪ probes, then a sort-based window):

* every row gets a time bucket ``floor(t / W)`` with ``W = span_factor * |lo|``;
  a fact is also copied into the *next* bucket when it can still be seen from
  there (``t + |lo| >= next bucket start``), so a probe only needs its own bucket;
* the window is partitioned by ``keys + bucket``: a hot key (one cookie with a
  third of all rows) is split over many buckets and therefore many tasks, and
  each window partition holds at most ``(span_factor + 1) * |lo|`` of time;
* a window evaluates the answer; nothing is joined, so no pairs.

``join_lookup`` is the equi-join form of the same question (keys + bucket as the
join key, the time range as residual condition, then a group-by), kept for
comparison in the bench.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import epoch_micros

_T = "__t"
_B = "__bucket"
_PROBE = "__is_probe"
_PAYLOAD = "__payload"
_OUT = "__hit"


def _bucket_width(lo: int, span_factor: int) -> int:
    return max(1, -int(lo)) * max(1, int(span_factor))


def _with_buckets(facts: DataFrame, lo: int, width: int) -> DataFrame:
    b = F.floor(F.col(_T) / F.lit(width))
    nxt = (b + 1) * F.lit(width)
    buckets = F.when(F.col(_T) - F.lit(lo) >= nxt, F.array(b, b + 1)).otherwise(F.array(b))
    return facts.withColumn(_B, F.explode(buckets))


def range_lookup(facts: DataFrame, probes: DataFrame, keys, fact_time: str, probe_time: str,
                 payload, lo: int, hi: int, agg: str = "min", span_factor: int = 4) -> DataFrame:
    """Attach ``__hit`` = agg(payload) over facts in ``[t+lo, t+hi]`` to each probe row.

    ``payload`` is a Column over ``facts`` (a struct for arg-min style lookups).
    Probe rows keep all their columns; ``__hit`` is null when nothing matched.
    """
    keys = list(keys)
    width = _bucket_width(lo, span_factor)
    f = facts.select(*keys, epoch_micros(fact_time).alias(_T), payload.alias(_PAYLOAD))
    f = _with_buckets(f, lo, width).withColumn(_PROBE, F.lit(False))
    probe_cols = [c for c in probes.columns if c not in keys]
    p = probes.select(*keys, *probe_cols, epoch_micros(probe_time).alias(_T))
    p = p.withColumn(_B, F.floor(F.col(_T) / F.lit(width))).withColumn(_PROBE, F.lit(True))
    for c in probe_cols:
        f = f.withColumn(c, F.lit(None).cast(probes.schema[c].dataType))
    p = p.withColumn(_PAYLOAD, F.lit(None).cast(f.schema[_PAYLOAD].dataType))
    u = f.unionByName(p)
    w = Window.partitionBy(*keys, _B).orderBy(_T).rangeBetween(int(lo), int(hi))
    fn = {"min": F.min, "max": F.max, "count": F.count, "sum": F.sum}[agg]
    out = u.withColumn(_OUT, fn(_PAYLOAD).over(w)).where(F.col(_PROBE))
    return out.select(*keys, *probe_cols, _OUT)


def earliest_lookup(facts: DataFrame, probes: DataFrame, keys, fact_time: str, probe_time: str,
                    payload, lo: int, hi: int, span_factor: int = 4,
                    unique_fact_times: bool = False) -> DataFrame:
    """``range_lookup`` with agg="min" where the payload is ordered by time first
    (e.g. ``struct(ts, id)``): the earliest fact in ``[t+lo, t+hi]`` or null.

    ``unique_fact_times``: the caller guarantees one fact per (keys, time) -- e.g.
    after a per-minute pre-aggregation -- so ties need no payload ordering and the
    sort key stays two primitive columns."""
    keys = list(keys)
    width = _bucket_width(lo, span_factor)
    f = facts.select(*keys, epoch_micros(fact_time).alias(_T),
                     F.struct(epoch_micros(fact_time).alias("t"), payload.alias("v")).alias(_PAYLOAD))
    f = _with_buckets(f, lo, width).withColumn(_PROBE, F.lit(False)).withColumn("__pt", F.lit(None).cast("bigint"))
    probe_cols = [c for c in probes.columns if c not in keys]
    p = probes.select(*keys, *probe_cols, epoch_micros(probe_time).alias("__pt"))
    p = (p.withColumn(_B, F.floor(F.col("__pt") / F.lit(width)))
         .withColumn(_T, F.col("__pt") + F.lit(int(lo)))            # marker at the window start
         .withColumn(_PROBE, F.lit(True)))
    for c in probe_cols:
        f = f.withColumn(c, F.lit(None).cast(probes.schema[c].dataType))
    p = p.withColumn(_PAYLOAD, F.lit(None).cast(f.schema[_PAYLOAD].dataType))
    u = f.unionByName(p)
    order = [F.col(_T).desc(), F.col(_PROBE).asc()] + ([] if unique_fact_times else [F.col(_PAYLOAD).desc()])
    w = (Window.partitionBy(*keys, _B).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nearest = F.last(_PAYLOAD, ignorenulls=True).over(w)
    out = u.withColumn("__near", nearest).where(F.col(_PROBE))
    hit = F.when(F.col("__near.t") <= F.col("__pt") + F.lit(int(hi)), F.col("__near.v"))
    return out.select(*keys, *probe_cols, hit.alias(_OUT))


def join_lookup(facts: DataFrame, probes: DataFrame, keys, fact_time: str, probe_time: str,
                payload, lo: int, hi: int, agg: str = "min", span_factor: int = 4) -> DataFrame:
    """Same contract as ``range_lookup`` as keys+bucket equi-join with a range residual.

    Probes must be distinct on ``keys + probe_time`` (the result is regrouped on them).
    """
    keys = list(keys)
    width = _bucket_width(lo, span_factor)
    f = facts.select(*[F.col(k).alias(f"__f_{k}") for k in keys],
                     epoch_micros(fact_time).alias(_T), payload.alias(_PAYLOAD))
    f = _with_buckets(f, lo, width)
    probe_cols = [c for c in probes.columns if c not in keys]
    p = probes.withColumn("__pt", epoch_micros(probe_time))
    p = p.withColumn(_B + "_p", F.floor(F.col("__pt") / F.lit(width)))
    cond = [p[k] == f[f"__f_{k}"] for k in keys] + [
        p[_B + "_p"] == f[_B],
        f[_T] >= p["__pt"] + F.lit(int(lo)),
        f[_T] <= p["__pt"] + F.lit(int(hi)),
    ]
    j = p.join(f, cond, "left")
    fn = {"min": F.min, "max": F.max, "count": F.count, "sum": F.sum}[agg]
    return j.groupBy(*keys, *probe_cols).agg(fn(_PAYLOAD).alias(_OUT))
