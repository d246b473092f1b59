"""Registered queries: the streaming jobs replayed over the events file.

Each query runs its stream with ``availableNow`` into a fresh folder under the
shared checkpoint directory and returns the sink read back as a batch
DataFrame; the oracle is the batch SQL of the same operator (streaming must
equal batch once the heartbeat has flushed every window).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.timecols import DAY
from ..session import shared_path
from ..sources.tables import table_path
from ..streaming import pipeline as P
from ..streaming import restate as RS
from ..streaming import stateful as ST
from ..streaming import tracker as TR
from ..streaming import velocity as VE
from . import q_series
from .registry import ADAPTER_SQL, AS_OF, attributed_sql, register, with_ctes


def _scratch(spark, name):
    return shared_path(spark, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _dom(spark, sf, scratch):
    events = spark.read.parquet(table_path(sf, "events"))
    schema = events.schema
    last = events.agg(F.max("ts")).first()[0]
    if last is not None:
        P.write_heartbeats(spark, schema, f"{scratch}/heartbeat", last)
    glob = table_path(sf, "events")[:-1] + "[t]"     # a file stream needs a directory or a glob
    return P.domain_stream(P.event_stream(spark, glob, schema, heartbeat_dir=f"{scratch}/heartbeat" if last is not None else None))


def _run(spark, sf, name, build, mode="append"):
    scratch = _scratch(spark, name)
    out = build(_dom(spark, sf, scratch))
    P.run_available_now(out, f"{scratch}/sink", f"{scratch}/checkpoint", mode)
    return spark.read.parquet(f"{scratch}/sink")


@register("stream_rollup", with_ctes(ADAPTER_SQL) + """
SELECT publishers_id, advertisers_id, cookie_id, timestamp, impressions FROM impression_tracking""")
def q_stream_rollup(spark, sf):
    return _run(spark, sf, "rollup", P.stream_rollup)


@register("stream_attribution", with_ctes(ADAPTER_SQL, attributed_sql()) + """
SELECT advertisers_id, publishers_id, cookie_id, conversion_timestamp, impression_timestamp,
       time_to_conversion_seconds, created_at FROM attributed""")
def q_stream_attribution(spark, sf):
    return _run(spark, sf, "attribution", lambda d: P.stream_attribution(d, as_of=AS_OF))


@register("stream_attribution_state", with_ctes(ADAPTER_SQL, attributed_sql()) + """
SELECT advertisers_id, publishers_id, cookie_id, conversion_timestamp, impression_timestamp,
       time_to_conversion_seconds, created_at FROM attributed""")
def q_stream_attribution_state(spark, sf):
    return _run(spark, sf, "attribution-state", lambda d: ST.stream_attribution_state(d, as_of=AS_OF))


@register("stream_fraud_velocity", with_ctes(ADAPTER_SQL) + """
SELECT cookie_id, bucket_date AS timestamp, count(*) AS conversion_count,
       CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 10 THEN 'medium'
            WHEN count(*) >= 5 THEN 'low' ELSE 'clean' END AS risk_level
FROM raw_conversions GROUP BY cookie_id, bucket_date""")
def q_stream_fraud_velocity(spark, sf):
    return _run(spark, sf, "velocity", P.stream_fraud_velocity)


@register("stream_cookie_window", with_ctes(ADAPTER_SQL) + """
SELECT c.cookie_id, c.bucket_date AS timestamp, c.advertisers_id, c.conversion_id
FROM raw_conversions c
WHERE EXISTS (SELECT 1 FROM raw_impressions i WHERE i.cookie_id = c.cookie_id
              AND i.bucket_date >= c.bucket_date - INTERVAL 90 MINUTE AND i.bucket_date <= c.bucket_date)""")
def q_stream_cookie_window(spark, sf):
    with TR.rocksdb_state(spark):
        out = _run(spark, sf, "tracker", TR.stream_cookie_window)
    return out.where("eligible").select("cookie_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                                        "advertisers_id", "conversion_id")


@register("stream_state_left", with_ctes(ADAPTER_SQL) + """
SELECT DISTINCT 'impression_minutes' AS state, cookie_id, bucket_date AS timestamp
FROM raw_impressions, (SELECT date_trunc('minute', max(ts) + INTERVAL 2 MINUTE) - INTERVAL 5 SECOND AS watermark FROM events)
WHERE bucket_date + INTERVAL 90 MINUTE >= watermark""")
def q_stream_state_left(spark, sf):
    """State of the tracker after the whole replay, read back from its checkpoint: only the
    impression minutes of one look-back before the watermark, and no waiting conversion."""
    scratch = _scratch(spark, "tracker-state")
    with TR.rocksdb_state(spark):
        P.run_available_now(TR.stream_cookie_window(_dom(spark, sf, scratch)), f"{scratch}/sink", f"{scratch}/checkpoint")
        return TR.state_left(spark, f"{scratch}/checkpoint")


@register("stream_entity_series", with_ctes(*q_series.PUB_CTES) + f"""
SELECT i.id AS publishers_id, i.js AS impressions, '[]' AS conversions, TIMESTAMP '{AS_OF}' AS last_updated
FROM pub_imp_js i""")
def q_stream_entity_series(spark, sf):
    scratch = _scratch(spark, "series")
    table = ST.SeriesTable(spark, f"{scratch}/table")
    P.run_foreach_batch(ST.publisher_minute_stream(_dom(spark, sf, scratch)), table.sink(f"{scratch}/checkpoint", as_of=AS_OF), f"{scratch}/checkpoint")
    return table.read()


@register("stream_dual_write", with_ctes(ADAPTER_SQL) + """
SELECT 'impressions_by_minute' AS sink, publishers_id, advertisers_id, cookie_id, bucket_date AS timestamp, count(*) AS rows
FROM raw_impressions GROUP BY ALL
UNION ALL SELECT 'impression_tracking', publishers_id, advertisers_id, cookie_id, timestamp, CAST(impressions AS BIGINT)
FROM impression_tracking
UNION ALL SELECT 'conversions_by_minute', publishers_id, advertisers_id, cookie_id, bucket_date, count(*)
FROM raw_conversions GROUP BY ALL
UNION ALL SELECT 'conversion_tracking', NULL, advertisers_id, cookie_id, timestamp, count(*) FROM conversion_tracking GROUP BY ALL""")
def q_stream_dual_write(spark, sf):
    """Each micro-batch written to the four tables of the intake (raw impressions, their
    minute rollup, raw conversions, conversion facts); returns the rows per sink and key.
    The rollup is partial per micro-batch and summed when it is read."""
    from ..sources.adapters import CONVERSION_TYPES, IMPRESSION_TYPES
    scratch = _scratch(spark, "dual")
    dom = _dom(spark, sf, scratch).where(F.col("event_type").isin(*IMPRESSION_TYPES, *CONVERSION_TYPES))

    def imps(b):
        return b.where(F.col("event_type").isin(*IMPRESSION_TYPES))

    def convs(b):
        return b.where(F.col("event_type").isin(*CONVERSION_TYPES))

    sinks = {
        "impressions_by_minute": (f"{scratch}/impressions_by_minute", imps),
        "impression_tracking": (f"{scratch}/impression_tracking", lambda b: imps(b).groupBy(
            "publishers_id", "advertisers_id", "cookie_id", "ts").agg(F.count(F.lit(1)).cast("int").alias("impressions"))),
        "conversions_by_minute": (f"{scratch}/conversions_by_minute", convs),
        "conversion_tracking": (f"{scratch}/conversion_tracking",
                                lambda b: convs(b).select("advertisers_id", "ts", "cookie_id")),
    }
    P.run_foreach_batch(dom, ST.dual_write_sink(sinks), f"{scratch}/checkpoint")
    keys = ["publishers_id", "advertisers_id", "cookie_id", "ts"]
    out = None
    for name, (path, _) in sinks.items():
        if name == "impression_tracking":
            rows = ST.minutes_of_batches(spark, path, keys).withColumnRenamed("impressions", "rows")
        else:
            table = spark.read.parquet(path)
            if "publishers_id" not in table.columns:
                table = table.withColumn("publishers_id", F.lit(None).cast("string"))
            rows = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        one = rows.select(F.lit(name).alias("sink"), *keys[:3], F.col("ts").cast("timestamp_ntz").alias("timestamp"),
                          F.col("rows").cast("bigint").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@register("late_restated", with_ctes(ADAPTER_SQL, attributed_sql()) + """
SELECT 'rollup' AS part, publishers_id, advertisers_id, cookie_id, timestamp, CAST(NULL AS TIMESTAMP) AS impression_timestamp,
       CAST(impressions AS BIGINT) AS n FROM impression_tracking
UNION ALL SELECT 'attributed', publishers_id, advertisers_id, cookie_id, conversion_timestamp, impression_timestamp, 1 FROM attributed
UNION ALL SELECT 'late', publishers_id, advertisers_id, cookie_id, date_trunc('minute', ts), NULL, count(*) FROM ev
WHERE event_id % 20 = 0 AND event_type IN ('view', 'click', 'purchase', 'signup')
  AND date_trunc('day', ts) < (SELECT date_trunc('day', date_trunc('minute', max(ts)) - INTERVAL 5 SECOND) FROM ev WHERE event_id % 20 <> 0)
GROUP BY ALL""")
def q_late_restated(spark, sf):
    """A replay in which every twentieth event comes after all others: the tables after the
    restatement equal the batch results, and the side table holds the late rows."""
    scratch = _scratch(spark, "restated")
    events = spark.read.parquet(table_path(sf, "events"))
    tables = RS.Restated(spark, f"{scratch}/tables", seconds=DAY, as_of=AS_OF)
    for rows in (F.col("event_id") % 20 != 0, F.col("event_id") % 20 == 0):
        events.where(rows).write.mode("append").parquet(f"{scratch}/src")
        dom = P.domain_stream(spark.readStream.schema(events.schema).parquet(f"{scratch}/src"))
        P.run_foreach_batch(dom, tables.intake, f"{scratch}/checkpoint")
    tables.restate()
    tables.finish()
    none = F.lit(None).cast("timestamp_ntz")
    ids = ["publishers_id", "advertisers_id", "cookie_id"]
    rollup = tables.rollup().select(F.lit("rollup").alias("part"), *ids, "timestamp", none.alias("impression_timestamp"),
                                    F.col("impressions").cast("bigint").alias("n"))
    attributed = tables.attributed().select(F.lit("attributed").alias("part"), *ids, F.col("conversion_timestamp").alias("timestamp"),
                                            "impression_timestamp", F.lit(1).cast("bigint").alias("n"))
    late = tables.late().groupBy(*ids, "timestamp").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("late").alias("part"), *ids, "timestamp", none.alias("impression_timestamp"), "n")
    return rollup.unionByName(attributed).unionByName(late)


@register("stream_velocity_updates", with_ctes(ADAPTER_SQL) + """
, parts AS (
  SELECT cookie_id, to_timestamp(floor(epoch(ts) / 864000) * 864000) AT TIME ZONE 'UTC' AS timestamp, event_id % 4 AS part, count(*) AS n
  FROM ev WHERE event_type IN ('purchase', 'signup') GROUP BY ALL
), rising AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY cookie_id, timestamp ORDER BY part) AS BIGINT) AS so_far FROM parts
), judged AS (
  SELECT *, CASE WHEN so_far >= 20 THEN 'high' WHEN so_far >= 10 THEN 'medium' WHEN so_far >= 5 THEN 'low' ELSE 'clean' END AS risk_level
  FROM rising
), firsts AS (SELECT cookie_id, timestamp, risk_level, min(part) AS since FROM judged GROUP BY ALL)
SELECT cookie_id, timestamp, max(so_far) AS conversion_count, arg_max(risk_level, part) AS risk_level, count(*) AS updates,
       any_value(l.levels) AS levels
FROM judged JOIN (SELECT cookie_id, timestamp, string_agg(risk_level, '>' ORDER BY since) AS levels FROM firsts GROUP BY ALL) l
USING (cookie_id, timestamp) GROUP BY cookie_id, timestamp""")
def q_velocity_updates(spark, sf):
    """Counts of ten-day windows in update mode while a quarter of the events comes at a time."""
    scratch = _scratch(spark, "velocity-updates")
    events = spark.read.parquet(table_path(sf, "events"))
    for part in range(4):
        events.where(F.col("event_id") % 4 == part).write.mode("append").parquet(f"{scratch}/src")
        dom = P.domain_stream(spark.readStream.schema(events.schema).parquet(f"{scratch}/src"), "60 days")
        P.run_foreach_batch(VE.velocity_updates(dom, "10 days"), VE.updates_sink(f"{scratch}/updates"), f"{scratch}/checkpoint", "update")
    rows = VE.updates(spark, f"{scratch}/updates")
    return VE.current(rows).join(VE.levels(rows), list(VE.KEY))
