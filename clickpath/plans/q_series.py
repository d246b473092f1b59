"""Registered queries: capped entity series, merge, charts, totals, top lists."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from ..functions.timecols import epoch_seconds, time_slice
from ..operators import rollup
from ..operators import series as S
from ..operators.rollup import ENTITY_ID
from ..session import shared_path
from ..sources import lake
from ..sources.pointread import look_up_options, point_read, sorted_by, write_sorted
from . import domain
from .registry import ADAPTER_SQL, AS_OF, attributed_sql, register, with_ctes

MERGE_CUT = "2024-01-30 00:00:00"     # existing table holds minutes before this
MERGE_FROM = "2024-01-29 00:00:00"    # the update batch re-sends one overlapping day


def publisher_points(spark, sf):
    imp = rollup.entity_metric(domain.impressions(spark, sf), "publishers", "impressions")
    conv = rollup.publisher_conversions_trailing(domain.attributed(spark, sf))
    return imp, conv


def advertiser_points(spark, sf):
    imp = rollup.entity_metric(domain.impressions(spark, sf), "advertisers", "impressions")
    conv = rollup.entity_metric(domain.conversions(spark, sf), "advertisers", "conversions")
    return imp, conv


def publishers_table(spark, sf):
    imp, conv = publisher_points(spark, sf)
    return S.entity_table(imp, conv, "publishers_id", as_of=AS_OF)


def advertisers_table(spark, sf):
    imp, conv = advertiser_points(spark, sf)
    return S.entity_table(imp, conv, "advertisers_id", as_of=AS_OF)


def published(spark, sf, entity: str):
    """The served table of an entity, read from its newest published version.

    A dashboard reads what the publishing job wrote; here the first reader of a session
    and data folder publishes it, sorted by id and with a Bloom filter on it."""
    id_col = ENTITY_ID[entity]
    name = hashlib.md5(f"{spark.sparkContext.applicationId}:{os.path.abspath(sf)}:{entity}".encode()).hexdigest()[:16]
    base = shared_path(spark, "published", f"{entity}-{name}")
    if lake.latest_version(spark, base) is None:
        build = {"publishers": publishers_table, "advertisers": advertisers_table}[entity]
        lake.write_version(spark, sorted_by(build(spark, sf), id_col), base, options=look_up_options([id_col]))
    return lake.read_table_version(spark, base)


# ---- oracle building blocks ---------------------------------------------------------------
def _top90(name: str, source: str) -> str:
    """CTE ``name``(id, ts, cnt) = newest 90 points per id of ``source``(id, ts, cnt)."""
    return f"""
{name} AS (
  SELECT id, ts, cnt FROM (
    SELECT id, ts, cnt, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS rn FROM {source})
  WHERE rn <= 90
)"""


def _json(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT id, '[' || string_agg('[' || ts || ', ' || cnt || ']', ', ' ORDER BY ts) || ']' AS js
  FROM {source} GROUP BY id
)"""


PUB_POINTS_SQL = """
pub_imp_pts AS (
  SELECT publishers_id AS id, CAST(epoch(timestamp) AS BIGINT) AS ts, CAST(sum(impressions) AS BIGINT) AS cnt
  FROM impression_tracking WHERE publishers_id IS NOT NULL GROUP BY 1, 2
),
pub_conv_pts AS (
  SELECT a.publishers_id AS id,
         CAST(epoch(date_trunc('minute', a.impression_timestamp)) AS BIGINT) + 60 * g AS ts,
         count(*) AS cnt
  FROM attributed a, generate_series(0, 90) AS gs(g)
  WHERE a.publishers_id IS NOT NULL GROUP BY 1, 2
)"""

ADV_POINTS_SQL = """
adv_imp_pts AS (
  SELECT advertisers_id AS id, CAST(epoch(timestamp) AS BIGINT) AS ts, CAST(sum(impressions) AS BIGINT) AS cnt
  FROM impression_tracking WHERE advertisers_id IS NOT NULL GROUP BY 1, 2
),
adv_conv_pts AS (
  SELECT advertisers_id AS id, CAST(epoch(timestamp) AS BIGINT) AS ts, count(*) AS cnt
  FROM conversion_tracking WHERE advertisers_id IS NOT NULL GROUP BY 1, 2
)"""

PUB_CTES = (ADAPTER_SQL, attributed_sql(), PUB_POINTS_SQL, _top90("pub_imp_top", "pub_imp_pts"),
            _top90("pub_conv_top", "pub_conv_pts"), _json("pub_imp_js", "pub_imp_top"),
            _json("pub_conv_js", "pub_conv_top"))
ADV_CTES = (ADAPTER_SQL, ADV_POINTS_SQL, _top90("adv_imp_top", "adv_imp_pts"),
            _top90("adv_conv_top", "adv_conv_pts"), _json("adv_imp_js", "adv_imp_top"),
            _json("adv_conv_js", "adv_conv_top"))


def _table_sql(prefix: str, id_col: str) -> str:
    return f"""
SELECT coalesce(i.id, c.id) AS {id_col}, coalesce(i.js, '[]') AS impressions,
       coalesce(c.js, '[]') AS conversions, TIMESTAMP '{AS_OF}' AS last_updated
FROM {prefix}_imp_js i FULL OUTER JOIN {prefix}_conv_js c ON i.id = c.id"""


def _totals_sql(prefix: str, id_col: str) -> str:
    return f"""
SELECT coalesce(i.id, c.id) AS {id_col},
       CAST(coalesce(i.t, 0) AS BIGINT) AS total_impressions,
       CAST(coalesce(c.t, 0) AS BIGINT) AS total_conversions,
       CASE WHEN coalesce(i.t, 0) > 0 THEN round(CAST(coalesce(c.t, 0) AS DOUBLE) / i.t * 100.0, 2)
            ELSE 0.0 END AS conversion_rate
FROM (SELECT id, sum(cnt) AS t FROM {prefix}_imp_top GROUP BY id) i
FULL OUTER JOIN (SELECT id, sum(cnt) AS t FROM {prefix}_conv_top GROUP BY id) c ON i.id = c.id"""


@register("publisher_series", with_ctes(*PUB_CTES) + _table_sql("pub", "publishers_id"))
def q_publisher_series(spark, sf):
    return publishers_table(spark, sf)


@register("advertiser_series", with_ctes(*ADV_CTES) + _table_sql("adv", "advertisers_id"))
def q_advertiser_series(spark, sf):
    return advertisers_table(spark, sf)


@register("entity_totals", with_ctes(*PUB_CTES) + _totals_sql("pub", "publishers_id"))
def q_entity_totals(spark, sf):
    return S.entity_totals(published(spark, sf, "publishers"), "publishers_id")


@register("advertiser_totals", with_ctes(*ADV_CTES) + _totals_sql("adv", "advertisers_id"))
def q_advertiser_totals(spark, sf):
    return S.entity_totals(published(spark, sf, "advertisers"), "advertisers_id")


@register("entity_chart", with_ctes(*PUB_CTES) + """
SELECT coalesce(i.id, c.id) AS publishers_id, coalesce(i.ts, c.ts) AS ts,
       strftime(make_timestamp(coalesce(i.ts, c.ts) * 1000000), '%H:%M') AS label,
       CAST(coalesce(i.cnt, 0) AS BIGINT) AS impressions, CAST(coalesce(c.cnt, 0) AS BIGINT) AS conversions
FROM pub_imp_top i FULL OUTER JOIN pub_conv_top c ON i.id = c.id AND i.ts = c.ts""")
def q_entity_chart(spark, sf):
    return S.entity_chart(published(spark, sf, "publishers"), "publishers_id")


@register("top_advertisers", with_ctes(*ADV_CTES) + """
SELECT advertisers_id, advertisers_id AS name, total_conversions, total_impressions FROM (
""" + _totals_sql("adv", "advertisers_id") + """
) ORDER BY total_conversions DESC, total_impressions DESC, advertisers_id LIMIT 10""")
def q_top_advertisers(spark, sf):
    return S.top_entities(published(spark, sf, "advertisers"), "advertisers_id", 10)


@register("top_publishers_by_totals", with_ctes(*PUB_CTES) + """
SELECT publishers_id, publishers_id AS name, total_conversions, total_impressions FROM (
""" + _totals_sql("pub", "publishers_id") + """
) ORDER BY total_conversions DESC, total_impressions DESC, publishers_id LIMIT 10""")
def q_top_publishers_by_totals(spark, sf):
    return S.top_entities(published(spark, sf, "publishers"), "publishers_id", 10)


@register("publisher_sample", with_ctes(*PUB_CTES) + """
SELECT publishers_id, publishers_id AS name, total_impressions, total_conversions FROM (""" + _totals_sql("pub", "publishers_id") + """)
ORDER BY md5(publishers_id || ':7'), publishers_id LIMIT 10""")
def q_publisher_sample(spark, sf):
    """A pick by hash of id and seed over all publishers."""
    return S.entity_sample(published(spark, sf, "publishers"), "publishers_id", limit=10, seed=7)


@register("entity_list", with_ctes(*PUB_CTES) + """
SELECT publishers_id, publishers_id AS name FROM (""" + _table_sql("pub", "publishers_id") + ")")
def q_entity_list(spark, sf):
    return S.entity_list(published(spark, sf, "publishers"), "publishers_id")


@register("entity_lookup", with_ctes(*ADV_CTES) + """
SELECT * FROM (""" + _table_sql("adv", "advertisers_id") + ") WHERE advertisers_id = 'AID_003'")
def q_entity_lookup(spark, sf):
    return S.entity_lookup(published(spark, sf, "advertisers"), "advertisers_id", "AID_003")


@register("cookie_path", with_ctes(ADAPTER_SQL) + """
, chosen AS (SELECT cookie_id FROM conversion_tracking GROUP BY cookie_id ORDER BY count(*) DESC, cookie_id LIMIT 1)
SELECT 'impression' AS kind, publishers_id, advertisers_id, cookie_id, timestamp, CAST(impressions AS BIGINT) AS n
FROM impression_tracking WHERE cookie_id IN (FROM chosen)
UNION ALL SELECT 'conversion', NULL, advertisers_id, cookie_id, timestamp, count(*) FROM conversion_tracking
WHERE cookie_id IN (FROM chosen) GROUP BY ALL""")
def q_cookie_path(spark, sf):
    """All facts of one cookie (the one with most conversions), by a point read of the fact table
    that is sorted by cookie and time."""
    none = F.lit(None).cast("string")
    imp = domain.impressions(spark, sf).select(F.lit("impression").alias("kind"), "publishers_id", "advertisers_id", "cookie_id", "timestamp",
                                               F.col("impressions").cast("bigint").alias("n"))
    conv = domain.conversions(spark, sf)
    done = conv.groupBy("advertisers_id", "cookie_id", "timestamp").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("conversion").alias("kind"), none.alias("publishers_id"), "advertisers_id", "cookie_id", "timestamp", "n")
    path = shared_path(spark, "lake", f"paths-{uuid.uuid4().hex[:12]}")
    write_sorted(imp.unionByName(done), path, ["cookie_id", "timestamp"], bloom=["cookie_id"])
    busiest = conv.groupBy("cookie_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "cookie_id").first()
    return point_read(spark, path, cookie_id=busiest.cookie_id if busiest else None)


def _resent(name: str) -> str:
    return f"""
{name}_new AS (
  SELECT id, ts, CASE WHEN ts >= epoch(TIMESTAMP '{MERGE_FROM}') THEN cnt + 100 ELSE cnt END AS cnt FROM {name}_pts
)"""


MERGED_CTES = (ADAPTER_SQL, ADV_POINTS_SQL, _resent("adv_imp"), _resent("adv_conv"), _top90("adv_imp_top", "adv_imp_new"),
               _top90("adv_conv_top", "adv_conv_new"), _json("adv_imp_js", "adv_imp_top"), _json("adv_conv_js", "adv_conv_top"))


@register("entity_series_merge", with_ctes(*MERGED_CTES) + _table_sql("adv", "advertisers_id"))
def q_entity_series_merge(spark, sf):
    """Existing table built from minutes before MERGE_CUT, merged with an update batch
    that re-sends one overlapping day with other counts, and everything after."""
    imp, conv = advertiser_points(spark, sf)
    old = S.entity_table(imp.where(time_slice("timestamp", None, MERGE_CUT)),
                         conv.where(time_slice("timestamp", None, MERGE_CUT)),
                         "advertisers_id", as_of=AS_OF)

    def resent(points, count):
        return points.where(time_slice("timestamp", MERGE_FROM, None)).select(
            "advertisers_id", epoch_seconds("timestamp").alias("ts"), (F.col(count) + 100).alias("count"))
    step1 = S.entity_series_merge(old, resent(imp, "total_impressions"), "advertisers_id", "impressions", as_of=AS_OF)
    return S.entity_series_merge(step1, resent(conv, "total_conversions"), "advertisers_id", "conversions", as_of=AS_OF) \
        .select("advertisers_id", "impressions", "conversions", "last_updated")
