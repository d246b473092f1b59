"""Registered queries: cohorts, similar advertisers, payouts, matrix, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import DAY
from ..operators import cohorts as C
from ..operators import payout as PO
from ..operators import reports as R
from ..operators import similarity as SIM
from ..sources.tables import read_table
from ..sources import adapters
from . import domain
from .registry import ADAPTER_SQL, AS_OF, attributed_sql, back, register, with_ctes

A = f"TIMESTAMP '{AS_OF}'"
COHORT_SQL = """CASE WHEN regexp_extract({p}, '^PID_([A-Z]+)_[0-9]+$', 1) <> ''
              THEN regexp_extract({p}, '^PID_([A-Z]+)_[0-9]+$', 1)
            WHEN regexp_extract({p}, '([0-9]+)$', 1) <> ''
              THEN ['TECH', 'FASHION', 'HEALTH', 'FINANCE', 'TRAVEL'][
                     CAST(regexp_extract({p}, '([0-9]+)$', 1) AS BIGINT) % 5 + 1] END"""


def _suspects(spark, sf):
    return R.suspect_cookie_profile(domain.impressions(spark, sf, back(30 * 86400), AS_OF), AS_OF, days=30)


@register("fraud_cohorts", with_ctes(ADAPTER_SQL) + f"""
, susp AS (
  SELECT cookie_id FROM impression_tracking
  WHERE timestamp >= {A} - INTERVAL 30 DAY AND timestamp < {A}
  GROUP BY cookie_id HAVING count(DISTINCT publishers_id) > 10
),
pc AS (
  SELECT cookie_id, string_agg(DISTINCT cohort, ',' ORDER BY cohort) AS cohort_key,
         CAST(sum(impressions) AS BIGINT) AS impressions
  FROM (SELECT *, {COHORT_SQL.format(p='publishers_id')} AS cohort FROM impression_tracking
        WHERE cookie_id IN (SELECT cookie_id FROM susp))
  GROUP BY cookie_id
)
SELECT cohort_key, count(*) AS suspects, CAST(sum(impressions) AS BIGINT) AS impressions,
       list_sort(list(cookie_id ORDER BY cookie_id)[1:10]) AS sample_cookies
FROM pc GROUP BY cohort_key""")
def q_fraud_cohorts(spark, sf):
    return C.fraud_cohorts(domain.impressions(spark, sf), _suspects(spark, sf), cohort_of=adapters.mapped_cohort)


TOP_ADV_SQL = """
top_adv AS (
  SELECT advertisers_id FROM conversion_tracking GROUP BY advertisers_id
  ORDER BY count(*) DESC, advertisers_id LIMIT 1
)"""


@register("similar_advertisers", with_ctes(ADAPTER_SQL, TOP_ADV_SQL) + """
, pairs AS (SELECT DISTINCT advertisers_id, cookie_id FROM impression_tracking),
sizes AS (SELECT advertisers_id, count(*) AS cookies FROM pairs GROUP BY advertisers_id),
tc AS (SELECT p.advertisers_id AS target_id, p.cookie_id FROM pairs p JOIN top_adv t ON p.advertisers_id = t.advertisers_id),
shared AS (
  SELECT tc.target_id, p.advertisers_id, count(*) AS shared_cookies
  FROM pairs p JOIN tc ON p.cookie_id = tc.cookie_id WHERE p.advertisers_id <> tc.target_id GROUP BY 1, 2
)
SELECT s.target_id, s.advertisers_id, s.shared_cookies, a.cookies, t.cookies AS target_cookies,
       round(s.shared_cookies / (a.cookies + t.cookies - s.shared_cookies), 6) AS jaccard
FROM shared s JOIN sizes a ON s.advertisers_id = a.advertisers_id JOIN sizes t ON s.target_id = t.advertisers_id""")
def q_similar(spark, sf):
    conv = domain.conversions(spark, sf)
    top = (conv.groupBy("advertisers_id").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), "advertisers_id").limit(1).select("advertisers_id"))
    return C.similar_advertisers(domain.impressions(spark, sf), top)


@register("cohort_traffic", with_ctes(ADAPTER_SQL) + f"""
SELECT cohort, publishers_id, impressions,
       round(impressions / sum(impressions) OVER (PARTITION BY cohort), 6) AS cohort_share
FROM (SELECT {COHORT_SQL.format(p='publishers_id')} AS cohort, publishers_id,
             CAST(sum(impressions) AS BIGINT) AS impressions
      FROM impression_tracking GROUP BY 1, 2)""")
def q_cohort_traffic(spark, sf):
    return C.cohort_traffic(domain.impressions(spark, sf), adapters.mapped_cohort)


@register("payouts", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR")) + """
, rates AS (
  SELECT 'AID_' || lpad(CAST(o_orderkey % 5 AS VARCHAR), 3, '0') AS advertisers_id,
         round(avg(o_totalprice) * 0.01, 2) AS rate
  FROM orders GROUP BY 1
)
SELECT c.publishers_id, c.advertisers_id, c.conversions, coalesce(r.rate, 0.0) AS rate,
       round(c.conversions * coalesce(r.rate, 0.0), 2) AS payout
FROM (SELECT publishers_id, advertisers_id, count(*) AS conversions FROM attributed GROUP BY 1, 2) c
LEFT JOIN rates r ON c.advertisers_id = r.advertisers_id""")
def q_payouts(spark, sf):
    rates = C.order_value_rates(read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]))
    return C.payouts(domain.attributed(spark, sf, lookback_seconds=DAY), rates)


@register("publisher_advertiser_matrix", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR")) + """
SELECT publishers_id, advertisers_id, conversions,
       round(conversions / sum(conversions) OVER (PARTITION BY publishers_id), 6) AS publisher_share
FROM (SELECT publishers_id, advertisers_id, count(*) AS conversions FROM attributed GROUP BY 1, 2)""")
def q_matrix(spark, sf):
    return C.publisher_advertiser_matrix(domain.attributed(spark, sf, lookback_seconds=DAY))


@register("rate_anomalies", with_ctes(ADAPTER_SQL) + """
, j AS (
  SELECT coalesce(i.advertisers_id, c.advertisers_id) AS advertisers_id, coalesce(i.period, c.period) AS period,
         coalesce(i.impressions, 0) AS impressions, coalesce(c.conversions, 0) AS conversions
  FROM (SELECT advertisers_id, date_trunc('hour', timestamp) AS period, CAST(sum(impressions) AS BIGINT) AS impressions
        FROM impression_tracking GROUP BY 1, 2) i
  FULL OUTER JOIN (SELECT advertisers_id, date_trunc('hour', timestamp) AS period, count(*) AS conversions
                   FROM conversion_tracking GROUP BY 1, 2) c
    ON i.advertisers_id = c.advertisers_id AND i.period = c.period
),
r AS (
  SELECT *, CASE WHEN impressions > 0 THEN conversions * 100.0 / impressions ELSE 0.0 END AS rate,
         CAST(epoch(period) AS BIGINT) AS t FROM j
),
w AS (
  SELECT *, avg(rate) OVER win AS m, stddev_samp(rate) OVER win AS sd FROM r
  WINDOW win AS (PARTITION BY advertisers_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)
)
SELECT advertisers_id, period, impressions, conversions, round(rate, 6) AS rate,
       round(m, 6) AS trailing_mean, round(sd, 6) AS trailing_stddev,
       round(CASE WHEN sd > 0 THEN (rate - m) / sd END, 6) AS z_score,
       coalesce(abs(CASE WHEN sd > 0 THEN (rate - m) / sd END) > 3.0, false) AS anomaly
FROM w""")
def q_rate_anomalies(spark, sf):
    return C.rate_anomalies(domain.impressions(spark, sf), domain.conversions(spark, sf))


# --- similar entities, all pairs -------------------------------------------------------------

def similar_sql(source: str, entity: str, member: str, top: int, least: float) -> str:
    """Exact Jaccard of all pairs of entities."""
    return f"""
, m AS (SELECT DISTINCT {entity} AS e, {member} AS x FROM {source}),
size AS (SELECT e, count(*) AS n FROM m GROUP BY e),
both_seen AS (SELECT a.e AS t, b.e AS e, count(*) AS shared FROM m a JOIN m b ON a.x = b.x AND a.e <> b.e GROUP BY ALL),
j AS (SELECT t, both_seen.e, shared, s.n, st.n AS tn, shared / (s.n + st.n - shared) AS j
      FROM both_seen JOIN size s ON s.e = both_seen.e JOIN size st ON st.e = t)
SELECT t AS target_id, row_number() OVER w AS rank, e AS entity_id, shared AS shared_members, n AS members, tn AS target_members,
       round(j, 6) AS jaccard
FROM j WHERE j >= {least} WINDOW w AS (PARTITION BY t ORDER BY j DESC, e) QUALIFY row_number() OVER w <= {top}"""


@register("similar_advertisers_all", with_ctes(ADAPTER_SQL) + similar_sql("raw_impressions", "advertisers_id", "cookie_id", 10, 0.3))
def q_similar_advertisers_all(spark, sf):
    return SIM.similar_entities(domain.impressions(spark, sf), "advertisers_id", "cookie_id")


@register("similar_publishers_all", with_ctes(ADAPTER_SQL) + similar_sql("raw_impressions", "publishers_id", "cookie_id", 10, 0.3))
def q_similar_publishers_all(spark, sf):
    return SIM.similar_entities(domain.impressions(spark, sf), "publishers_id", "cookie_id")


@register("similar_publishers_volume", """WITH shipped AS (
  SELECT 'PID_' || l_suppkey AS publishers_id, 'CID_' || o_custkey AS cookie_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)""" + similar_sql("shipped", "publishers_id", "cookie_id", 5, 0.15))
def q_similar_publishers_volume(spark, sf):
    """Suppliers by their customers, in single-bin bands: the sets overlap by a fifth only."""
    return SIM.similar_entities(adapters.volume_impressions(spark, sf), "publishers_id", "cookie_id", top=5, least=0.15, rows=1)


# --- cohorts of cookies that share unusual publishers -----------------------------------------

LINKED_SQL = f"""
, susp AS (
  SELECT cookie_id FROM impression_tracking
  WHERE timestamp >= {A} - INTERVAL 30 DAY AND timestamp < {A}
  GROUP BY cookie_id HAVING count(DISTINCT publishers_id) > 10
), cp AS (
  SELECT cookie_id, publishers_id, CAST(sum(impressions) AS BIGINT) AS n FROM impression_tracking
  WHERE cookie_id IN (SELECT cookie_id FROM susp) GROUP BY ALL
), c AS (SELECT cookie_id, CAST(sum(n) AS BIGINT) AS n FROM cp GROUP BY ALL
), p AS (SELECT publishers_id, CAST(sum(n) AS BIGINT) AS n FROM cp GROUP BY ALL
), link AS (
  SELECT cp.cookie_id, cp.publishers_id, cp.n FROM cp JOIN c USING (cookie_id) JOIN p USING (publishers_id)
  WHERE cp.n::HUGEINT * (SELECT sum(n) FROM cp) >= 3::HUGEINT * c.n * p.n
), reach AS (
  WITH RECURSIVE r(node, root) AS (
    SELECT cookie_id, cookie_id FROM susp
    UNION
    SELECT b.cookie_id, r.root FROM r JOIN link a ON a.cookie_id = r.node JOIN link b ON a.publishers_id = b.publishers_id
  ) SELECT node AS cookie_id, min(root) AS cohort_id FROM r GROUP BY node
), linked AS (SELECT cookie_id, count(*) AS publishers, CAST(sum(n) AS BIGINT) AS n FROM link GROUP BY ALL
), members AS (
  SELECT cohort_id, c.cookie_id, coalesce(publishers, 0) AS linked_publishers, c.n AS impressions,
         coalesce(linked.n, 0) AS linked_impressions
  FROM c JOIN reach USING (cookie_id) LEFT JOIN linked USING (cookie_id)
)"""


def _members(spark, sf):
    return C.linked_cohort_members(domain.impressions(spark, sf), _suspects(spark, sf))


@register("fraud_cohort_members", with_ctes(ADAPTER_SQL) + LINKED_SQL + """
SELECT cohort_id, cookie_id, linked_publishers, impressions, linked_impressions,
       round(linked_impressions / impressions, 6) AS linked_share,
       round(impressions / sum(impressions) OVER (PARTITION BY cohort_id), 6) AS cohort_share
FROM members""")
def q_cohort_members(spark, sf):
    return _members(spark, sf)


@register("fraud_cohorts_linked", with_ctes(ADAPTER_SQL) + LINKED_SQL + """
SELECT m.cohort_id, count(*) AS cookies, max(pubs.n) AS publishers, CAST(sum(impressions) AS BIGINT) AS impressions,
       CAST(sum(linked_impressions) AS BIGINT) AS linked_impressions,
       round(sum(linked_impressions) / sum(impressions), 6) AS linked_share
FROM members m
JOIN (SELECT cohort_id, count(DISTINCT publishers_id) AS n FROM reach LEFT JOIN link USING (cookie_id) GROUP BY ALL) pubs USING (cohort_id)
GROUP BY m.cohort_id""")
def q_cohorts_linked(spark, sf):
    return C.linked_cohorts(domain.impressions(spark, sf), _suspects(spark, sf))


@register("payouts_dated", with_ctes(ADAPTER_SQL, attributed_sql("INTERVAL 24 HOUR")) + """
, rates AS (
  SELECT 'AID_' || lpad(CAST(a AS VARCHAR), 3, '0') AS advertisers_id, TIMESTAMP '2024-01-01' + third * INTERVAL 10 DAY AS valid_from,
         cents // (n * 100) AS payout_cents, cents // n AS value_cents
  FROM (SELECT o_orderkey % 5 AS a, least((day(o_orderdate) - 1) // 10, 2) AS third, count(*) AS n,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL)
  WHERE a <> 4 OR third > 0
), rated AS (
  SELECT a.publishers_id, a.advertisers_id, r.payout_cents, r.value_cents
  FROM attributed a ASOF LEFT JOIN rates r ON a.advertisers_id = r.advertisers_id AND a.conversion_timestamp >= r.valid_from
), sums AS (
  SELECT publishers_id, advertisers_id, count(*) AS conversions, count(*) FILTER (WHERE payout_cents IS NULL) AS unrated_conversions,
         CAST(coalesce(sum(payout_cents), 0) AS BIGINT) AS paid, CAST(coalesce(sum(value_cents), 0) AS BIGINT) AS brought
  FROM rated GROUP BY publishers_id, advertisers_id
)
SELECT publishers_id, advertisers_id, conversions, unrated_conversions, paid / 100 AS payout, brought / 100 AS value,
       CASE WHEN paid > 0 THEN round((brought - paid) / paid, 6) END AS roi FROM sums""")
def q_payouts_dated(spark, sf):
    rates = PO.dated_order_rates(read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"]), "2024-01-01 00:00:00")
    return PO.payout_report(domain.attributed(spark, sf, lookback_seconds=DAY), rates)
