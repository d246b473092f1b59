"""Map the supplied tables onto the attribution domain.

``events`` becomes the raw impression / conversion streams (one row per event),
and ``lineitem`` joined with ``orders`` gives a second, larger mapping at day
grain for volume runs.  The rules are fixed values so the DuckDB oracle can
express the same mapping.

Fixed values (mapping of ``events``):
  k               = integer value of props.k
  publishers_id   = 'PID_' + lpad(k % 20, 3, '0')
  advertisers_id  = 'AID_' + lpad(k % 5, 3, '0')
  cookie_id       = 'CID_' + user_id
  impressions     = event_type in ('view', 'click')
  conversions     = event_type in ('purchase', 'signup')   ('error' is ignored)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import COHORTS, publisher_cohort, salt_bucket
from ..functions.timecols import DAY, minute_of, time_slice, trunc_to
from .tables import read_table

IMPRESSION_TYPES = ("view", "click")
CONVERSION_TYPES = ("purchase", "signup")
PUBLISHER_MOD = 20
ADVERTISER_MOD = 5
SALT_BUCKETS = 10


def _padded(prefix: str, value) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(value.cast("string"), 3, "0"))


def keyed_events(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """events with the domain keys attached (only the columns the domain uses).

    ``[start, end)`` is put on the raw ``ts``: a bound on the minute, which is computed
    from date parts, would not reach the Parquet scan.  For bounds on whole minutes
    the two say the same."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"],
                    where=time_slice("ts", start, end))
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id", "ts", "event_type",
        _padded("PID_", k % PUBLISHER_MOD).alias("publishers_id"),
        _padded("AID_", k % ADVERTISER_MOD).alias("advertisers_id"),
        F.concat(F.lit("CID_"), F.col("user_id").cast("string")).alias("cookie_id"),
        k.alias("k"),
    )


def _raw(spark, sf_dir, types, id_name, bucket_key, start, end) -> DataFrame:
    ev = keyed_events(spark, sf_dir, start, end).where(F.col("event_type").isin(*types))
    return ev.select(
        minute_of("ts").alias("bucket_date"),
        salt_bucket(F.col(bucket_key), SALT_BUCKETS).alias("bucket"),
        F.col("ts"),
        "publishers_id", "advertisers_id", "cookie_id",
        F.col("event_id").cast("string").alias(id_name),
    )


def prefixed_facts(impressions: DataFrame) -> DataFrame:
    """The rollup with ids that carry their class, as the traffic generator writes them: a cookie's
    number chooses its prefix (fraud, a cohort, random or none), a publisher's its cohort or none."""
    def renamed(col, prefixes):
        head, number = F.substring(col, 1, 4), F.regexp_extract(col, r"([0-9]+)$", 1)
        tag = F.element_at(F.array(*[F.lit(p) for p in prefixes]), (F.pmod(number.cast("bigint"), F.lit(len(prefixes))) + 1).cast("int"))
        return F.concat(head, tag, number).alias(col)
    return impressions.select(
        renamed("publishers_id", [*(f"{c}_" for c in COHORTS), ""]), "advertisers_id",
        renamed("cookie_id", ["FRAUD_", *(f"{c}_" for c in COHORTS), "RANDOM_", ""]), "timestamp", "impressions")


def mapped_cohort(publisher) -> F.Column:
    """Cohort of a publisher of this mapping, whose ids carry none: the number in the id
    chooses one.  Embedded cohorts win."""
    p = F.col(publisher) if isinstance(publisher, str) else publisher
    number = F.regexp_extract(p, r"([0-9]+)$", 1)
    chosen = F.element_at(F.array(*[F.lit(c) for c in COHORTS]), (F.pmod(number.cast("bigint"), F.lit(len(COHORTS))) + 1).cast("int"))
    return F.coalesce(publisher_cohort(p, None), F.when(number != "", chosen))


def raw_impressions(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """impressions_by_minute: one row per impression; salt bucket from the publisher."""
    return _raw(spark, sf_dir, IMPRESSION_TYPES, "impression_id", "publishers_id", start, end)


def raw_conversions(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """conversions_by_minute: one row per conversion; salt bucket from the advertiser."""
    return _raw(spark, sf_dir, CONVERSION_TYPES, "conversion_id", "advertisers_id", start, end)


def impression_tracking(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Lake impression table: minute rollup of the raw impressions."""
    from ..operators.rollup import impression_rollup
    return impression_rollup(raw_impressions(spark, sf_dir, start, end))


def conversion_tracking(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Lake conversion table: raw conversions mapped 1:1 (advertiser, minute, cookie)."""
    from ..operators.rollup import conversion_facts
    return conversion_facts(raw_conversions(spark, sf_dir, start, end))


# --- volume mapping (day grain) -------------------------------------------------------------
# publisher = 'PID_' + l_suppkey, advertiser = 'AID_' + lpad(orderkey % 5, 3, '0'),
# cookie = 'CID_' + o_custkey, impression time = l_shipdate, conversion time = o_orderdate.

def volume_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem JOIN orders as day-grain impression rollup.

    The join is on the order key, which both tables are large on: Catalyst
    plans a shuffle (sort-merge) join, or a broadcast when AQE measures a
    small side at runtime.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_shipdate"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    facts = j.select(
        F.concat(F.lit("PID_"), F.col("l_suppkey").cast("string")).alias("publishers_id"),
        _padded("AID_", F.col("l_orderkey") % ADVERTISER_MOD).alias("advertisers_id"),
        F.concat(F.lit("CID_"), F.col("o_custkey").cast("string")).alias("cookie_id"),
        trunc_to(F.col("l_shipdate").cast("timestamp_ntz"), DAY).alias("timestamp"),
    )
    return (facts.groupBy("publishers_id", "advertisers_id", "cookie_id", "timestamp")
            .agg(F.count(F.lit(1)).cast("int").alias("impressions")))


def volume_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return od.select(
        _padded("AID_", F.col("o_orderkey") % ADVERTISER_MOD).alias("advertisers_id"),
        trunc_to(F.col("o_orderdate").cast("timestamp_ntz"), DAY).alias("timestamp"),
        F.concat(F.lit("CID_"), F.col("o_custkey").cast("string")).alias("cookie_id"),
    )


# --- query log derived from events ----------------------------------------------------------
# Each event stands for one statement of a made-up shop (fixed templates below) that together
# reach every rewrite of the fingerprint: quoted and numeric values, lists, ranges, bounds that
# stay and placeholders.  The log grows with the events table, so pattern analytics run at
# table scale.

def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("int")
    pub = _padded("PID_", k % PUBLISHER_MOD)
    adv = _padded("AID_", k % ADVERTISER_MOD)
    cookie = F.concat(F.lit("CID_"), F.col("user_id").cast("string"))
    minute_txt = F.date_format(minute_of("ts"), "yyyy-MM-dd HH:mm:ss")
    et = F.col("event_type")
    text = (F.when((et == "view") & (k % 2 == 0),
                   F.format_string("DELETE FROM shelf_tally WHERE shelf = '%s' AND days_old = 7.5", pub))
            .when(et == "view", F.format_string("EXPLAIN SELECT price FROM tags WHERE tag_no IN (%d, 77) OR colour = 'red'", k))
            .when(et == "click", F.format_string(
                "UPDATE guests SET last_press = TIMESTAMP '%s', presses = presses + 1 WHERE guest = \"%s\"", minute_txt, cookie))
            .when(et == "purchase", F.format_string(
                "INSERT INTO receipts TABLE till WHERE till_no BETWEEN %d AND %d OR closed >= '%s'", k, k + 9, minute_txt))
            .when(et == "signup", F.lit("MERGE INTO members m USING joined j ON m.card = ? WHEN NOT MATCHED THEN INSERT VALUES (?, ?)"))
            .otherwise(F.format_string("ALTER TABLE receipts DROP PARTITION (branch = '%s', lot IN ('%s', 'spare'))", pub, cookie)))
    hcd = et.isin("view", "signup")
    ms = F.col("value") * F.lit(40.0)
    return ev.select(
        F.concat(F.when(hcd, F.lit("cql_")).otherwise(F.lit("presto_")), F.col("event_id").cast("string"))
        .alias("query_id"),
        text.alias("query_text"),
        F.concat(F.lit("pipeline "), et, F.lit(" statement")).alias("query_description"),
        F.when(hcd, F.lit("HCD")).otherwise(F.lit("Presto")).alias("query_type"),
        F.when(et == "signup", F.array(F.concat(F.lit("[["), F.col("user_id").cast("string"), F.lit(", 1]]")),
                                       minute_txt, adv)).alias("parameters"),
        F.col("ts").alias("start_time"),
        F.timestamp_add("MICROSECOND", F.floor(ms * 1000).cast("bigint"), F.col("ts")).alias("end_time"),
        ms.alias("execution_time_ms"),
        F.when(et == "error", F.lit(None).cast("bigint")).otherwise(k.cast("bigint")).alias("rows_returned"),
        (et != "error").alias("success"),
        F.when(et == "error", F.lit("Query exceeded maximum time limit")).alias("error_message"),
        (et == "signup").alias("prepared"),
        F.when(et == "error", F.lit(3)).otherwise(F.lit(0)).alias("retry_count"),
    )
