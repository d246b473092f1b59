"""Two-stage fraud scoring.

Stage 1 counts conversions per cookie in a short window and keeps the top
``limit`` (default 100).  Stage 2 joins that bounded cookie set with attributed
conversions of a long window to count distinct publishers per cookie.

Scale notes: the only full-size work is one aggregate over the conversions and
one scan of the attributed table.  Joins carry no broadcast hints: with ``limit``
the planner sees the small side by itself, and ``limit=None`` stays safe.
Distinct publishers per cookie are found with a (cookie, publisher) group-by
(map-side combine, so a hot cookie ships one row per publisher per task); count and
sample come from one row number over them.  ``fraud_two_stage`` runs both stages
with one read of every input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import RISK_LEVELS, risk_level, risk_level_server, risk_patterns, risk_score
from ..functions.timecols import add_seconds, minute_of, ntz

TOP_COOKIES = 100        # fixed value: cookies per stage
SAMPLE_PUBLISHERS = 10   # fixed value: sample publishers per cookie
MIN_CONVERSIONS = 5      # fixed value: stage-2 HAVING threshold


def _window(col: str, as_of, seconds: int):
    end = minute_of(ntz(as_of))
    return (F.col(col) >= add_seconds(end, -int(seconds))) & (F.col(col) < end)


def _top(counts: DataFrame, by: str, limit: int | None) -> DataFrame:
    """The ``limit`` cookies of highest count, ties by id; None keeps all."""
    return counts if limit is None else counts.orderBy(F.col(by).desc(), F.col("cookie_id")).limit(limit)


def _cookie_filter(df: DataFrame, cookies) -> DataFrame:
    """Restrict to the given cookies; an empty or missing list means no filter."""
    if cookies is None:
        return df
    if isinstance(cookies, DataFrame):
        # no forced broadcast: the planner broadcasts a small (e.g. limit(100)) list by
        # its size estimate, and shuffles a large one.  Whether the list is empty is one
        # row of the same plan, not a job of its own.
        listed = cookies.select("cookie_id").distinct()
        none = listed.agg((F.count(F.lit(1)) == 0).alias("__all"))
        hit = df.join(listed.withColumn("__listed", F.lit(True)), "cookie_id", "left")
        return hit.crossJoin(F.broadcast(none)).where(F.col("__listed") | F.col("__all")).select(*df.columns)
    cookies = list(cookies)
    return df.where(F.col("cookie_id").isin(cookies)) if cookies else df


def fraud_stage1(raw_conversions: DataFrame, as_of, window_seconds: int = 60,
                 limit: int | None = TOP_COOKIES) -> DataFrame:
    """cookie_id, conversion_count: conversions per cookie in the minute(s) before
    ``as_of`` (``[trunc(as_of) - window, trunc(as_of))``), top ``limit`` (None: all)."""
    recent = raw_conversions.where(_window("bucket_date", as_of, window_seconds))
    counts = recent.groupBy("cookie_id").agg(F.count(F.lit(1)).alias("conversion_count"))
    return _top(counts, "conversion_count", limit)


def fraud_stage2(raw_conversions: DataFrame, attributed: DataFrame, as_of, cookies=None,
                 min_conversions: int = MIN_CONVERSIONS, short_window: int = 60,
                 long_window: int = 90 * 60, limit: int | None = TOP_COOKIES,
                 sample_size: int = SAMPLE_PUBLISHERS) -> DataFrame:
    """cookie_id, total_conversions_last_minute, unique_publishers_last_90m,
    sample_publishers_90m (first 10 distinct publishers, sorted; [] if none)."""
    recent = _cookie_filter(raw_conversions.where(_window("bucket_date", as_of, short_window)), cookies)
    top = _top(recent.groupBy("cookie_id").agg(F.count(F.lit(1)).alias("total_conversions_last_minute"))
               .where(F.col("total_conversions_last_minute") >= min_conversions), "total_conversions_last_minute", limit)
    ident = attributed.where(_window("conversion_timestamp", as_of, long_window)).join(
        top.select("cookie_id"), "cookie_id", "left_semi")
    out = top.join(_sources(ident, sample_size), "cookie_id", "left")
    return out.select("cookie_id", "total_conversions_last_minute", *_source_columns())


def _sources(attributed: DataFrame, sample_size: int) -> DataFrame:
    """cookie_id, number of distinct publishers, the first ``sample_size`` of them sorted.

    One aggregate per (cookie, publisher); the row number in publisher order gives
    the count (its maximum) and the sample (its first values) in one pass."""
    pairs = attributed.where(F.col("publishers_id").isNotNull()).select("cookie_id", "publishers_id").distinct()
    rn = F.row_number().over(Window.partitionBy("cookie_id").orderBy("publishers_id"))
    return pairs.withColumn("__rn", rn).groupBy("cookie_id").agg(
        F.max("__rn").alias("__n"),
        F.array_sort(F.collect_list(F.when(F.col("__rn") <= sample_size, F.col("publishers_id")))).alias("__sample"))


def _source_columns() -> list:
    return [F.coalesce("__n", F.lit(0)).cast("bigint").alias("unique_publishers_last_90m"),
            F.coalesce("__sample", F.array().cast("array<string>")).alias("sample_publishers_90m")]


def fraud_two_stage(raw_conversions: DataFrame, attributed: DataFrame, as_of, min_conversions: int = MIN_CONVERSIONS,
                    short_window: int = 60, long_window: int = 90 * 60, limit: int | None = TOP_COOKIES,
                    sample_size: int = SAMPLE_PUBLISHERS) -> DataFrame:
    """Both stages of one run, each input read once: the stage-1 cookies with
    conversion_count, and the stage-2 columns, null where stage 2 drops the cookie.

    Stage 2 judges the stage-1 cookies on the same window, so its counts are the
    stage-1 counts and need no second aggregate."""
    top = fraud_stage1(raw_conversions, as_of, short_window, limit)
    # only the stage-1 cookies' publishers are counted
    recent = attributed.where(_window("conversion_timestamp", as_of, long_window)).join(
        top.select("cookie_id"), "cookie_id", "left_semi")
    passed = F.col("conversion_count") >= min_conversions
    count, sample = _source_columns()
    return top.join(_sources(recent, sample_size), "cookie_id", "left").select(
        "cookie_id", "conversion_count", F.when(passed, F.col("conversion_count")).alias("total_conversions_last_minute"),
        F.when(passed, count).alias("unique_publishers_last_90m"), F.when(passed, sample).alias("sample_publishers_90m"))


def refined(both: DataFrame) -> DataFrame:
    """The stage-2 rows of ``fraud_two_stage``."""
    return both.where(F.col("total_conversions_last_minute").isNotNull()).drop("conversion_count")


def dropped(both: DataFrame) -> DataFrame:
    """The stage-1 rows of ``fraud_two_stage`` that stage 2 drops (false positives)."""
    return both.where(F.col("total_conversions_last_minute").isNull()).select("cookie_id", "conversion_count")


def fraud_stage_merge(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """Refine stage 1 with stage 2: stage-1-only cookies drop out (false positives),
    cookies in both take the stage-1 count, stage-2-only cookies are added."""
    s1 = stage1.select("cookie_id", F.col("conversion_count").alias("__s1"))
    j = stage2.join(s1, "cookie_id", "left")
    return j.select(
        "cookie_id",
        F.coalesce("__s1", "total_conversions_last_minute").alias("total_conversions_last_minute"),
        "unique_publishers_last_90m", "sample_publishers_90m")


def fraud_false_positives(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """Stage-1 cookies without a stage-2 row."""
    return stage1.join(stage2.select("cookie_id"), "cookie_id", "left_anti")


def fraud_report(stage: DataFrame, conversions_col: str = "total_conversions_last_minute",
                 publishers_col: str = "unique_publishers_last_90m") -> DataFrame:
    """Per cookie: the stage columns plus risk_level, risk_score, suspicious_patterns."""
    pubs = F.col(publishers_col) if publishers_col in stage.columns else F.lit(None).cast("bigint")
    conv = F.col(conversions_col)
    return stage.select(
        "*",
        risk_level(conv, pubs).alias("risk_level"),
        risk_score(conv, pubs).alias("risk_score"),
        risk_patterns(conv, pubs).alias("suspicious_patterns"))


def stage1_report(stage1: DataFrame) -> DataFrame:
    """Stage-1 rows judged on conversions only (publishers not known yet)."""
    s = stage1.select("cookie_id", F.col("conversion_count").alias("total_conversions_last_minute"),
                      F.lit(None).cast("bigint").alias("unique_publishers_last_90m"),
                      F.lit(None).cast("array<string>").alias("sample_publishers_90m"))
    return fraud_report(s)


def fraud_summary(report: DataFrame, server_rules: bool = False) -> DataFrame:
    """One row: cookies per risk level (high, medium, low, clean), zeros kept."""
    if server_rules:
        lvl = risk_level_server(F.col("total_conversions_last_minute"), F.col("unique_publishers_last_90m"))
    else:
        lvl = F.col("risk_level")
    return report.agg(*[F.count_if(lvl == F.lit(x)).alias(x) for x in RISK_LEVELS])


def risk_filter(report: DataFrame, level: str | None) -> DataFrame:
    """Rows of one risk level; blank/None keeps all."""
    return report.where(F.col("risk_level") == F.lit(level)) if level else report


def fraud_search(report: DataFrame, term: str | None) -> DataFrame:
    """Case-insensitive substring match on cookie, any pattern tag, any sample publisher."""
    if not term:
        return report
    t = F.lit(term.lower())
    hit = (F.lower("cookie_id").contains(t)
           | F.exists("suspicious_patterns", lambda p: F.lower(p).contains(t))
           | F.coalesce(F.exists("sample_publishers_90m", lambda p: F.lower(p).contains(t)), F.lit(False)))
    return report.where(hit)


def fraud_csv_rows(report: DataFrame) -> DataFrame:
    """The export's columns: level, cookie, conversions, publishers, '; '-joined samples
    and patterns, score."""
    return report.select(
        F.col("risk_level").alias("Risk Level"),
        F.col("cookie_id").alias("Cookie ID"),
        F.coalesce("total_conversions_last_minute", F.lit(0)).alias("Conversions Last Minute"),
        F.coalesce("unique_publishers_last_90m", F.lit(0)).alias("Unique Publishers 90m"),
        F.array_join(F.coalesce("sample_publishers_90m", F.array().cast("array<string>")), "; ")
        .alias("Sample Publishers"),
        F.array_join("suspicious_patterns", "; ").alias("Suspicious Patterns"),
        F.col("risk_score").alias("Risk Score"))


def export_fraud_csv(report: DataFrame, path: str) -> None:
    """Write the export as CSV with a header (distributed writer, no driver collect)."""
    fraud_csv_rows(report).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)
