"""Service run statistics: capped metric series, latest values, charts, the
services overview with health colours, and the per-service query log.

Stats arrive in long form ``(name, metric, ts, value)`` -- one point per job
run and metric -- and the served ``stats`` JSON is built from at most 90 points
per metric (partial top-k before the shuffle), so no group is unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_metric, health_status, humanize_age
from ..functions.timecols import epoch_seconds, from_epoch_micros, localtime_or, ntz, seconds_between
from .querylog import RECENT_QUERIES
from .series import SERIES_CAP, keep_last_n

# Fixed value: display order of the services; unknown names go last.
SERVICE_ORDER = ("generate_traffic", "hcd_to_presto", "presto_insights", "presto_to_hcd", "presto_cleanup")


def service_stat_series(points: DataFrame, cap: int = SERIES_CAP) -> DataFrame:
    """The newest ``cap`` points per (service, metric), long form."""
    return keep_last_n(points, ["name", "metric"], "ts", cap)


def stats_json(points: DataFrame, cap: int = SERIES_CAP) -> DataFrame:
    """name, stats = ``{"metric": [[ts, value], ...], ...}`` built from capped series."""
    s = service_stat_series(points, cap)
    per_metric = (s.groupBy("name", "metric")
                  .agg(F.array_sort(F.collect_list(F.array(F.col("ts").cast("double"),
                                                           F.col("value").cast("double")))).alias("pts")))
    return per_metric.groupBy("name").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "pts"))))).alias("stats"),
        F.max(F.element_at(F.element_at("pts", -1), 1)).cast("bigint").alias("__last_ts"))


def latest_metric_value(points: DataFrame) -> DataFrame:
    """name, metric, ts, value of the newest point, and its display text."""
    g = points.groupBy("name", "metric").agg(F.max_by(F.struct("ts", "value"), "ts").alias("p"))
    return g.select("name", "metric", F.col("p.ts").alias("ts"), F.col("p.value").alias("value"),
                    format_metric(F.col("p.value"), F.col("metric")).alias("display"))


def metric_chart(points: DataFrame) -> DataFrame:
    """Chart rows: name, metric, ts, label ``MMM d, HH:mm``, numeric value (bad -> 0)."""
    return points.select(
        "name", "metric", "ts",
        F.date_format(from_epoch_micros(F.col("ts") * F.lit(1_000_000)), "MMM d, HH:mm").alias("label"),
        F.coalesce(F.col("value").cast("string").try_cast("double"), F.lit(0.0)).alias("value"))


def services_table(points: DataFrame, descriptions: DataFrame, query_log: DataFrame | None = None,
                   service_of_query=None, cap: int = SERIES_CAP, settings: DataFrame | None = None) -> DataFrame:
    """Served rows: name, description, last_updated (time of the newest point),
    stats JSON, settings JSON, query_metrics JSON (the service's last 50 queries).

    ``settings``: name, setting, value (text); none stored gives ``{}``."""
    st = stats_json(points, cap)
    out = descriptions.join(st, "name", "left").select(
        "name", "description",
        F.when(F.col("__last_ts").isNotNull(), from_epoch_micros(F.col("__last_ts") * F.lit(1_000_000)))
        .alias("last_updated"),
        F.coalesce("stats", F.lit("{}")).alias("stats"),
        F.lit("{}").alias("settings"))
    if settings is not None:
        stored = settings.groupBy("name").agg(F.to_json(F.map_from_entries(F.array_sort(
            F.collect_list(F.struct("setting", "value"))))).alias("__settings"))
        out = out.join(stored, "name", "left").withColumn("settings", F.coalesce("__settings", "settings")).drop("__settings")
    if query_log is not None and service_of_query is not None:
        q = query_log.withColumn("name", service_of_query)
        w = Window.partitionBy("name").orderBy(F.col("start_time").desc(), F.col("query_id").desc())
        last = q.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= RECENT_QUERIES).drop("__rn")
        qm = last.groupBy("name").agg(F.to_json(F.collect_list(F.struct(
            "query_id", "query_text", "query_type", "query_description", "parameters", _iso("start_time"), _iso("end_time"),
            "execution_time_ms", "rows_returned", "success", "error_message", "prepared", "retry_count"))).alias("query_metrics"))
        out = out.join(qm, "name", "left").withColumn("query_metrics", F.coalesce("query_metrics", F.lit("[]")))
    return out


def _iso(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)


def services_parsed(services: DataFrame) -> DataFrame:
    """Long form of the stored JSON of every service: (name, kind, key, points, value).

    A metric of ``stats`` gives the number of its points and the newest value; a setting
    gives its value.  Text that is no JSON gives no rows."""
    stats = services.select("name", F.explode(F.from_json("stats", "map<string,array<array<double>>>")).alias("key", "pts"))
    stats = stats.select("name", F.lit("stat").alias("kind"), "key", F.size("pts").cast("bigint").alias("points"),
                         F.get(F.element_at("pts", -1), F.lit(1)).cast("string").alias("value"))
    settings = services.select("name", F.explode(F.from_json("settings", "map<string,string>")).alias("key", "value"))
    return stats.unionByName(settings.select("name", F.lit("setting").alias("kind"), "key", F.lit(None).cast("bigint").alias("points"), "value"))


def health_history(points: DataFrame, as_of) -> DataFrame:
    """Per (service, health, age text): how often a service was that old when its next run came,
    or ``as_of`` for the last one.  Runs are distinct times, so a service's window holds
    one row a minute at most."""
    runs = points.select("name", "ts").distinct()
    w = Window.partitionBy("name").orderBy("ts")
    now = epoch_seconds(localtime_or(as_of))
    age = (F.coalesce(F.lead("ts").over(w), now) - F.col("ts")).alias("age_seconds")
    return runs.select("name", age).groupBy("name", health_status("age_seconds").alias("health_status"),
                                            humanize_age("age_seconds").alias("age_text")).agg(F.count(F.lit(1)).alias("runs"))


def services_overview(services: DataFrame, as_of=None) -> DataFrame:
    """Per service: age_seconds, health, human age, sort_order (fixed order, unknown last)."""
    age = seconds_between(F.col("last_updated"), localtime_or(as_of))
    order = F.array_position(F.array(*[F.lit(s) for s in SERVICE_ORDER]), F.col("name"))
    return services.select(
        "name", "description", age.alias("age_seconds"),
        health_status(age).alias("health_status"),
        humanize_age(age).alias("age_text"),
        F.when(order > 0, order - 1).otherwise(F.lit(len(SERVICE_ORDER))).cast("int").alias("sort_order"))


def healthy_services(overview: DataFrame) -> DataFrame:
    """Only green services, alphabetical."""
    return overview.where(F.col("health_status") == "green").orderBy("name")


QUERY_METRIC_SCHEMA = ("array<struct<query_id:string,query_text:string,query_type:string,query_description:string,"
                       "parameters:array<string>,start_time:string,end_time:string,execution_time_ms:double,rows_returned:bigint,"
                       "success:boolean,error_message:string,prepared:boolean,retry_count:int>>")


def service_query_log(services: DataFrame) -> DataFrame:
    """Flatten each service's query_metrics JSON into rows, with the service name."""
    e = services.select("name", F.explode(F.from_json("query_metrics", QUERY_METRIC_SCHEMA)).alias("q"))
    return e.select(F.col("name").alias("service_name"), "q.*")


def stat_points_since(points: DataFrame, as_of) -> DataFrame:
    """Points with ts (epoch seconds) up to ``as_of``."""
    return points.where(from_epoch_micros(F.col("ts") * F.lit(1_000_000)) <= ntz(as_of))
