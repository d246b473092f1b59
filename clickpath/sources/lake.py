"""Lake tables on Parquet: layout, reads with partition pruning, appends, purge and
truncation on one layout; versioned tables (upsert), counts and descriptions.

A fact table is ``path/hour_key=.../...``: appends, minute jobs, pruned scans, the
purge and the truncation all work on that layout.  Whole hours are dropped as
folders; only the hour that holds the cutoff is rewritten.

There is no table-format jar on the class path, so "atomic replace" of a keyed
table is done the Spark way: a new version directory is written completely, then
readers switch to it (``latest_version``).  A failed or retried job leaves the old
version intact, and task retries inside a write are handled by Spark's output
committer.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.ids import salt_bucket
from ..functions.timecols import HOUR, add_seconds, ntz, shift, time_slice

LAKE_BUCKETS = 5          # fixed value: id buckets of the lake layout
RETENTION_HOURS = 24      # fixed value: lake retention
KEEP_VERSIONS = 2         # versions kept of a keyed table: the newest, and the one its readers may still use
SCHEMA_FOLDER = "_schema"


def hour_key(ts) -> F.Column:
    """Partition value ``yyyyMMddHH`` (int) of a wall-clock timestamp."""
    return F.date_format(ts if isinstance(ts, F.Column) else F.col(ts), "yyyyMMddHH").cast("int")


def lake_layout(df: DataFrame, ts_col: str, id_col: str, buckets: int = LAKE_BUCKETS) -> DataFrame:
    """Add the layout columns: ``hour_key`` = hour(ts), ``id_bucket`` = bucket(id, 5)."""
    return df.withColumn("hour_key", hour_key(ts_col)).withColumn("id_bucket", salt_bucket(id_col, buckets))


def write_lake_table(df: DataFrame, path: str, ts_col: str, id_col: str, mode: str = "append",
                     buckets: int = LAKE_BUCKETS) -> None:
    """Partitioned write (hour_key / id_bucket directories), rebalanced by the partition columns.

    Rebalancing clusters rows so that a directory gets few files, and lets AQE split
    an hour and bucket that is too large for one task.
    """
    laid = lake_layout(df, ts_col, id_col, buckets)
    (laid.hint("rebalance", F.col("hour_key"), F.col("id_bucket")).write.mode(mode)
     .partitionBy("hour_key", "id_bucket").parquet(path))


def append_facts(df: DataFrame, path: str, ts_col: str, id_col: str) -> None:
    write_lake_table(df, path, ts_col, id_col, mode="append")


def append_batch(df: DataFrame, path: str, ts_col: str, batch_id: int) -> None:
    """Append a batch so that appending it again replaces it: its rows are partitions of
    their own (``hour_key`` / ``batch_id``), overwritten dynamically."""
    laid = df.withColumn("hour_key", hour_key(ts_col)).withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
    (laid.hint("rebalance", F.col("hour_key")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("hour_key", "batch_id").parquet(path))


def write_minute(df: DataFrame, path: str, ts_col: str) -> None:
    """Write one minute's rows so that running the minute again replaces them.

    The minute is a partition of its own (``hour_key`` / ``minute_key``), overwritten
    dynamically: a retried job leaves no duplicates and touches no other minute.
    """
    laid = df.withColumn("hour_key", hour_key(ts_col)).withColumn("minute_key", F.minute(ts_col))
    (laid.hint("rebalance", F.col("hour_key"), F.col("minute_key")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("hour_key", "minute_key").parquet(path))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has written the table to its end."""
    fs, at = _fs(spark, path)
    return fs.exists(at(os.path.join(path, "_SUCCESS")))


def hours_of(spark: SparkSession, path: str) -> list[int]:
    """The hour keys of a lake table, by one listing of its top folder."""
    fs, at = _fs(spark, path)
    names = [st.getPath().getName() for st in fs.listStatus(at(path))]
    return sorted(int(n.removeprefix("hour_key=")) for n in names if n.startswith("hour_key="))


def _hour_number(value) -> int:
    """``yyyyMMddHH`` of a Python-side timestamp."""
    return int(dt.datetime.fromisoformat(str(value)).strftime("%Y%m%d%H"))


def _read_hours(spark: SparkSession, path: str, hours: list[int]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[os.path.join(path, f"hour_key={h}") for h in hours])


def scan_lake_table(spark: SparkSession, path: str, ts_col: str, start=None, end=None) -> DataFrame:
    """Read a lake table with ``[start, end)`` on ``ts_col``.

    Only the folders of the hours in range are listed and read; a truncated table,
    or a range without any hour, gives no rows of the table's schema.
    """
    hours = hours_of(spark, path)
    lo = _hour_number(start) if start is not None else None
    hi = _hour_number(end) if end is not None else None
    wanted = [h for h in hours if (lo is None or h >= lo) and (hi is None or h <= hi)]
    if not hours:
        schema = StructType.fromJson(json.loads(spark.read.text(os.path.join(path, SCHEMA_FOLDER)).first()[0]))
        return spark.createDataFrame([], schema)
    df = _read_hours(spark, path, wanted or hours[:1])
    return df.where(hour_prune(ts_col, start, end))


def hour_prune(ts_col: str, start=None, end=None) -> F.Column:
    """``ts`` bounds plus the equivalent ``hour_key`` bounds (partition filter)."""
    cond = time_slice(ts_col, start, end)
    if start is not None:
        cond = cond & (F.col("hour_key") >= hour_key(ntz(start)))
    if end is not None:
        cond = cond & (F.col("hour_key") <= hour_key(ntz(end)))
    return cond


# --- versioned tables ------------------------------------------------------------------------

def _versions(spark: SparkSession, base: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def latest_version(spark: SparkSession, base: str) -> str | None:
    v = _versions(spark, base)
    return os.path.join(base, f"v={v[-1]}") if v else None


def write_version(spark: SparkSession, df: DataFrame, base: str, partition_by=None, options: dict | None = None) -> str:
    """Write ``df`` as the next version of ``base``.

    A version counts only once its ``_SUCCESS`` marker exists, so readers never see
    a partial write; a job that died mid-write left an invisible ``v=n`` that the
    retry simply overwrites."""
    v = _versions(spark, base)
    path = os.path.join(base, f"v={(v[-1] + 1) if v else 0}")
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static").options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    fs, at = _fs(spark, base)
    for old in v[:-(KEEP_VERSIONS - 1)]:
        fs.delete(at(os.path.join(base, f"v={old}")), True)
    return path


def read_table_version(spark: SparkSession, base: str) -> DataFrame:
    path = latest_version(spark, base)
    if path is None:
        raise FileNotFoundError(base)
    return spark.read.parquet(path)


def upsert_by_key(existing: DataFrame, updates: DataFrame, keys, order_col: str | None = None) -> DataFrame:
    """Primary-key last-write-wins.

    Without ``order_col`` the update batch is the newest write: existing rows whose
    key is updated are dropped with a left-anti join and the updates appended; of several
    rows of one key in the batch the greatest (by the other columns, in their order) stays.
    A small batch is broadcast by the planner, so the existing table is
    scanned once and never shuffled; a large one becomes a sort-merge anti join.
    With ``order_col`` (a write time) the newest row per key wins across both sides,
    updates winning ties, then the greatest row -- a row_number over the key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = existing.columns
    others = [c for c in cols if c not in keys]
    if order_col is None:
        latest = updates.select(*cols).distinct()
        if others:
            latest = updates.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__row")).select(*keys, "__row.*").select(*cols)
        kept = existing.join(latest.select(*keys), keys, "left_anti")
        return kept.unionByName(latest)
    u = (existing.select(*cols, F.lit(0).alias("__src"))
         .unionByName(updates.select(*cols, F.lit(1).alias("__src"))))
    order = [F.col(order_col).desc_nulls_last(), F.col("__src").desc(), F.struct(*others).desc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return u.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).select(*cols)


def kv_upsert(store: DataFrame | None, key: str, value_json: DataFrame, as_of) -> DataFrame:
    """Store a one-row ``value`` JSON under ``key`` (last write wins)."""
    new = value_json.select(F.lit(key).alias("key"), F.col("value"), ntz(as_of).alias("last_update"))
    if store is None:
        return new
    return upsert_by_key(store, new, "key", "last_update")


def ttl_filter(df: DataFrame, write_time_col: str, ttl_seconds: int, as_of) -> DataFrame:
    """Rows still alive ``ttl_seconds`` after their write time."""
    return df.where(F.col(write_time_col) > add_seconds(ntz(as_of), -int(ttl_seconds)))


def retention_purge(df: DataFrame, ts_col: str, as_of, hours: int = RETENTION_HOURS) -> DataFrame:
    """Rows kept by the purge: ``ts >= as_of - hours`` (strictly older rows go)."""
    return df.where(F.col(ts_col) >= add_seconds(ntz(as_of), -hours * HOUR))


def purge_table(spark: SparkSession, path: str, ts_col: str, as_of, hours: int = RETENTION_HOURS) -> None:
    """Purge a lake table in place: rows before ``as_of - hours`` go.

    Hours wholly before the cutoff are deleted as folders.  The cutoff's own hour is
    written to a hidden folder first, then put in place of the old one; a purge that
    died in between is finished by the next one.  Nothing newer is read or written.
    """
    fs, at = _fs(spark, path)
    cutoff = dt.datetime.fromisoformat(str(as_of)) - dt.timedelta(hours=hours)
    edge = _hour_number(cutoff)
    _finish_purges(fs, at, path)
    known = hours_of(spark, path)
    if known and known[-1] < edge:
        _keep_schema(spark, path, known)
    if edge in known and cutoff != cutoff.replace(minute=0, second=0, microsecond=0):
        staged = os.path.join(path, f"_purge-{uuid.uuid4().hex}")
        rows = _read_hours(spark, path, [edge])
        parts = [c for c in ("hour_key", "minute_key", "id_bucket") if c in rows.columns]
        if known[-1] == edge:
            _keep_schema(spark, path, known)
        rows.where(F.col(ts_col) >= ntz(cutoff)).write.partitionBy(*parts).parquet(staged)
        _finish_purges(fs, at, path, edge)
    for h in known:
        if h < edge:
            fs.delete(at(os.path.join(path, f"hour_key={h}")), True)


def _finish_purges(fs, at, path: str, edge: int | None = None) -> None:
    """Put completely written cutoff hours in place; remove incomplete ones.

    ``edge`` names the hour just purged: its old folder goes even if no row is left.
    """
    for st in fs.listStatus(at(path)):
        staged = st.getPath()
        if not staged.getName().startswith("_purge-"):
            continue
        if fs.exists(at(staged, "_SUCCESS")):
            fresh = [x.getPath() for x in fs.listStatus(staged) if x.getPath().getName().startswith("hour_key=")]
            for name in {x.getName() for x in fresh} | ({f"hour_key={edge}"} if edge is not None else set()):
                fs.delete(at(path, name), True)
            for x in fresh:
                fs.rename(x, at(path, x.getName()))
        fs.delete(staged, True)


def _keep_schema(spark: SparkSession, path: str, hours: list[int]) -> None:
    """Store the schema beside the data, for readers of the emptied table."""
    schema = _read_hours(spark, path, hours[:1]).schema.json()
    spark.createDataFrame([(schema,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, SCHEMA_FOLDER))


def purge_report(tables: dict, ts_col: str, as_of, hours: int = RETENTION_HOURS) -> DataFrame:
    """Per table: count before, deleted (ts < cutoff), count after, cutoff hours; one pass each."""
    cutoff = add_seconds(ntz(as_of), -hours * HOUR)
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("count_before"),
                     F.count_if(F.col(ts_col) < cutoff).alias("deleted"))
        one = one.select(F.lit(name).alias("table_name"), "count_before", "deleted",
                         (F.col("count_before") - F.col("deleted")).alias("count_after"),
                         F.lit(hours).alias("cutoff_hours"))
        out = one if out is None else out.unionByName(one)
    return out


def truncate_all(spark: SparkSession, bases: dict) -> list[tuple[str, str]]:
    """Empty every table, lake tables (their hour folders go, the schema stays) and
    versioned ones (a new empty version); a failure on one table is reported and does
    not stop the rest."""
    done = []
    for name, base in bases.items():
        try:
            if latest_version(spark, base):
                write_version(spark, read_table_version(spark, base).limit(0), base)
            else:
                known = hours_of(spark, base)
                if known:
                    _keep_schema(spark, base, known)
                fs, at = _fs(spark, base)
                for h in known:
                    fs.delete(at(os.path.join(base, f"hour_key={h}")), True)
            done.append((name, "ok"))
        except Exception as e:  # keep going: one broken table must not stop the rest
            done.append((name, f"error: {type(e).__name__}"))
    return done


def table_row_counts(tables: dict) -> DataFrame:
    """table_name, row_count for each table (union of one-row counts).

    A table is a DataFrame or a function that opens it; one that cannot be opened
    counts -1 and does not fail the others.
    """
    out = None
    for name, table in tables.items():
        try:
            df = table() if callable(table) else table
            one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        except (AnalysisException, FileNotFoundError):
            one = SparkSession.active().range(1).select(F.lit(name).alias("table_name"), F.lit(-1).cast("long").alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out


def table_counts_json(counts: DataFrame) -> DataFrame:
    """``{"table": count, ...}`` under one row, for the key/value store."""
    return counts.agg(F.to_json(F.map_from_entries(F.sort_array(
        F.collect_list(F.struct("table_name", "row_count"))))).alias("value"))


def table_describe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Column, Type, Extra, Comment per column (schema metadata, not data)."""
    rows = [(f.name, f.dataType.simpleString(), "" if f.nullable else "not null",
             f.metadata.get("comment", "")) for f in df.schema.fields]
    schema = StructType([StructField(n, StringType()) for n in ("Column", "Type", "Extra", "Comment")])
    return spark.createDataFrame(rows, schema)


def sample_rows(df: DataFrame, n: int = 10, width: int = 30, order_by=None) -> DataFrame:
    """First ``n`` rows with every value as text: longer than ``width`` -> cut + ``...``,
    binary -> ``<binary: k bytes>``."""
    d = df.orderBy(*order_by) if order_by else df
    d = d.limit(n)
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "binary":
            txt = F.concat(F.lit("<binary: "), F.length(c).cast("string"), F.lit(" bytes>"))
        else:
            s = c.cast("string")
            txt = F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s)
        cols.append(txt.alias(f.name))
    return d.select(*cols)
