"""Intermediate tables of iterative operators in the shared folder of the cluster.

Writing a round's result and reading it back cuts the lineage: a lost executor costs
the tasks of one round.  A round's table is removed once the next one stands.

The shuffle files of a written table stay on the executors' disks until the driver happens to
collect its plan.  ``stored(..., shuffles_stay=False)`` has Spark remove them when the table stands.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path


#: Remove the shuffle files of an execution at its end (of this session, from Spark 4.1 on).
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """What is planned and run inside leaves no shuffle files; the session's setting is then as before."""
    was = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if was is None else spark.conf.set(SHUFFLES_GO, was)


def stored(df: DataFrame, label: str, shuffles_stay: bool = True) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read back, and the path."""
    spark = df.sparkSession
    path = shared_path(spark, "work", f"{label}-{uuid.uuid4().hex}")
    with nullcontext() if shuffles_stay else shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
