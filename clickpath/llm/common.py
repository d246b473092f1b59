"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpath.session import shared_path

#: Words separated by ASCII white space (Java and RE2 read it alike).
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def fresh(columns, base: str) -> str:
    """``base``, lengthened until no column of ``columns`` has that name (Spark
    compares names without case)."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; it read back, and its path.

    Cuts the lineage: a lost executor costs the tasks of the current stage only.
    The folder is the one of ``spark.checkpoint.dir``, which all executors see.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """``stored``, without the path."""
    return stored(df, label)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: inside a lambda a column expression
    would be evaluated again for every element, a lambda variable is not."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_digest(text: Column) -> Column:
    """First 128 bits of the SHA-256 of a text (null counts as the empty text)."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
