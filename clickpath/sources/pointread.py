"""Point reads that skip what they do not need.

A table for look-ups is range-partitioned and sorted by its key, so a key's rows lie in a
few row groups of one or two files, and the row groups' minima and maxima rule out the
others.  Columns that are looked up but not sorted by get a Bloom filter per row group.
The second sort column lets a hot key spread over several files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def look_up_options(bloom=(), row_group_bytes: int | None = None, distinct: int | None = None) -> dict[str, str]:
    """Writer options: Bloom filters for the columns ``bloom`` (sized for ``distinct`` values
    a row group) and the size of row groups."""
    options = {}
    for c in bloom:
        options[f"parquet.bloom.filter.enabled#{c}"] = "true"
        if distinct:
            options[f"parquet.bloom.filter.expected.ndv#{c}"] = str(distinct)
    if row_group_bytes:
        options["parquet.block.size"] = str(row_group_bytes)
    return options


def sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partitioned and sorted by ``keys``; adaptive execution sizes the partitions."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_sorted(df: DataFrame, path: str, keys, bloom=(), row_group_bytes: int | None = None, distinct: int | None = None) -> None:
    sorted_by(df, *keys).write.mode("overwrite").options(**look_up_options(bloom, row_group_bytes, distinct)).parquet(path)


def point_read(spark: SparkSession, path: str, **key) -> DataFrame:
    """Rows with the given column values; the equality reaches the Parquet reader."""
    df = spark.read.parquet(path)
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    return df
