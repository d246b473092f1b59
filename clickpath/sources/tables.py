"""Readers for the supplied parquet tables.

Every read is a plain ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan; callers select only what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None, where=None) -> DataFrame:
    """Column-pruned read; ``where`` reaches the Parquet scan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    return df if where is None else df.where(where)
