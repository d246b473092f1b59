"""The training-data pipeline: five stages over ``documents``, each one Spark job.

``run`` writes every stage's result as Parquet in the shared folder and rereads it
for the next one, so a lost executor never reaches back past a stage.  A stage's table
is removed when the next one's is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickpath.llm import decontam, mixing, neardup, packing, rules
from clickpath.llm.common import read, removed, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the sources' target weights."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token rows."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_output", tokenize),
]

#: SQL can express neither the signatures nor the permutations nor the tokeniser;
#: tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of ``documents`` after all stages.  Nulls, empty and repeated rows are
    treated as each stage's operator states; an empty table gives no rows."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            removed(spark, before)
        before = path
    return docs
