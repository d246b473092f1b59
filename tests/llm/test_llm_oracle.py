"""Registered queries of the subpackage against their SQL, and the pipeline end to end."""

from __future__ import annotations

import pytest

import corpus_pipeline
from clickpath.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["status"] == "OK", r


def test_pipeline_stages_keep_document_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL).cache()
        assert docs.columns == columns
        if name != "source_mixing":
            assert 0 < docs.count() <= n
            n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() > 0
