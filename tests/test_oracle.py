"""Every registered query against its DuckDB oracle on the smallest supplied tables
(the driver runs the same comparison at sf0.01; tools/oracle_check.py does it by hand)."""

from __future__ import annotations

import pytest

from clickpath.plans import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert r["status"] in ("OK", "rows-only"), r


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["advertisers_id", "publishers_id", "cookie_id", "conversion_timestamp",
                          "impression_timestamp", "time_to_conversion_seconds", "created_at"]
    assert df.count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
