from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from clickpath.session import build_session
    scratch = tempfile.mkdtemp(prefix="clickpath-tests-", dir="/tmp")
    s = build_session("local[*]", app="clickpath-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": os.path.join(scratch, "checkpoints")})
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="clickpath-t-", dir="/tmp")


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


IMP_SCHEMA = "publishers_id string, advertisers_id string, cookie_id string, timestamp timestamp_ntz, impressions int"
CONV_SCHEMA = "advertisers_id string, timestamp timestamp_ntz, cookie_id string"
ATT_SCHEMA = ("advertisers_id string, publishers_id string, cookie_id string, conversion_timestamp timestamp_ntz, "
              "impression_timestamp timestamp_ntz, time_to_conversion_seconds bigint, created_at timestamp_ntz")
