"""The timeline's cut against brute force: dense paths, ties, small limits, short look-backs."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from clickpath.operators.timeline import conversion_timeline
from tests.conftest import ATT_SCHEMA, IMP_SCHEMA

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("limit", [1, 7, 40, 10_000])
def test_cut_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    imps = sorted({(f"P{rng.randrange(3)}", f"A{rng.randrange(2)}", f"C{rng.randrange(2)}", rng.randrange(200)) for _ in range(400)})
    spans = []
    for _ in range(60):
        end = rng.randrange(5, 200)
        spans.append((f"A{rng.randrange(2)}", f"C{rng.randrange(2)}", max(0, end - rng.randrange(0, 21)), end))
    want = []
    for path in {(a, c) for _, a, c, _ in imps}:
        rows = [(m, p, end) for p, a, c, m in imps for a2, c2, first, end in spans if (a, c) == (a2, c2) == path and first <= m <= end]
        want += [(*path, p, at(m), at(end)) for m, p, end in sorted(rows)[:limit]]
    imp = spark.createDataFrame([(p, a, c, at(m), 1) for p, a, c, m in imps], IMP_SCHEMA)
    att = spark.createDataFrame([(a, "P0", c, at(e), at(f), (e - f) * 60, T0) for a, c, f, e in spans], ATT_SCHEMA)
    got = conversion_timeline(imp, att, lookback_seconds=20 * 60, limit=limit).collect()
    assert sorted((r.advertisers_id, r.cookie_id, r.publishers_id, r.timestamp, r.conversion_timestamp) for r in got) == sorted(want)


@pytest.mark.parametrize("limit", [1, 7, 40, 10_000])
def test_listed_spans_equal_brute_force(spark, limit):
    """Spans that begin at impressions: ties at one start, several conversions of one start, paths without spans."""
    rng = random.Random(limit + 1)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    imps = sorted({(f"P{rng.randrange(3)}", f"A{rng.randrange(2)}", f"C{rng.randrange(3)}", rng.randrange(300)) for _ in range(700)})
    begins = [(a, c, m) for _, a, c, m in imps if c != "C2"]
    spans = sorted({(a, c, m, m + rng.randrange(0, 21)) for a, c, m in (rng.choice(begins) for _ in range(150))})
    want = []
    for path in {(a, c) for _, a, c, _ in imps}:
        rows = [(m, p, end) for p, a, c, m in imps for a2, c2, first, end in spans if (a, c) == (a2, c2) == path and first <= m <= end]
        want += [(*path, p, at(m), at(end)) for m, p, end in sorted(rows)[:limit]]
    imp = spark.createDataFrame([(p, a, c, at(m), 1) for p, a, c, m in imps], IMP_SCHEMA)
    att = spark.createDataFrame([(a, "P0", c, at(e), at(f), (e - f) * 60, T0) for a, c, f, e in spans], ATT_SCHEMA)
    key = lambda df: sorted((r.advertisers_id, r.cookie_id, r.publishers_id, r.timestamp, r.conversion_timestamp) for r in df.collect())
    assert key(conversion_timeline(imp, att, lookback_seconds=20 * 60, limit=limit, first_touch=True)) == sorted(want)
    one = conversion_timeline(imp, att, lookback_seconds=20 * 60, limit=limit, first_touch=True, advertiser="A1", cookie="C0")
    assert key(one) == sorted(w for w in want if w[:2] == ("A1", "C0"))
    assert conversion_timeline(imp, att.limit(0), lookback_seconds=20 * 60, first_touch=True).count() == 0
