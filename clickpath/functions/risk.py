"""Fraud risk rules as Column builders (usable over a whole table).

``pubs`` may be null: that is the "publisher data not available yet" branch of
the dashboard rules, which judges on conversions alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecols import col_

# Thresholds and pattern tags of the dashboard rules.
HIGH_CONV, HIGH_PUBS = 20, 10
MEDIUM_CONV, MEDIUM_PUBS = 10, 5
LOW_CONV, LOW_PUBS = 5, 3
PATTERN_EXTREME = "Extremely high conversion rate"
PATTERN_HIGH = "High conversion velocity"
PATTERN_ELEVATED = "Elevated conversion activity"
PATTERN_MULTI_PUB = "Multiple publisher sources"
PATTERN_DIVERSE_PUB = "Diverse publisher activity"
PATTERN_CONCENTRATED = "Concentrated publisher activity"
PATTERN_DISTRIBUTED = "Distributed conversion pattern"
PATTERN_NORMAL = "Normal activity"
RISK_LEVELS = ("high", "medium", "low", "clean")


def _conv(c) -> Column:
    return F.coalesce(col_(c), F.lit(0))


def risk_level(conversions, publishers) -> Column:
    conv, pubs = _conv(conversions), col_(publishers)
    conv_only = (F.when(conv >= HIGH_CONV, "high").when(conv >= MEDIUM_CONV, "medium")
                 .when(conv >= LOW_CONV, "low").otherwise("clean"))
    full = (F.when((conv >= HIGH_CONV) & (pubs >= HIGH_PUBS), "high")
            .when((conv >= MEDIUM_CONV) & (pubs >= MEDIUM_PUBS), "medium")
            .when((conv >= LOW_CONV) | (pubs >= LOW_PUBS), "low").otherwise("clean"))
    return F.when(pubs.isNull(), conv_only).otherwise(full)


def risk_level_server(conversions, publishers) -> Column:
    """The server-side summary variant: a null publisher count counts as 0."""
    return risk_level(conversions, F.coalesce(col_(publishers), F.lit(0)))


def risk_score(conversions, publishers) -> Column:
    conv, pubs = _conv(conversions), col_(publishers)
    with_pubs = F.least(conv * 2, F.lit(50)) + F.least(pubs * 3, F.lit(50))
    return F.least(F.when(pubs.isNull(), F.least(conv * 3, F.lit(80))).otherwise(with_pubs),
                   F.lit(100)).cast("bigint")


def risk_patterns(conversions, publishers) -> Column:
    conv, pubs = _conv(conversions), col_(publishers)
    has = pubs.isNotNull()
    tags = F.array(
        F.when(conv >= HIGH_CONV, PATTERN_EXTREME).when(conv >= MEDIUM_CONV, PATTERN_HIGH)
        .when(conv >= LOW_CONV, PATTERN_ELEVATED),
        F.when(has & (pubs >= HIGH_PUBS), PATTERN_MULTI_PUB).when(has & (pubs >= MEDIUM_PUBS), PATTERN_DIVERSE_PUB),
        F.when(has & (conv >= 15) & (pubs <= 2), PATTERN_CONCENTRATED),
        F.when(has & (conv >= LOW_CONV) & (pubs >= 8), PATTERN_DISTRIBUTED),
    )
    found = F.filter(tags, lambda t: t.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(PATTERN_NORMAL))).otherwise(found)
