"""Identifier conventions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecols import col_

# Default cohort list, in the reference's order.
COHORTS = ("TECH", "FASHION", "HEALTH", "FINANCE", "TRAVEL")
FRAUD_PREFIX = "CID_FRAUD_"
RANDOM_PREFIX = "CID_RANDOM_"


def salt_bucket(key, buckets: int) -> Column:
    """Stable write-distribution bucket in ``[0, buckets)``: the first 32 bits of the key's
    MD5, which any engine can compute."""
    head = F.conv(F.substring(F.md5(col_(key).cast("string").cast("binary")), 1, 8), 16, 10)
    return F.pmod(head.cast("bigint"), F.lit(int(buckets))).cast("short")


def cookie_class(cookie, cohorts=COHORTS) -> Column:
    """FRAUD, a cohort name, RANDOM, or OTHER from the cookie prefix."""
    c = col_(cookie)
    expr = F.when(c.startswith(FRAUD_PREFIX), F.lit("FRAUD"))
    for cohort in cohorts:
        expr = expr.when(c.startswith(f"CID_{cohort}_"), F.lit(cohort))
    return expr.when(c.startswith(RANDOM_PREFIX), F.lit("RANDOM")).otherwise(F.lit("OTHER"))


def publisher_cohort(publisher, cohorts=COHORTS) -> Column:
    """Cohort embedded as ``PID_{COHORT}_nnn`` if it is one of ``cohorts`` (None: any), else null."""
    embedded = F.regexp_extract(col_(publisher), r"^PID_([A-Z]+)_[0-9]+$", 1)
    known = embedded != "" if cohorts is None else embedded.isin(*cohorts)
    return F.when(known, embedded)
