"""Time helpers as Column builders.

Facts are minute-grained wall-clock timestamps (``timestamp_ntz``).  All
bucketing is done with integer arithmetic on epoch microseconds so results do
not depend on the session time zone, and everything stays inside whole-stage
codegen (no Python UDF).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60
HOUR = 3600
DAY = 86400


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _epoch0() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ntz(value) -> Column:
    """A ``timestamp_ntz`` value from a string, datetime or Column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock ``timestamp_ntz``.

    Built from date parts, which do not depend on the session time zone
    (``timestamp_diff`` would cast to a session-zone timestamp and shift by a
    daylight-saving offset)."""
    t = col_(c).cast("timestamp_ntz")
    days = F.unix_date(F.to_date(t)).cast("bigint")
    secs = F.hour(t).cast("bigint") * 3600 + F.minute(t).cast("bigint") * 60
    micros = (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("bigint")   # seconds with fraction
    return days * F.lit(86_400_000_000) + secs * F.lit(1_000_000) + micros


def epoch_seconds(c) -> Column:
    return F.floor(epoch_micros(c) / F.lit(1_000_000)).cast("bigint")


def from_epoch_micros(c) -> Column:
    """``timestamp_ntz`` from epoch microseconds (no session time zone involved)."""
    return F.timestamp_add("MICROSECOND", col_(c), _epoch0())


def trunc_to(c, unit_seconds: int) -> Column:
    """Truncate a ``timestamp_ntz`` to a multiple of ``unit_seconds`` (minute, hour, day)."""
    step = F.lit(int(unit_seconds) * 1_000_000)
    m = epoch_micros(c)
    return from_epoch_micros(m - F.pmod(m, step))


def minute_of(c) -> Column:
    return trunc_to(c, MINUTE)


def add_seconds(c, seconds) -> Column:
    q = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    return F.timestamp_add("SECOND", q, col_(c).cast("timestamp_ntz"))


def previous_full_minute(as_of) -> Column:
    """``date_trunc('minute', as_of) - 1 minute`` (the minute the reference jobs handle)."""
    return add_seconds(minute_of(ntz(as_of)), -MINUTE)


def time_slice(c, start=None, end=None) -> Column:
    """Half-open ``[start, end)`` predicate; ``None`` bounds are open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (col_(c) >= ntz(start))
    if end is not None:
        cond = cond & (col_(c) < ntz(end))
    return cond


def seconds_between(a, b) -> Column:
    """Whole seconds from ``a`` to ``b`` (``date_diff('second', a, b)``), wall clock."""
    d = epoch_micros(b) - epoch_micros(a)
    # truncate toward zero like date_diff
    return F.when(d >= 0, F.floor(d / F.lit(1_000_000))).otherwise(-F.floor(-d / F.lit(1_000_000))).cast("bigint")


def shift(value, seconds: int) -> str:
    """Python-side ``value + seconds`` for literal bounds (keeps predicates pushable)."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    return (value + _dt.timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def localtime_or(as_of) -> Column:
    """``as_of`` as timestamp_ntz, or the current wall clock when not given."""
    return ntz(as_of) if as_of is not None else F.localtimestamp()
