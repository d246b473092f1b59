"""Column builders for the JSON time series held in entity rows.

A series is stored as JSON text ``[[ts, count], ...]`` (epoch seconds, ascending);
readers also accept ``{"ts": .., "count": ..}`` objects and mixed arrays.  In
Spark a series is ``array<struct<ts: bigint, count: bigint>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .timecols import col_

SERIES_TYPE = ArrayType(StructType([StructField("ts", LongType()), StructField("count", LongType())]))


def _elements(json_text) -> Column:
    """JSON text -> array of element JSON strings; blank, malformed or non-array -> []."""
    text = F.regexp_replace(col_(json_text), r"^\s+|\s+$", "")
    # the parser stops at the closing bracket; text after it makes the whole malformed
    arr = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))
    return F.coalesce(arr, F.array().cast("array<string>"))


def _num(c: Column) -> Column:
    return c.try_cast("double").try_cast("bigint")


def _ts_of(e: Column) -> Column:
    return F.when(e.startswith("["), F.get_json_object(e, "$[0]")).otherwise(F.get_json_object(e, "$.ts"))


def _count_of(e: Column) -> Column:
    return F.when(e.startswith("["), F.get_json_object(e, "$[1]")).otherwise(F.get_json_object(e, "$.count"))


def _is_point(e: Column) -> Column:
    """A pair of two items or more, or an object that has both keys (their values may be null)."""
    keys = F.json_object_keys(e)
    return F.coalesce(F.when(e.startswith("["), F.json_array_length(e) >= 2)
                      .otherwise(F.array_contains(keys, "ts") & F.array_contains(keys, "count")), F.lit(False))


def parse_series(json_text) -> Column:
    """JSON text -> array<struct<ts, count>>.

    Pairs ``[ts, count]`` (at least two items) and objects with both ``ts`` and
    ``count`` are kept; anything else is skipped.  Non-numeric values become null.
    """
    el = _elements(json_text)
    pairs = F.transform(el, lambda e: F.struct(_num(_ts_of(e)).alias("ts"), _num(_count_of(e)).alias("count"),
                                                _is_point(e).alias("ok")))
    kept = F.filter(pairs, lambda p: p["ok"])
    return F.transform(kept, lambda p: F.struct(p["ts"].alias("ts"), p["count"].alias("count")))


def series_total(json_text) -> Column:
    """Sum of the counts of a JSON series (objects need only ``count``).

    Text that is blank, malformed or not an array sums to 0, and, as in the
    reference, a single non-numeric count makes the whole sum 0.
    """
    el = _elements(json_text)
    raw = F.filter(F.transform(el, _count_of), lambda c: c.isNotNull())
    nums = F.transform(raw, _num)
    bad = F.exists(nums, lambda x: x.isNull())
    total = F.aggregate(nums, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(bad, F.lit(0).cast("bigint")).otherwise(total)


def series_json(series) -> Column:
    """array<struct<ts, count>> -> ``[[ts, count], [ts, count]]`` text; empty -> ``[]``."""
    s = col_(series)
    items = F.transform(s, lambda x: F.concat(F.lit("["), x["ts"].cast("string"), F.lit(", "),
                                                x["count"].cast("string"), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def conversion_rate_pct(conversions, impressions) -> Column:
    """conversions / impressions x 100 to 2 decimals; 0.0 when there are no impressions."""
    c, i = col_(conversions), col_(impressions)
    return F.when(i > 0, F.round(c.cast("double") / i * 100.0, 2)).otherwise(F.lit(0.0))


def safe_rate(numerator, denominator) -> Column:
    """``CASE WHEN d > 0 THEN n / d * 100 ELSE 0`` (null denominator -> 0)."""
    n, d = col_(numerator), col_(denominator)
    return F.when(d > 0, n.cast("double") / d.cast("double") * 100.0).otherwise(F.lit(0.0))
