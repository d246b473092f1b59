"""Text-shaped domain scalars as Column builders: query fingerprints, truncation,
parameter sanitising, human-readable durations / ages, health colours and
metric formatting.  All are built-in expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecols import col_

# Fingerprint rewrites, applied in this order to the upper-cased,
# trimmed text (Java regex syntax, ``$n`` group references).
FINGERPRINT_RULES = (
    (r"(\w+\s*=\s*)'[^']*'", "$1"),
    (r'(\w+\s*=\s*)"[^"]*"', "$1"),
    (r"(\w+\s*=\s*)\d+(\.\d+)?", "$1"),
    (r"(\bIN\s*\()\s*[^)]+(\))", "$1$2"),
    (r"(\bBETWEEN\s+)[^A]+(\bAND\s+)[^\s]+", "$1$2"),
)
WEB_TRUNCATE = 750        # fixed value: query text cut in the web wrapper
SERVICE_TRUNCATE = 1500   # fixed value: query text cut in the services
MAX_PARAMS, PARAM_WIDTH, PARAM_KEEP = 10, 15, 12   # fixed values: parameter sanitising
HEALTH_RED_AFTER, HEALTH_YELLOW_AFTER = 180, 90    # fixed values: seconds


# Speed-up for the three ``(\w+\s*=\s*)...`` rules, same matches: a leftmost match
# never starts inside a word unless it starts where the previous match ended
# (a match at p inside a word implies one at p - 1), so the engine is told to
# try only those positions instead of every character of every word.
_WORD_START = r"(?:(?<!\w)|\G)"


def _anchored(pattern: str) -> str:
    return _WORD_START + pattern if pattern.startswith(r"(\w+") else pattern


def query_fingerprint(text) -> Column:
    """Normalised query pattern: values in ``=`` predicates, IN lists and BETWEEN
    bounds blanked, whitespace squeezed.  ``>=`` bounds and ``= TIMESTAMP '..'``
    are kept, as in the reference."""
    s = F.upper(F.trim(col_(text)))
    for pattern, repl in FINGERPRINT_RULES:
        s = F.regexp_replace(s, _anchored(pattern), repl)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def truncate_text(text, max_length: int = WEB_TRUNCATE) -> Column:
    """Texts over ``max_length``: rtrim(first n) + ``... [truncated from L chars]``."""
    t = col_(text)
    cut = F.concat(F.regexp_replace(F.substring(t, 1, max_length), r"\s+$", ""), F.lit("... [truncated from "),
                   F.length(t).cast("string"), F.lit(" chars]"))
    return F.when(F.length(t) > max_length, cut).otherwise(t)


def sanitize_params(params) -> Column:
    """First 10 parameters as text; any longer than 15 chars -> first 12 + ``...``."""
    p = F.slice(col_(params), 1, MAX_PARAMS)
    return F.transform(p, lambda x: F.when(F.length(x) > PARAM_WIDTH,
                                           F.concat(F.substring(x, 1, PARAM_KEEP), F.lit("..."))).otherwise(x))


def humanize_duration(seconds) -> Column:
    """<60 ``Ns``; <3600 ``Mm Ss``; else ``Hh Mm``; null or 0 -> ``N/A``."""
    s = col_(seconds).cast("bigint")
    return (F.when(s.isNull() | (s == 0), F.lit("N/A"))
            .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .when(s < 3600, F.concat((s / 60).cast("bigint").cast("string"), F.lit("m "),
                                     F.pmod(s, F.lit(60)).cast("string"), F.lit("s")))
            .otherwise(F.concat((s / 3600).cast("bigint").cast("string"), F.lit("h "),
                                (F.pmod(s, F.lit(3600)) / 60).cast("bigint").cast("string"), F.lit("m"))))


def _plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, F.lit("s")).otherwise(F.lit("")))


def humanize_age(seconds) -> Column:
    """``N second(s)`` / ``N minute(s)`` / ``N hour(s)``, floored."""
    s = col_(seconds).cast("bigint")
    return (F.when(s < 60, _plural(s, "second"))
            .when(s < 3600, _plural(F.floor(s / 60), "minute"))
            .otherwise(_plural(F.floor(s / 3600), "hour")))


def health_status(age_seconds) -> Column:
    """red when unknown or older than 180 s, yellow when older than 90 s, else green."""
    a = col_(age_seconds)
    return (F.when(a.isNull() | (a > HEALTH_RED_AFTER), F.lit("red"))
            .when(a > HEALTH_YELLOW_AFTER, F.lit("yellow")).otherwise(F.lit("green")))


def _bytes(v: Column) -> Column:
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB")])
    """1024 steps; values below one byte stay in bytes, negative ones keep their sign."""
    i = F.greatest(F.least(F.floor(F.log(1024.0, F.greatest(F.abs(v), F.lit(1.0)))), F.lit(4)), F.lit(0)).cast("int")
    scaled = F.round(v / F.pow(F.lit(1024.0), i), 2)
    num = F.regexp_replace(F.format_number(scaled, 2), r"\.?0+$", "")
    return F.when(v == 0, F.lit("0 Bytes")).otherwise(
        F.concat(F.regexp_replace(num, ",", ""), F.lit(" "), F.element_at(units, i + 1)))


def format_metric(value, metric_name) -> Column:
    """Display text by metric name: percent/rate ``x.xx%``, bytes/memory in 1024
    steps, seconds ``x.xxxs``, time/latency ``x.xxms``, else a grouped number."""
    v, n = col_(value).cast("double"), col_(metric_name)
    grouped = F.regexp_replace(F.format_number(v, 3), r"\.?0+$", "")
    return (F.when(n.contains("percent") | n.contains("rate"), F.format_string("%.2f%%", v))
            .when(n.contains("bytes") | n.contains("memory"), _bytes(v))
            .when(n.contains("seconds"), F.format_string("%.3fs", v))
            .when(n.contains("time") | n.contains("latency"), F.format_string("%.2fms", v))
            .otherwise(grouped))
