"""URL filters by a temporal list join, in DataFrame expressions only.

List entries (key, action, day) become validity intervals: an entry holds from
its day until the next entry of its key.  A capture asks for the entries active on
the day it was fetched, under every parent domain of its host and under its host
with the first path segment; the most specific active entry decides.

Captures collapse to units (host, segment, day) before anything is shuffled by key,
and the units' keys to distinct (key, day) probes, so in the as-of window a host with a
third of all captures is as many rows as days.  That window holds probes and entries of
a key together; the verdicts join back by unit, and there a host has one row for each of
its (segment, day) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))


def segment_of(url: Column) -> Column:
    """First path segment of a URL, empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"[^/?#]*/([^/?#]+)", 1)


def keys_of(host: Column, segment: Column) -> Column:
    """Keys a capture is listed under: the host, its parent domains of two labels or
    more, and host/segment."""
    labels = F.split(host, r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    more = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, more)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): an entry holds until the next one of its key
    (null: open).  Of several entries on one day the strictest counts: block, then
    allow, then remove.  ``remove`` ends the entry before it and holds nothing."""
    rank = F.expr("CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END")
    daily = entries.where("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "day").agg(F.max_by("action", rank).alias("action"))
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return daily.select("key", "action", F.col("day").alias("valid_from"), following.alias("valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (with url, fetched) plus host, verdict, rule_key, valid_from, valid_to.

    No active entry, an unreadable URL or a null fetch day: ``allowed`` without a rule.
    Repeated captures are judged alike.  The output has the captures' own columns
    page_id, url and fetched only, so extra columns cannot clash.
    """
    held = intervals(entries)
    seen = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"))
    units = seen.where("fetched IS NOT NULL AND host <> ''").select("host", "segment", "fetched").distinct()
    asked = units.withColumn("key", F.explode(keys_of(F.col("host"), F.col("segment"))))
    probes = asked.select("key", F.col("fetched").alias("day")).distinct()
    nothing = F.lit(None).cast(f"struct<action:string,valid_from:date,valid_to:date>")
    line = probes.select("key", "day", F.lit(1).alias("probe"), nothing.alias("entry")).unionByName(
        held.select("key", F.col("valid_from").alias("day"), F.lit(0).alias("probe"), F.struct("action", "valid_from", "valid_to").alias("entry")))
    as_of = F.last("entry", ignorenulls=True).over(Window.partitionBy("key").orderBy("day", "probe").rowsBetween(Window.unboundedPreceding, 0))
    active = line.withColumn("active", as_of).where("probe = 1 AND active.action <> 'remove'").select("key", F.col("day").alias("fetched"), "active")
    verdict = asked.join(active, ["key", "fetched"]).groupBy("host", "segment", "fetched").agg(
        F.max_by(F.struct("key", "active"), F.struct(F.char_length("key"), F.col("key"))).alias("rule"))
    return seen.join(verdict, ["host", "segment", "fetched"], "left").select(
        "page_id", "url", "fetched", "host",
        F.when(F.col("rule.active.action") == "block", F.lit("blocked")).otherwise(F.lit("allowed")).alias("verdict"),
        F.col("rule.key").alias("rule_key"), F.col("rule.active.valid_from").alias("valid_from"), F.col("rule.active.valid_to").alias("valid_to"))


# ---- inputs of the registered query, derived from ``pages`` ---------------------------

def _digit(name: Column, at: int) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(name.cast("binary")), at, 1)) - 1


def captures_of(pages: DataFrame) -> DataFrame:
    """Every page as a capture; its day follows from its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("page_id") * 37, F.lit(400))).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' hosts and domains; digits of the names' MD5 decide."""
    first = F.lit("2024-01-01").cast("date")
    hosts = pages.select(host_of(F.col("url")).alias("name")).where("name <> ''").distinct()
    h = F.col("name")
    start = F.date_add(first, _digit(h, 1) * 16 + _digit(h, 2))
    end = F.date_add(start, _digit(h, 4) * 4 + 1)
    listed = [
        (_digit(h, 3) < 8, h, "block", start),
        ((_digit(h, 3) < 8) & (_digit(h, 5) < 10), h, "remove", end),
        ((_digit(h, 3) < 8) & (_digit(h, 5) < 10) & (_digit(h, 6) < 6), h, "block", F.date_add(end, 30)),
        (_digit(h, 8) < 8, F.concat(h, F.lit("/en")), "allow", F.date_add(first, _digit(h, 7) * 16)),
    ]
    rows = F.array(*[F.when(c, F.struct(k.alias("key"), F.lit(a).alias("action"), d.alias("day"))) for c, k, a, d in listed])
    own = hosts.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select("e.*")
    domain = F.regexp_extract("name", r"([^.]+\.[^.]+)$", 1)
    wide = hosts.select(domain.alias("name")).where("name <> ''").distinct().select(
        F.col("name").alias("key"), F.when(_digit(h, 1) % 2 == 0, F.lit("block")).otherwise(F.lit("allow")).alias("action"),
        F.date_add(first, _digit(h, 2) * 20 + 100).alias("day"))
    return own.unionByName(wide)


def report(pages: DataFrame) -> DataFrame:
    return evaluate(captures_of(pages), entries_of(pages))
