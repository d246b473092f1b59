"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``ledger`` evaluates every rule once per document and stores the measurements and
one bit a failed rule.  A policy is a version, a mask of the rules it heeds and
the number of failures it still allows; applying or changing one reads the
ledger, never a text.  ``ablation`` counts, per policy and rule, what the rule
alone decides, from counts per distinct bitmask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, bound, fresh

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Bit of each rule. The first two are the base rules that every policy heeds.
RULES = ("too_few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "shouting")
BIT = {name: k for k, name in enumerate(RULES)}
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int
    allowed: int = 0


POLICIES = (
    Policy("base", BASE_MASK),
    Policy("v1", BASE_MASK | 1 << BIT["symbols"] | 1 << BIT["duplicate_lines"]),
    Policy("v2", BASE_MASK | 1 << BIT["symbols"] | 1 << BIT["duplicate_lines"] | 1 << BIT["word_length"] | 1 << BIT["shouting"]),
)
CURRENT = POLICIES[-1]


def repeated_window_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside ``size``-word windows that occur twice or more (the first included).

    Windows become 64-bit hashes.  Only where the hashes repeat at all they are
    sorted with their positions; equal neighbours are repeated windows, and the
    union of their spans is summed from the gaps between starts: n log n.
    """
    def hashed(w):
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(0))),
                           lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))

    def starts_of(s):
        again = lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

    def union(p):
        gaps = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            bound(bound(pairs, starts_of), union))

    return bound(bound(words, hashed), counted)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measurements as columns (``prefix`` avoids clashing names).

    A null text has no words and no lines.  Plain columns, not a struct: the
    optimiser would copy a struct's field expressions into every use of them.
    """
    text, words, lines = (fresh(docs.columns, x) for x in ("t_", "w_", "l_"))
    t, w, ln = F.col(text), F.col(words), F.col(lines)
    joined = F.array_join(w, "")
    found = {
        "n_words": F.size(w),
        "word_chars": F.char_length(joined),
        "n_symbols": F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, "")),
        "n_lines": F.size(ln),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": repeated_window_words(w),
        "n_upper": F.char_length(joined) - F.char_length(F.translate(joined, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    }
    return (docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
            .withColumns({words: F.regexp_extract_all(t, F.lit("(" + SPACED_WORD + ")"), F.lit(1)),
                          lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(SPACED_WORD))})
            .withColumns({prefix + k: v.cast("long") for k, v in found.items()}).drop(text, words, lines))


def failures(prefix: str = "") -> Column:
    """Bitmask of the failed rules, from the stored measurements (integers only)."""
    m = {k: F.col(prefix + k) for k in MEASURES}
    checks = {
        "too_few_words": m["n_words"] < 10,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > 3 * m["n_words"],
        "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 40 * m["n_words"]),
        "shouting": (m["word_chars"] >= 40) & (10 * m["n_upper"] > 3 * m["word_chars"]),
    }
    bits = F.lit(0).cast("long")
    for name, failed in checks.items():
        bits = bits + F.when(failed, F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame, text_col: str = "text", prefix: str = "", bits: str = "fail_bits") -> DataFrame:
    """``docs`` with measurements and failure bits; every rule is evaluated once.

    Columns of ``docs`` that would clash are avoided by the caller's ``prefix``.
    Null and empty texts fail ``too_few_words``; ties and repeated rows are judged
    row by row.
    """
    return measures(docs, text_col, prefix).withColumn(bits, failures(prefix))


def passes(bits: Column, policy: Policy) -> Column:
    """A document stays if no base rule failed and at most ``allowed`` of the others."""
    rest = policy.mask & ~BASE_MASK
    return (bits.bitwiseAND(F.lit(BASE_MASK)) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(rest))) <= policy.allowed)


def ablation(book: DataFrame, policies=POLICIES, bits: str = "fail_bits") -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those that only it rejects.

    Documents are first counted per distinct bitmask; policies and rules then apply to
    the masks alone.  A null bitmask counts nowhere; an empty ledger gives no rows.
    """
    cases = F.array(*[
        F.struct(F.lit(p.version).alias("policy"), F.lit(name).alias("rule"), F.lit(1 << BIT[name]).cast("long").alias("bit"),
                 F.lit(p.mask & ~BASE_MASK).cast("long").alias("rest"), F.lit(p.allowed).alias("allowed"))
        for p in policies for name in RULES if p.mask & 1 << BIT[name]])
    masks = book.groupBy(F.col(bits).alias("b")).agg(F.count("*").alias("n")).where("b is not null")
    each = masks.select("b", "n", F.explode(cases).alias("c")).select("b", "n", "c.*")

    def kept(b):
        return (b.bitwiseAND(F.lit(BASE_MASK)) == 0) & (F.bit_count(b.bitwiseAND(F.col("rest"))) <= F.col("allowed"))

    b, bit = F.col("b"), F.col("bit")
    fails = b.bitwiseAND(bit) != 0
    alone = ~kept(b) & kept(b.bitwiseAND(F.bitwise_not(bit)))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this_rule"))


def report(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """One row per document: base measures, base verdict, verdict of the policy, the bits."""
    book = ledger(docs.select("doc_id", "text"))
    bits = F.col("fail_bits")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (bits.bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"), passes(bits, policy).alias("kept"), "fail_bits")


def keep_good(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    prefix = "m_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    bits = fresh(docs.columns, "fail_bits")
    return ledger(docs, text_col, prefix, bits).where(passes(F.col(bits), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
