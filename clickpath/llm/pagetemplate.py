"""Main text of web pages by equivalence-class template deduction.

1. Every page is parsed into container tokens (the paths of its block elements)
   and text tokens (path and text of each block).
2. Pages of a host are distinct if their own main texts are: copies with another
   advert or menu are one page.  A token's occurrence vector over them is folded into
   a fingerprint, the sum of hash(page, count): tokens of equal fingerprint form an
   equivalence class.  Vectors are summed map-side, never collected, so a host
   with a third of all pages costs no more than its distinct tokens.
3. Classes that span at least half of a host's pages are valid.  Containers that occur
   once a page are the template's skeleton, nested by path; those that occur more
   often lie in its list slots.  Text outside articles and main elements is the
   template's if it is on nearly all pages, two or more, or if its class has three tokens
   or more and a container it is nested in (a notice with its frame on half of the
   pages).  Inside them no text is, however many pages repeat it: a heading on every
   page of a host is part of every article.  A page without article or main element
   that would lose more blocks than it keeps keeps all.
4. The host's slot is its articles, else its main elements, if they hold at least
   90 % of its pages' text that is neither the template's nor a menu, header, footer,
   sidebar, notice, advert, form or comment by element or name; else the body.  A
   page's text is what remains in that slot; a page of which the slot holds less than
   half gives its whole body.

Names mark boilerplate only as a whole or by their last word, and never on html,
body, main, article or what the page's only article is in.

Templates (one small row per host) are written and joined back to the pages by
host: broadcast only if their stored size is under Spark's threshold.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .urls import host_of

MIN_SHARE, TEXT_SHARE = 0.5, 0.9
#: Part of the text that an article or main element holds to be the slot: of a host, of one page.
SLOT_SHARE, PAGE_SHARE = 0.9, 0.5
#: Tokens that a class has at least to be a template's where it is not on nearly all pages.
CLASS_TOKENS = 3
#: Kinds of tokens beside containers (-1 boilerplate, 0 plain): text outside articles and main elements, the lengths of a page's text.
TEXT, PAGE = 9, 10
ZONES = {"article": 2, "main": 1}
KINDS = ZONES | {"html": 3, "body": 3}

# Elements and names of what is not main text.
RAW = "script|style|noscript|template|svg|title|textarea|iframe|object|canvas|math"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var".split())
BOILER_TAGS = frozenset("head nav header footer aside form button select menu dialog fieldset".split())
BOILER_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus "
                         "footer header menu nav navbar navigation newsletter notice notices popup promo related share sharing "
                         "sidebar social sponsor sponsored subscribe toolbar widget".split())
BOILER_NOT = frozenset("has with without no".split())
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)|[^<]++|<", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@lru_cache(1 << 16)
def is_boiler_name(name: str) -> bool:
    """A listed word, whole or last (``site-footer``), that is not what a page has or lacks (``has-sidebar``)."""
    if name in BOILER_WORDS:
        return True
    words = re.split("[_-]+", name)
    return words[-1] in BOILER_WORDS and not BOILER_NOT.intersection(words)


class Page:
    """Blocks of a page: (path, boiler, text, zone); containers: path -> [count, chars, kind].

    The zone has bit 2 inside an article and bit 1 inside a main element; chars is
    the text that is no boilerplate."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, str, int]] = []
        self.containers: dict[str, list[int]] = {}
        # path, boiler by its tags, zone, places of the named elements it is in, kind, place of its parent
        opened: list[tuple[str, bool, int, frozenset, int, int]] = []
        texts: list[tuple[int, str]] = []  # place of the container, text
        stack: list[tuple[str, int]] = []  # tag, place
        held: list[str] = []

        def flush():
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                texts.append((stack[-1][1] if stack else -1, text))

        for m in _TOKEN.finditer(html):
            tag = m["tag"]
            if tag is None:
                if m.group()[0] != "<" or m.group() == "<":
                    held.append(html_lib.unescape(m.group()))
                continue
            tag = tag.lower()
            if tag in VOID:
                if tag == "br":
                    held.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in INLINE:
                continue
            flush()
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in SELF_CLOSING):
                stack.pop()
            names = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(m["attrs"])]
            parent = stack[-1][1] if stack else -1
            above, boiler, zone, named = opened[parent][:4] if stack else ("", False, 0, frozenset())
            boiler = boiler or tag in BOILER_TAGS and not (tag == "header" and zone)
            if tag not in KINDS and any(is_boiler_name(w) for _, n in names for w in n.lower().split()):
                named = named | {len(opened)}
            label = tag + "".join("." + n for k, n in names if k == "class" and n)
            stack.append((tag, len(opened)))
            opened.append((above + "/" * bool(stack[1:]) + label, boiler, zone | ZONES.get(tag, 0), named, KINDS.get(tag, 0), parent))
        flush()
        void = self._void_names(opened, texts)
        boilers = [o[1] or bool(o[3] - void) for o in opened]
        for (path, _, _, _, kind, _), boiler in zip(opened, boilers):
            seen = self.containers.setdefault(path, [0, 0, 0])
            seen[0] += 1
            seen[2] = -1 if boiler else kind
        for k, text in texts:
            path, _, zone, _, _, _ = opened[k] if k >= 0 else ("", False, 0, None, 0, -1)
            boiler = k >= 0 and boilers[k]
            self.blocks.append((path, boiler, text, zone))
            while k >= 0 and not boiler:
                self.containers[opened[k][0]][1] += len(text)
                k = opened[k][5]

    @staticmethod
    def _void_names(opened, texts) -> frozenset:
        """Places of the named elements that the page's only articles (or main elements)
        are in: their names say nothing of the text."""
        for zone in (2, 1):
            around: frozenset = frozenset()
            inside = other = 0
            for k, text in texts:
                if k < 0 or opened[k][1]:
                    continue
                names = frozenset(n for n in opened[k][3] if not opened[n][2] & zone)
                if opened[k][2] & zone and not names:
                    break
                if opened[k][2] & zone:
                    around, inside = around | names, inside + len(text)
                elif opened[k][2] and not names:
                    other += len(text)
            else:
                if inside and inside >= other:
                    return around
        return frozenset()

    def chars(self, zone: int = 0) -> int:
        """Length of the text that is no boilerplate, in a zone or anywhere."""
        return sum(len(t) for _, boiler, t, z in self.blocks if not boiler and (z & zone or not zone))

    def own_text(self) -> str:
        """Text of the page's articles, else of its main elements, else all; without boilerplate."""
        kept = [(t, z) for _, boiler, t, z in self.blocks if not boiler]
        zone = max((z for _, z in kept), default=0) & 2 or max((z for _, z in kept), default=0)
        return "\n\n".join(t for t, z in kept if not zone or z & zone)

    def main_text(self, slot: int = 0, constants=()) -> str:
        """The slot's text without the template's (``constants``, outside articles only), which
        stays where it would be more than what is left: the page is then a near copy of others."""
        kept = [(t, z, bool(constants) and not z and text_token(p, t) in constants) for p, boiler, t, z in self.blocks if not boiler]
        length = lambda blocks: sum(len(b[0]) for b in blocks)
        free = [b for b in kept if not b[2]] or kept
        zone = 0
        for z in (slot, 3 - slot) if slot else ():
            if 0 < length(b for b in free if b[1] & z) >= PAGE_SHARE * length(free):
                zone = z
                break
        inside = [b for b in kept if not zone or b[1] & zone]
        rest, fixed = [b for b in inside if not b[2]], [b for b in inside if b[2]]
        if rest and (len(rest) >= len(fixed) or not zone and length(rest) >= length(fixed)):
            inside = rest
        return "\n\n".join(b[0] for b in inside)


def text_token(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


def _tokens(batches):
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("host", "page", "kind", "path", "text", "n", "chars")}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(html or "")
            if not (own := page.own_text()):
                continue
            key = xxhash.xxh64_intdigest(own) - (1 << 63)
            rows = [(host, key, c[2], p, 0, c[0], c[1]) for p, c in page.containers.items()]
            rows += [(host, key, PAGE, name, 0, 1, page.chars(zone)) for name, zone in (("", 0), *ZONES.items())]
            counts: dict[int, list] = {}
            for p, boiler, t, zone in page.blocks:
                if not boiler and not zone:
                    counts.setdefault(text_token(p, t), [TEXT, p, 0, len(t)])[2] += 1
            rows += [(host, key, kind, p, h, n, n * c) for h, (kind, p, n, c) in counts.items()]
            for row in rows:
                for name, value in zip(out, row):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["host"], pa.string()), pa.array(out["page"], pa.int64()), pa.array(out["kind"], pa.int32()),
             pa.array(out["path"], pa.string()), pa.array(out["text"], pa.int64()), pa.array(out["n"], pa.int64()),
             pa.array(out["chars"], pa.int64())], names=list(out))


def vectors(pages: DataFrame) -> DataFrame:
    """(host, kind, path, text, support, total, chars, vector): the tokens of each host.
    Text of a single page is no template and left out."""
    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(
        _tokens, "host string, page long, kind int, path string, text long, n long, chars long").groupBy(
        "host", "page", "kind", "path", "text").agg(F.max("n").alias("n"), F.max("chars").alias("chars"))
    return seen.groupBy("host", "kind", "path", "text").agg(
        F.count("*").alias("support"), F.sum("n").alias("total"), F.sum("chars").alias("chars"),
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector")).where((F.col("kind") != TEXT) | (F.col("support") > 1))


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """(host, n_pages, support, total, tokens): the valid classes of each host, tokens
    being structs (kind, path, text, chars).  Kind 9 is text; the others are
    containers: 3 html or body, 2 article, 1 main element, 0 plain, -1 boilerplate."""
    sizes = tokens.where((F.col("kind") == PAGE) & (F.col("path") == "")).select("host", F.col("support").alias("n_pages"))
    valid = tokens.where(F.col("kind") != PAGE).join(sizes, "host").where(F.col("support") >= MIN_SHARE * F.col("n_pages"))
    return valid.groupBy("host", "n_pages", "vector", "support", "total").agg(
        F.array_sort(F.collect_list(F.struct("path", "kind", "text", "chars"))).alias("tokens"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, skeleton, lists, constants, main, slot): one row per host."""
    tokens = written(vectors(pages), "vectors")
    classes = equivalence_classes(tokens).withColumn("nearly_all", F.col("support") >= TEXT_SHARE * F.col("n_pages"))
    # text is the template's if its class is on nearly all pages, or has several tokens and a container that the text is nested in
    nested = lambda t: F.exists("tokens", lambda c: (c["kind"] < TEXT) & F.concat(t["path"], F.lit("/")).startswith(F.concat(c["path"], F.lit("/"))))
    fixed = lambda t: (t["kind"] == TEXT) & (F.col("nearly_all") | (F.size("tokens") >= CLASS_TOKENS) & nested(t))
    flat = classes.select("host", (F.col("support") == F.col("total")).alias("once"), F.explode(
        F.transform("tokens", lambda t: F.struct(t["path"].alias("path"), t["kind"].alias("kind"), t["text"].alias("text"), t["chars"].alias("chars"), fixed(t).alias("fixed")))
    ).alias("t")).select("host", "once", "t.*")
    container = F.col("kind") < TEXT
    longest = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("chars", (-F.length("path")).alias("l"), "path")))["path"]
    shape = flat.groupBy("host").agg(
        F.array_sort(F.collect_set(F.when(F.col("once") & container, F.col("path")))).alias("skeleton"),
        F.array_sort(F.collect_set(F.when(~F.col("once") & container, F.col("path")))).alias("lists"),
        F.array_sort(F.collect_set(F.when(F.col("fixed"), F.col("text")))).alias("constants"),
        F.sum(F.when(F.col("fixed"), F.col("chars")).otherwise(0)).alias("fixed_chars"),
        *[longest(kind).alias(name) for name, kind in ZONES.items()])
    length = {name: F.sum(F.when(F.col("path") == name, F.col("chars"))).alias(f"{name or 'page'}_chars") for name in ("", *ZONES)}
    sums = tokens.where(F.col("kind") == PAGE).groupBy("host").agg(*length.values())
    free = F.col("page_chars") - F.coalesce("fixed_chars", F.lit(0))
    nearly = lambda name: (F.col(f"{name}_chars") > 0) & (F.col(f"{name}_chars") >= SLOT_SHARE * free)
    return sums.join(shape, "host", "left").select(
        "host", "skeleton", "lists", "constants", F.when(nearly("article"), F.col("article")).when(nearly("main"), F.col("main")).alias("main"),
        F.when(nearly("article"), 2).when(nearly("main"), 1).otherwise(0).alias("slot"))


def _extract(batches):
    for batch in batches:
        ids, urls, htmls, slots, constants = (batch.column(k) for k in range(5))
        texts = []
        for html, slot, fixed in zip(htmls.to_pylist(), slots.to_pylist(), constants.to_pylist()):
            texts.append(Page(html or "").main_text(slot or 0, frozenset(fixed or ())))
        yield pa.RecordBatch.from_arrays(
            [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    Null or empty html gives an empty text; a null url is the host without a name;
    repeated rows are extracted one by one but count once for the template; extra
    columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    known = written(templates(pages).select("host", "slot", "constants"), "templates")
    rows = pages.withColumn("page_host", host_of(F.col("url"))).join(known, F.col("page_host") == F.col("host"), "left")
    return rows.select("page_id", "url", "html", "slot", "constants").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
