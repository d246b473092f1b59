"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of an Arrow batch.  Its words become symbols: the rank of
the word among the benchmark's words, or a separator for every other word.
Runs of benchmark words shorter than the shortest window cannot hold one and
leave the index; all other runs are indexed whole.  The index is a suffix
array of the shard (prefix doubling, separators all distinct), its
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled
every 16 symbols and at each run start.  All windows are searched backwards at
once through wavelet ranks; occurrences are located by stepping to the next
sampled position, and overlapping ones merge into removal spans.

Spark side: one ``mapInArrow`` per benchmark block, all in one stage: one pass over
the documents, no shuffle, nothing written.  The benchmark is the stated query set;
it is read in blocks of about ``BLOCK_BYTES`` as sent (arrays: a window is its start
in the block's words), so what is broadcast has a fixed bound; every further block
adds one worker with one block to a task.  Words are compared by 64-bit hashes (two
different words agree with probability 2**-64; a false window needs 13 of them in a
row), windows of the benchmark among each other by a 64-bit hash too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesutil as B
from .common import fresh

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 64 << 20
WORD_BYTES, ITEM_BYTES = 24, 16
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word before A-Z are lower-cased
SAMPLE = 16

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("word_start", T.LongType()), T.StructField("word_end", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("word_start", pa.int64()), ("word_end", pa.int64()),
                                  ("start", pa.int64()), ("end", pa.int64())])))])


class WaveletMatrix:
    """Rank over a symbol sequence: one bit vector per symbol bit, high bit first."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels = []
        cur = seq
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = ((cur >> bit) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(cur) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((bit, words, before, len(cur) - int(ones.sum())))
            cur = np.concatenate([cur[~ones], cur[ones]])
        self.start = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    @staticmethod
    def _ones(words, before, i):
        w = i >> 6
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def _down(self, c, i):
        for bit, words, before, zeros in self.levels:
            k = self._ones(words, before, i)
            i = np.where((c >> bit) & 1, zeros + k, i - k)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c[k] before position i[k]."""
        return self._down(c, i) - self.start[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position, and its rank there."""
        c = np.zeros(len(i), np.int64)
        for bit, words, before, zeros in self.levels:
            one = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            k = self._ones(words, before, i)
            c |= one.astype(np.int64) << bit
            i = np.where(one, zeros + k, i - k)
        return c, i - self.start[c]


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Suffix array of symbols that end with 0; each 0 differs from the others
    (by position), so no comparison passes one.  Prefix doubling; each round sorts
    only the suffixes whose rank is still shared."""
    n = len(sym)
    n_sep = int((sym == 0).sum())
    value = sym.astype(np.int64) + n_sep
    value[sym == 0] = np.arange(n_sep)
    order = np.argsort(value, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.r_[True, np.diff(value[order]) != 0]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    shared = order[~(head & np.r_[head[1:], True])]
    k = 1
    while len(shared):
        base, after = rank[shared], rank[np.minimum(shared + k, n - 1)]
        o = np.argsort(base * n + after)
        base, after, at = base[o], after[o], shared[o]
        i = np.arange(len(o))
        group = np.r_[True, base[1:] != base[:-1]]
        part = group | np.r_[True, after[1:] != after[:-1]]
        first = np.maximum.accumulate(np.where(group, i, 0))
        rank[at] = base + np.maximum.accumulate(np.where(part, i, 0)) - first
        shared = at[~(part & np.r_[part[1:], True])]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Count and locate patterns (without 0) in symbols that end with 0."""

    def __init__(self, sym: np.ndarray, n_symbols: int):
        sa = suffix_array(sym)
        bwt = sym[sa - 1]
        self.matrix = WaveletMatrix(bwt, n_symbols)
        self.first = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(sym, minlength=n_symbols), out=self.first[1:])
        kept = (sa % SAMPLE == 0) | (bwt == 0)
        self.slot = np.cumsum(kept) - 1
        self.kept, self.value = kept, sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges of the patterns (one a row, of equal length) that occur."""
        n, length = patterns.shape
        return self.search_windows(patterns.reshape(-1), np.arange(n) * length, length)

    def search_windows(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges of the windows of ``length`` symbols at ``starts`` that occur."""
        c = symbols[starts + (length - 1)]
        which = np.flatnonzero(self.first[c] < self.first[c + 1])
        c = c[which]
        lo, hi = self.first[c], self.first[c + 1]
        for t in range(length - 2, -1, -1):
            if not len(which):
                break
            c = symbols[starts[which] + t].astype(np.int64)
            both = self.first[np.r_[c, c]] + self.matrix.rank(np.r_[c, c], np.r_[lo, hi])
            lo, hi = both[:len(c)], both[len(c):]
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled row."""
        out = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            hit = self.kept[rows]
            out[left[hit]] = self.value[self.slot[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            if len(left):
                c, k = self.matrix.access(rows)
                rows = self.first[c] + k
                steps += 1
        return out


def word_hashes(column):
    data, offs = B.buffers(column)
    s, e = B.spans(data, offs, B.LOWER_ALNUM)
    return data, offs, s, e, B.span_hashes(data, s, e), B.row_of(s, offs)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[k]`` consecutive numbers from ``starts[k]`` on, for every k in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def query_block(ids: list, texts: list, window: int = WINDOW) -> dict:
    """Vocabulary and distinct windows of some benchmark items, all as arrays.

    An item of fewer words than ``window``, but not none, is one window.  The words
    of all items stand once in ``symbols`` (ranks in ``vocab``); a window is its start
    there.  Per window length: the starts of the distinct windows and, in one flat
    array cut by ``offsets``, the places of their items in ``names``.  ``names`` are the
    distinct ids in string order, a null id last.
    """
    _, _, _, _, h, rows = word_hashes(pa.array(texts, pa.string()))
    vocab, symbols = np.unique(h, return_inverse=True)
    symbols = (symbols + 1).astype(np.int32)
    names = sorted({str(i) for i in ids if i is not None}) + [None]
    place = {name: k for k, name in enumerate(names)}
    named = np.array([place[None if i is None else str(i)] for i in ids], np.int32)
    n_words = np.diff(rows)
    length = np.minimum(n_words, window)
    groups = []
    for n in np.unique(length[length > 0]).tolist():
        here = np.flatnonzero(length == n)
        count = n_words[here] - n + 1
        start, owner = ragged(rows[:-1][here], count), np.repeat(named[here], count)
        key = np.zeros(len(start), np.uint64)
        for t in range(n):
            key = B.mix(key + symbols[start + t].astype(np.uint64) + np.uint64(t + 1))
        order = np.lexsort((owner, key))
        key, start, owner = key[order], start[order], owner[order]
        fresh_key = np.r_[True, key[1:] != key[:-1]]
        once = fresh_key | np.r_[True, owner[1:] != owner[:-1]]
        first = np.flatnonzero(fresh_key[once])
        groups.append((n, start[fresh_key].astype(np.int32), np.r_[first, once.sum()].astype(np.int32), owner[once]))
    return {"vocab": vocab, "symbols": symbols, "names": names, "groups": groups}


def find(column, block: dict) -> tuple[np.ndarray, list]:
    """Words per text, and per text the item ids and merged spans (or None)."""
    data, offs, s, e, h, rows = word_hashes(column)
    n_words = np.diff(rows)
    found: list = [None] * len(n_words)
    vocab, groups, names = block["vocab"], block["groups"], block["names"]
    if not len(h) or not groups:
        return n_words, found
    at = np.searchsorted(vocab, h)
    at[at == len(vocab)] = 0
    sym = np.where(vocab[at] == h, at + 1, 0)
    # runs of benchmark words within a text, as long as the shortest window at least
    inside = sym > 0
    begins = np.zeros(len(h) + 1, bool)
    begins[rows] = True
    first = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | begins[:-1]))
    last = np.flatnonzero(inside & (np.r_[~inside[1:], True] | begins[1:])) + 1
    long_enough = last - first >= groups[0][0]
    first, last = first[long_enough], last[long_enough]
    if not len(first):
        return n_words, found
    size = last - first + 1
    ends = np.cumsum(size)
    position = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first, size)
    text = sym[np.minimum(position, len(sym) - 1)]
    text[ends - 1] = 0
    index = FMIndex(text, len(vocab) + 1)
    cover = np.zeros(len(h) + 1, np.int64)
    named = []
    for n, starts, offsets, owners in groups:
        which, lo, hi = index.search_windows(block["symbols"], starts, n)
        if not len(which):
            continue
        count = hi - lo
        word = position[index.locate(ragged(lo, count))]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + n, -1)
        text_of = np.searchsorted(rows, word, "right") - 1
        pairs = np.unique(text_of * len(starts) + np.repeat(which, count))
        text_of, which = pairs // len(starts), pairs % len(starts)
        count = offsets[which + 1].astype(np.int64) - offsets[which]
        named.append(np.unique(np.repeat(text_of, count) * len(names) + owners[ragged(offsets[which].astype(np.int64), count)]))
    if not named:
        return n_words, found
    named = np.unique(np.concatenate(named))
    text_of, named = named // len(names), named % len(names)
    with_hits, first_name = np.unique(text_of, return_index=True)
    hit = np.cumsum(cover[:-1]) > 0
    for r, who in zip(with_hits.tolist(), np.split(named, first_name[1:])):
        a, b = int(rows[r]), int(rows[r + 1])
        edge = np.diff(np.r_[0, hit[a:b].astype(np.int8), 0])
        ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        o = int(offs[r])
        chars = np.r_[0, np.cumsum((data[o:int(offs[r + 1])] & 0xC0) != 0x80)]
        found[r] = ([names[k] for k in who.tolist()], [
            {"word_start": int(x), "word_end": int(y), "start": int(chars[s[a + x] - o]), "end": int(chars[e[a + y - 1] - o])}
            for x, y in zip(ws, we)])
    return n_words, found


def benchmark_blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of about ``block_bytes`` as sent; an item is never split.

    What an item adds to a block is at most ``WORD_BYTES`` a word (symbol, window start,
    offset, owner, vocabulary entry) and its id.
    """
    bench = bench.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    sent = words * WORD_BYTES + F.coalesce(F.octet_length("item"), F.lit(0)) + ITEM_BYTES
    total = bench.agg(F.sum(sent.cast("long"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = part.toArrow()
        yield query_block(rows["item"].to_pylist(), rows["text"].to_pylist())


def search(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
           bench_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = True,
           out: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of hits, and that column's name.

    The struct holds ``n_words``, ``items`` (ids of items with an occurring window,
    sorted as strings, a null id last) and ``spans`` (merged hit words: word positions and code
    points, end exclusive).  Null and empty texts have no words; repeated rows are
    judged one by one; an empty benchmark hits nothing.  Other columns pass
    through, whatever their names.  With ``keep_text=False`` the text is left out.
    """
    out = fresh(docs.columns, out or "hits")
    spark = docs.sparkSession
    for k, block in enumerate(benchmark_blocks(bench, item_col, bench_text_col, block_bytes)):
        name = out if k == 0 else fresh(docs.columns, "more_hits")
        schema = T.StructType([*docs.schema.fields, T.StructField(name, RESULT)])
        docs = docs.mapInArrow(_worker(spark.sparkContext.broadcast(block), text_col, name), schema)
        if k:
            a, b = F.col(out), F.col(name)
            merged = F.struct(a["n_words"].alias("n_words"),
                              F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
                              _union_spans(F.concat(a["spans"], b["spans"])).alias("spans"))
            docs = docs.withColumn(out, merged).drop(name)
    return (docs if keep_text else docs.drop(text_col)), out


def _union_spans(spans):
    """Merge overlapping spans in word order."""
    def step(acc, x):
        tail = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            tail["word_start"].alias("word_start"), F.greatest(tail["word_end"], x["word_end"]).alias("word_end"),
            tail["start"].alias("start"), F.greatest(tail["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["word_end"] >= x["word_start"]), joined).otherwise(
            F.concat(acc, F.array(x)))
    kind = RESULT["spans"].dataType
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def _worker(block, text_col: str, name: str):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for i, j in B.slices(column, SHARD_BYTES):
                n_words, found = find(column.slice(i, j - i), block.value)
                hits = [{"n_words": int(n), "items": f[0] if f else [], "spans": f[1] if f else []}
                        for n, f in zip(n_words, found)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, _ARROW)],
                                                 names=[*part.schema.names, name])
    return run


def hit_words(hits):
    """Number of words under the merged spans of a hit struct."""
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda a, x: a + x["word_end"] - x["word_start"])


def contaminated(hits):
    """The rule: some word is hit, and a twentieth of all words at least."""
    n = hit_words(hits)
    return (n > 0) & (20 * n >= hits["n_words"])


def remove_spans(text, hits):
    """The text without its removal spans (the clean parts, in order)."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(hits["spans"], lambda x: x["end"]))
    starts = F.concat(F.transform(hits["spans"], lambda x: x["start"]), F.array(F.char_length(text).cast("long")))
    return F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")),
                                    lambda p: F.substring(text, p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int"))), "")


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the item ids, the verdict.  A null item
    id counts as one item and has no name in the digest.  ``search`` gives the spans."""
    found, h = search(docs.select("doc_id", "text"), bench, keep_text=False)
    hits = F.col(h)
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), hit_words(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        contaminated(hits).alias("contaminated"))


def keep_clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found, h = search(docs, bench)
    return found.where(~contaminated(F.col(h))).drop(h)


