"""Collocations by direct-address tiling of frequency-ranked ids.

1. Words are counted per language (in each batch, then by Spark).  Frequent ones get
   ids: the ``HEAD`` most frequent their rank, the others a 62-bit hash of their key.
2. The corpus is written once as id sequences; a piece's end or a rare word is a break.
3. The pairs of adjacent ids of a sequence block are counted: ranks are split into
   tiles of ``TILE`` x ``TILE`` pairs, a well-filled tile is counted by one dense
   ``bincount``, the pairs of sparse tiles and of hashed ids as sorted coordinates.
   Spark sums the blocks' counts and keeps the frequent pairs.
4. These are ranked again and are the ids of the next level: a pair of overlapping
   two-word phrases is a three-word phrase, and so on to ``longest`` words.

What a task holds of a level is bounded at any size of the corpus: the ranks of
``HEAD`` pairs and a bitmap of ``2**BITS`` bits for the other frequent ones.  The bitmap
only spares pairs that cannot be frequent: a wrong bit costs a count, never a result.
Phrases grow by joins of level tables (at most corpus / ``min_count`` rows each), which
carry the counts of all first and last parts, so that scores need no further look-up.

Text null: empty; language null: ``und``.  Repeated rows count each; ties are ordered
by phrase; an empty table gives no rows.  Only the language and text columns are read, so other
columns' names cannot clash.  Ids of words and phrases are compared by 64-bit hashes
(62 bits beyond the ranks); counts, scores and phrases are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesutil as B
from .common import removed, stored

HEAD = 1 << 16
TILE_BITS = 9
TILE = 1 << TILE_BITS
DENSE = TILE * TILE // 16          # pairs in a block from which a tile is counted densely
BITS = 24
SLICE_BYTES = 4 << 20
SALTS = 64
BREAK, HASHED = -1, -2
_HASHED_ID = np.uint64(1 << 62)

# What ends a piece, and what else ends a word.
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_PIECE_END
_WORD[[0x20, 0x09]] = False
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return B.mix(B.mix(a.astype(np.uint64)) + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashed_id(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids, above all ranks, of pairs that have none."""
    return ((pair_hash(a, b) >> np.uint64(2)) | _HASHED_ID).astype(np.int64)


@dataclass
class Ranks:
    """The frequent pairs of a level, in bounded memory: ``a``/``b`` of the head in the order
    of their hashes, their ranks, and a bitmap of the others (empty if there are none)."""
    a: np.ndarray
    b: np.ndarray
    rank: np.ndarray
    bitmap: np.ndarray

    def __post_init__(self):
        self.hashes = pair_hash(self.a, self.b)
        order = np.argsort(self.hashes)
        self.a, self.b, self.rank, self.hashes = self.a[order], self.b[order], self.rank[order], self.hashes[order]

    def ids(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pairs; ``BREAK`` for pairs that are not frequent (almost all of them)."""
        out = np.full(len(a), BREAK, np.int64)
        h = pair_hash(a, b)
        if len(self.a):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.a) - 1)
            ranked = (self.a[at] == a) & (self.b[at] == b)
            out[ranked] = self.rank[at[ranked]]
        if len(self.bitmap):
            slot = h & np.uint64((1 << BITS) - 1)
            word = self.bitmap[(slot >> np.uint64(6)).astype(np.int64)]
            rest = np.flatnonzero((out < 0) & ((word >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool))
            out[rest] = hashed_id(a[rest], b[rest])
        return out


def ranks(level: DataFrame, head: int) -> Ranks:
    """Ranks of the frequent pairs (a, b, c).  The head is found by a histogram of counts
    (sixteen bins a doubling), so at most ``head`` rows come to the driver, and of the
    others a bitmap of fixed size."""
    bin_of = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(level.groupBy(bin_of.alias("bin")).count().collect(), reverse=True)
    total, least = 0, None
    for bin_, n in bins:
        if total + n > head:
            break
        total, least = total + n, bin_
    empty = np.zeros(0, np.int64)
    a = b = empty
    if least is not None:
        top = level.where(bin_of >= least).select("a", "b", "c").toPandas()
        top = top.sort_values(["c", "a", "b"], ascending=[False, True, True])
        a, b = (top[k].to_numpy(np.int64) for k in ("a", "b"))
    bitmap = np.zeros(0, np.uint64)
    if total < sum(n for _, n in bins):
        rest = level if least is None else level.where(bin_of < least)
        words = rest.select("a", "b").mapInArrow(_slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        bitmap = np.zeros(1 << (BITS - 6), np.uint64)
        bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return Ranks(a, b, np.arange(len(a)), bitmap)


def _slots(batches):
    for batch in batches:
        slot = pair_hash(*(batch.column(c).to_numpy() for c in ("a", "b"))) & np.uint64((1 << BITS) - 1)
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)),
                                          pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["word", "bits"])


# --- words ---------------------------------------------------------------------------

def _language_hashes(column) -> tuple[list, np.ndarray, np.ndarray]:
    """Languages of a batch, the number of each row's and a hash of each."""
    coded = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
    names = coded.dictionary.to_pylist()
    data, offs = B.buffers(pa.array(names, pa.string()))
    hashes = np.array([B.span_hashes(np.append(data[a:b], np.uint8(0)), np.array([0]), np.array([b - a + 1]))[0]
                       for a, b in zip(offs[:-1], offs[1:])], np.uint64)
    return names, coded.indices.to_numpy(), hashes


def _words(batch):
    """Per slice: bytes, word starts and ends, each word's row, its hash (of language and word)."""
    names, code, salts = _language_hashes(batch.column("lang"))
    for i, j in B.slices(batch.column("text"), SLICE_BYTES):
        data, offs = B.buffers(batch.column("text").slice(i, j - i))
        s, e = B.spans(data, offs, _WORD)
        row = np.searchsorted(offs, s, "right") - 1
        h = B.mix(B.span_hashes(data, s, e) ^ salts[code[i:j]][row]) if len(s) else np.zeros(0, np.uint64)
        yield names, code[i:j], data, s, e, row, h.view(np.int64)


def _count_words(batches):
    for batch in batches:
        for names, code, data, s, e, row, h in _words(batch):
            if not len(h):
                continue
            different, first, n = np.unique(h, return_index=True, return_counts=True)
            lower = data.tobytes().translate(_LOWER)
            found = [lower[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in code[row[first]].tolist()], pa.string()), pa.array(different, pa.int64()),
                 pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "a", "word", "c"])


def _encoder(words):
    def run(batches):
        known = words.value
        for batch in batches:
            for _, _, data, s, e, row, h in _words(batch):
                if not len(h):
                    continue
                ids = known.ids(h, np.zeros(len(h), np.int64))
                piece = np.cumsum(_PIECE_END[data])[s]
                cut = np.zeros(len(ids), bool)
                cut[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
                ids = np.insert(ids, np.flatnonzero(cut), BREAK)
                ids = ids[np.append(True, (ids[1:] != BREAK) | (ids[:-1] != BREAK))]     # one break at a time
                hashed = ids >= HEAD_LIMIT
                codes = np.where(hashed, HASHED, ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([ids[hashed].tobytes()], pa.binary())],
                                                 names=["codes", "hashed"])
    return run


HEAD_LIMIT = 1 << 31     # ranks are below, hashed ids far above


# --- pairs ---------------------------------------------------------------------------

def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal rows of sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(keys[0])))


def tiled_counts(a: np.ndarray, b: np.ndarray, head: int = HEAD, dense_from: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their counts: dense tiles by ``bincount``, the rest as sorted coordinates."""
    ranked = (a < head) & (b < head)
    x, y = a[ranked], b[ranked]
    across = (head + TILE - 1) >> TILE_BITS
    tile = (x >> TILE_BITS) * across + (y >> TILE_BITS)
    filled = np.bincount(tile, minlength=1)
    dense = filled >= dense_from
    out = []
    inside = np.flatnonzero(dense[tile]) if len(tile) else np.zeros(0, np.int64)
    inside = inside[np.argsort(tile[inside], kind="stable")]
    cell = (x[inside] & (TILE - 1)) << TILE_BITS | (y[inside] & (TILE - 1))
    end = 0
    for t in np.flatnonzero(dense).tolist():
        start, end = end, end + int(filled[t])
        counts = np.bincount(cell[start:end], minlength=TILE * TILE)
        hit = np.flatnonzero(counts)
        out.append(((t // across << TILE_BITS) + (hit >> TILE_BITS), (t % across << TILE_BITS) + (hit & (TILE - 1)), counts[hit]))
    sparse = ~dense[tile] if len(tile) else np.zeros(0, bool)
    key = np.sort(x[sparse] * head + y[sparse])
    at, n = _runs(key)
    out.append((key[at] // head, key[at] % head, n))
    p, q = a[~ranked], b[~ranked]
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    at, n = _runs(p, q)
    out.append((p[at], q[at], n))
    return tuple(np.concatenate(k).astype(np.int64) for k in zip(*out))


def _pair_counter(levels, head: int):
    """Counts the pairs of the last level's ids in each block of the written sequences."""
    def run(batches):
        known = [k.value for k in levels]
        for batch in batches:
            for codes, hashed in zip(batch.column("codes"), batch.column("hashed")):
                codes = np.frombuffer(codes.as_buffer(), np.int32)
                ids = codes.astype(np.int64)
                ids[codes == HASHED] = np.frombuffer(hashed.as_buffer(), np.int64)
                for k in known:     # ids of one level's adjacent pairs are the next level's ids
                    ids = _next_ids(ids, k)
                ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
                a, b, c = tiled_counts(ids[:-1][ok], ids[1:][ok], head)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, c)], names=["a", "b", "c"])
    return run


def _next_ids(ids: np.ndarray, known: Ranks) -> np.ndarray:
    out = np.full(max(len(ids) - 1, 0), BREAK, np.int64)
    ok = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    out[ok] = known.ids(ids[ok], ids[ok + 1])
    return out


def _identified(known):
    """Level rows with the ids that the sequences use."""
    def run(batches):
        for batch in batches:
            ids = known.value.ids(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=[*batch.schema.names, "id"])
    return run


def _with_ids(level: DataFrame, known) -> DataFrame:
    return level.mapInArrow(_identified(known), level.select("*", F.lit(0).cast("long").alias("id")).schema)


# --- phrases -------------------------------------------------------------------------

def _grown(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of one word more: ``pf``/``sf`` are the counts of the first/last 1, 2, .. words."""
    left = shorter.select(F.col("id").alias("a"), "lang", F.col("words").alias("lw"), "pf")
    right = shorter.select(F.col("id").alias("b"), F.element_at("words", -1).alias("rw"), "sf")
    own = F.array("c")
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", "c", "lang", F.concat("lw", F.array("rw")).alias("words"), F.concat("pf", own).alias("pf"), F.concat("sf", own).alias("sf"))


def _not_covered(level: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Phrases without an equally frequent longer one (one word longer is enough: what
    lies between has a count between)."""
    if longer is None:
        return level
    size = F.size("words")
    covered = longer.where(F.col("c") == F.get("pf", size - 2)).select(F.col("a").alias("id")).union(
        longer.where(F.col("c") == F.get("sf", size - 2)).select(F.col("b").alias("id"))).distinct()
    return level.join(covered, "id", "left_anti")


def score(level: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the lowest-scoring cut, in decimals of 38 digits."""
    cuts = F.expr("""array_min(transform(sequence(1, size(words) - 1), k -> struct(
        (cast(1000 * c as decimal(19, 0)) * cast(n as decimal(18, 0)))
          div (cast(pf[k - 1] as decimal(19, 0)) * cast(sf[size(words) - k - 1] as decimal(18, 0))) as score, k as k)))""")
    return (level.join(sizes, "lang").withColumn("cut", cuts)
            .select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("c").alias("a"),
                    F.expr("pf[cut.k - 1]").alias("l"), F.expr("sf[size(words) - cut.k - 1]").alias("r"), "n", F.col("cut.score").alias("score")))


def best(scored: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` phrases: first in ``SALTS`` parts a language, so that one
    language's phrases never meet in a task, then among the parts' best."""
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, head: int = HEAD,
         lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words that occur ``min_count`` times or
    more: lang, rank, phrase, a, l, r, n, score."""
    spark: SparkSession = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    words, _ = stored(rows.mapInArrow(_count_words, "lang string, a long, word string, c long")
                      .groupBy("lang", "a", "word").agg(F.sum("c").alias("c")), "words")
    sizes = words.groupBy("lang").agg(F.sum("c").alias("n"))
    frequent = words.where(F.col("c") >= min_count).withColumn("b", F.lit(0).cast("long"))
    known = share(ranks(frequent, head))
    sequences, place = stored(rows.mapInArrow(_encoder(known), "codes binary, hashed binary"), "id-sequences")
    counts = F.array("c")
    level = _with_ids(frequent, known).select("id", "lang", F.array("word").alias("words"), counts.alias("pf"), counts.alias("sf"))
    levels, lookups = [], []
    for length in range(2, longest + 1):
        pairs, _ = stored(sequences.mapInArrow(_pair_counter(lookups, head), "a long, b long, c long")
                          .groupBy("a", "b").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count), f"pairs-{length}")
        known = share(ranks(pairs, head))
        level, _ = stored(_with_ids(_grown(pairs, level), known), f"phrases-{length}")
        levels.append(level)
        lookups.append(known)
    removed(spark, place)
    out = None
    for level, longer in zip(levels, [*levels[1:], None]):
        some = score(_not_covered(level, longer), sizes)
        out = some if out is None else out.unionByName(some)
    return best(out, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
