"""Mix sources to target weights: fixed-length blocks, multinomial shard counts,
per-source index permutations, and a join of blocks by index.

1. A source's words are packed into blocks of ``BLOCK`` words.  Documents go to
   chunks of about ``CHUNK_WORDS`` words by hash; the words of a chunk, in id
   order, are cut into blocks (its last block may be shorter), and the blocks of
   a source are numbered chunk after chunk.  A hot source is many chunks, so no
   task holds a source.
2. Targets: every source gets its weight's share of ``RATIO`` times all words,
   never more than ``LIMIT`` times its own; what is over goes to the others by
   weight.  That is min(LIMIT * size, level * weight) for one level.
3. A source's slots (target over mean block length) are dealt to the output
   shards as multinomial counts: the total of a range of shards is split between
   its halves by a binomial draw seeded by (seed, source, level), down to single
   shards.  The sum over all shards is exact.
4. Slot number s reads pass s // n_blocks, index s % n_blocks; a keyed Feistel
   permutation of the source's indices turns it into a block.  A pass takes a
   block once at most, so nothing is taken more than LIMIT times.
5. Slots and blocks are joined by (source, block), by a shuffle of both: the
   planner takes the slots for as few as the counts they come from and would
   broadcast them.

All draws are functions of the seed: reruns agree.  Sources are ordered by code
point, null last.  Null texts have no words and are never taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesutil as B
from .common import fresh

BLOCK = 128
CHUNK_WORDS = 1 << 20
WEIGHTS = (3.0, 1.0, 2.0)
RATIO, LIMIT = 1.5, 2
SHARD_SLOTS = 1 << 14
SEED = 20240131
SLICE_BYTES = 4 << 20


def _counter(text_col: str):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for i, j in B.slices(column, SLICE_BYTES):
                data, offs = B.buffers(column.slice(i, j - i))
                s, _ = B.spans(data, offs, B.SPACED)
                part = batch.slice(i, j - i)
                keep = [k for k, n in enumerate(part.schema.names) if n != text_col]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(np.diff(B.row_of(s, offs)), pa.int64())],
                                                 names=[*(part.schema.names[k] for k in keep), "size"])
    return run


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key=None) -> DataFrame:
    """(doc_id, source, h, size): words of each document; ``h`` hashes the row."""
    key = key if key is not None else F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       key.alias("h"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter("text"), "doc_id long, source string, h long, size long")


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, limit: int = LIMIT) -> DataFrame:
    """(source, sidx, source_size, target) from (source, size) rows.

    The level is the first of the candidates, over sources by rising cap-to-weight
    ratio, that does not exceed the source's own ratio.  One row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sidx") % len(weights) + 1).cast("int"))
    per = per.withColumn("sidx", F.row_number().over(order) - 1).withColumn("weight", w)
    per = per.withColumn("cap", F.col("source_size").cast("double") * limit).withColumn("turn", F.col("cap") / F.col("weight"))
    by = Window.orderBy("turn", "sidx")
    whole = Window.partitionBy()
    per = per.withColumn("capped", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("open", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    goal = F.sum("source_size").over(whole) * F.lit(float(ratio))
    level = (goal - F.coalesce("capped", F.lit(0.0))) / F.col("open")
    per = per.withColumn("level", F.min(F.when(level <= F.col("turn"), F.struct("turn", level.alias("level")))).over(whole)["level"])
    goal_met = F.least(F.col("cap"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "sidx", "source_size", goal_met.alias("target"))


def _binomial_split(sidx: int, slots: int, shards: int, seed: int):
    """Multinomial counts of ``slots`` over a power of two of equal shards: the shards
    with any, and their counts."""
    shard, count = np.zeros(1, np.int64), np.array([slots], np.int64)
    level = 0
    while 1 << level < shards:
        left = np.random.default_rng([seed, sidx, level]).binomial(count, 0.5)
        shard = np.repeat(shard * 2, 2)
        shard[1::2] += 1
        count = np.stack([left, count - left], 1).reshape(-1)
        shard, count = shard[count > 0], count[count > 0]
        level += 1
    return (shard, count) if slots else (shard[:0], count[:0])


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0x45D9F3B) & np.uint64(0xFFFFFFFF)
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0x45D9F3B) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1, by a six-round Feistel network on
    the next even number of bits, walked until the value is below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    rounds = [np.uint64(k) for k in np.random.default_rng(key).integers(0, 1 << 32, 6)]
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> shift, x[todo] & low
        for r in rounds:
            a, b = b, a ^ (_mix32((b ^ r) & np.uint64(0xFFFFFFFF)) & low)
        x[todo] = a << shift | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _shards(seed: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shard, count = _binomial_split(r["sidx"], r["slots"], r["shards"], seed)
                yield pa.RecordBatch.from_pydict({
                    "sidx": np.full(len(shard), r["sidx"], np.int32), "n_blocks": np.full(len(shard), r["n_blocks"], np.int64),
                    "shard": shard, "n": count, "at": np.cumsum(count) - count})
    return run


def _slots(seed: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                slot = np.arange(r["at"], r["at"] + r["n"])
                pass_, index = slot // r["n_blocks"], slot % r["n_blocks"]
                block = np.empty(len(slot), np.int64)
                for p in np.unique(pass_):
                    mine = pass_ == p
                    block[mine] = permuted(index[mine], r["n_blocks"], hash_key(seed, r["sidx"], int(p)))
                yield pa.RecordBatch.from_pydict({
                    "sidx": np.full(len(slot), r["sidx"], np.int32), "block": block, "pass": pass_.astype(np.int32),
                    "shard": np.full(len(slot), r["shard"], np.int64), "slot": slot})
    return run


def hash_key(seed: int, sidx: int, pass_: int) -> int:
    return (seed * 1_000_003 + sidx) * 1_000_003 + pass_


def pieces(rows: DataFrame, plan: DataFrame, block: int = BLOCK, chunk_words: int = CHUNK_WORDS):
    """Pack documents into blocks: (uid, doc_id, h, size, sidx, source_size, target,
    block, lo, len), one row per document and block (block null for no words), and
    (sidx, n_blocks)."""
    plan = plan.withColumn("chunks", F.ceil(F.col("source_size") / chunk_words))
    dealt = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "doc_id", "h", "size", "sidx", "source_size", "target", "r.source",
        F.pmod(F.xxhash64("doc_id", "h"), F.greatest("chunks", F.lit(1))).alias("chunk"))
    sizes = dealt.groupBy("sidx", "chunk").agg(F.sum("size").alias("words"))
    sizes = sizes.withColumn("n", F.ceil(F.col("words") / block))
    before = Window.partitionBy("sidx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("sidx", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    totals = sizes.groupBy("sidx").agg(F.sum("n").alias("n_blocks"))
    inside = Window.partitionBy("sidx", "chunk").orderBy("doc_id", "h", "size")
    placed = dealt.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "uid", F.row_number().over(inside)).join(firsts, ["sidx", "chunk"])
    start = F.col("end") - F.col("size")
    span = F.when(F.col("size") > 0, F.sequence(F.floor(start / block), F.floor((F.col("end") - 1) / block)))
    cut = placed.withColumn("b", F.explode_outer(span))
    lo = F.greatest(start, F.col("b") * block)
    return cut.select("uid", "chunk", "doc_id", "h", "size", "sidx", "source", "source_size", "target",
                      (F.col("first") + F.col("b")).alias("block"), (lo - start).alias("lo"),
                      (F.least("end", (F.col("b") + 1) * block) - lo).alias("len")), totals


def draws(plan: DataFrame, totals: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS, limit: int = LIMIT) -> DataFrame:
    """(sidx, block, pass, shard, slot): the slots of all shards and their blocks."""
    slots = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), F.col("n_blocks") * limit).cast("long")
    counted = plan.join(totals, "sidx").where("source_size > 0").withColumn("slots", slots)
    everything = counted.agg(F.sum("slots").alias("all"))
    shards = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("all") / shard_slots, F.lit(1.0))))).cast("long")
    wanted = counted.join(F.broadcast(everything)).select("sidx", "n_blocks", "slots", shards.alias("shards"))
    dealt = wanted.mapInArrow(_shards(seed), "sidx int, n_blocks long, shard long, n long, at long")
    # with a number, or adaptive execution would merge the few small shard rows into one task that makes all slots
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "sidx", "shard").mapInArrow(_slots(seed), "sidx int, block long, pass int, shard long, slot long")


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken."""
    rows = sized(docs)
    plan = targets(rows)
    packed, totals = pieces(rows, plan)
    times = draws(plan, totals, seed).groupBy("sidx", "block").agg(F.count("*").alias("times"))
    taken = packed.join(times.hint("merge"), ["sidx", "block"], "left")
    return taken.groupBy("sidx", "chunk", "uid", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.coalesce(F.col("len") * F.col("times"), F.lit(0))).alias("taken")).select(
        "doc_id", "size", "source_size", "target", "taken")


def _cutter(text_col: str, picks: str):
    """Replace each text by the words of its picked spans (original text between)."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            spans_of = batch.column(batch.schema.get_field_index(picks))
            for i, j in B.slices(batch.column(at), SLICE_BYTES):
                data, offs = B.buffers(batch.column(at).slice(i, j - i))
                s, e = B.spans(data, offs, B.SPACED)
                rows = B.row_of(s, offs)
                raw, texts = data.tobytes(), []
                for r, spans in enumerate(spans_of.slice(i, j - i).to_pylist()):
                    parts, run_ = [], None
                    for lo, n in sorted((x["lo"], x["len"]) for x in spans):
                        if run_ and run_[1] == lo:
                            run_[1] = lo + n
                        else:
                            run_ = [lo, lo + n]
                            parts.append(run_)
                    k = int(rows[r])
                    whole = len(parts) == 1 and parts[0] == [0, int(rows[r + 1]) - k]
                    texts.append(raw[offs[r]:offs[r + 1]].decode() if whole else
                                 "\n".join(raw[s[k + a]:e[k + b - 1]].decode() for a, b in parts))
                part = batch.slice(i, j - i)
                columns = [pa.array(texts, pa.string()) if n == text_col else c
                           for n, c in zip(part.schema.names, part.columns) if n != picks]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n in part.schema.names if n != picks])
    return run


def mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          n_chars_col: str = "n_chars") -> DataFrame:
    """The mixed documents: for each document and pass, the words of its blocks drawn
    in that pass, with all other columns (``n_chars`` counts the new text).

    Equal rows are mixed one by one; they differ in nothing but what is drawn.
    """
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = sized(docs, id_col, text_col, source_col, key)
    plan = targets(rows)
    packed, totals = pieces(rows, plan)
    picked = packed.join(draws(plan, totals, seed).select("sidx", "block", "pass").hint("merge"), ["sidx", "block"]).groupBy(
        "sidx", "chunk", "uid", "doc_id", "h", "pass").agg(F.collect_list(F.struct("lo", "len")).alias("picks"))
    id_, h, p = (fresh(docs.columns, x) for x in ("pick_id", "pick_h", "picks"))
    picked = picked.select(F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("picks").alias(p))
    once = docs.withColumn(fresh([*docs.columns, id_, h, p], "row_h"), key)
    row_h = once.columns[-1]
    once = once.withColumn(id_, F.col(id_col).cast("long")).dropDuplicates([id_, row_h])
    found = once.join(picked.withColumnRenamed(id_, id_ + "_"), F.col(id_).eqNullSafe(F.col(id_ + "_")) & (F.col(row_h) == F.col(h)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    out = found.select(*kept, p).mapInArrow(_cutter(text_col, p), schema)
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.char_length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out
