"""Entities with similar member sets (advertisers by their cookies), all at once.

1. ``ordinary_shared``: of members with at most ``MOST_WITH_MEMBER`` entities all pairs are
   counted.  A membership meets that many others at most, so the pairs grow with the memberships.
   They are counted in turns, each for a part of the lesser entities, so that a turn sends
   ``PAIRS_A_MEMBERSHIP`` pairs a membership at most.  Pairs are added up before they are sent
   and travel as one list per entity; only those that can reach ``least`` come back.
2. Members of more entities (hubs) are counted for chosen pairs only: those of step 1 that
   their hubs could still lift to ``least``, and MinHash candidates.  Two entities that share
   hubs alone can be that similar only if hubs make up ``least`` of each, so only such
   entities get signatures.
3. ``signatures``: one-permutation MinHash.  A member's hash gives a bin and a value; an
   entity keeps the least value of each bin.  That is one ``min`` aggregation over the
   raw facts: it combines map-side, needs no distinct step, and signatures of parts
   merge by another ``min``.  Empty bins take the next filled bin's value, changed by
   the distance (rotation densification).
4. ``candidate_pairs``: bands of bins are bucket keys.  A bucket of more than
   ``most_in_bucket`` entities is not paired: its entities go to the bucket of this band
   and the next one together, of the next three, and so on; entities alike in all bands
   are dealt by a salt into buckets of that size.  So pairs grow linearly with the entities.
5. ``shared_members`` checks pairs exactly, from the smaller set's members only.

The result has exact Jaccard values, and all pairs that share a member of few entities.
What can be missed is a pair that shares hubs alone: of similarity J it shares no band with
probability ``(1 - J ** rows) ** (bins / rows)``; with the defaults 8e-6 for J = 0.3.  Beyond
oversized buckets, such pairs that agree in few bands may be missed for those that agree
in more, which are the more similar ones.

Joins with exploded rows carry a merge hint: Spark takes an exploded table to be as small as
the file below it, and would send millions of rows through the driver as a broadcast.  Tables
joined as they were stored (hubs, entities) carry none: their size is the file's.

Every step is stored, and its shuffle files go when it stands: the disk holds one step's rows
and the tables still needed, whatever the number of turns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import removed, shuffles_go, stored

BINS = 256
ROWS = 2
MOST_IN_BUCKET = 64
SALTS = 32
MOST_WITH_MEMBER = 256
PAIRS_A_MEMBERSHIP = 4
PAIRS_A_CALL = 1 << 22
MEMBERS_A_TASK = 1 << 16


def signatures(facts: DataFrame, entity: str, member: str, bins: int = BINS) -> DataFrame:
    """(entity, bin, value): least hash a bin.  Mergeable: the union of two facts' signatures,
    grouped again by (entity, bin) with ``min``, is the signature of both."""
    h = F.xxhash64(member)
    return (facts.where(F.col(entity).isNotNull() & F.col(member).isNotNull())
            .groupBy(F.col(entity).alias("entity"), F.pmod(h, F.lit(bins)).cast("int").alias("bin"))
            .agg(F.min(F.xxhash64(F.lit(1), F.col(member))).alias("value")))


def densified(sigs: DataFrame, bins: int = BINS) -> DataFrame:
    """(entity, signature): arrays of ``bins`` values without gaps (``bins`` rows a group)."""
    found = sigs.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("m"))
    filled = found.select("entity", "m", F.array_sort(F.map_keys("m")).alias("at"))
    # for an empty bin the next filled one, from the first again after the last
    return filled.select("entity", F.expr(f"""
        transform(sequence(0, {bins - 1}), j -> if(map_contains_key(m, j), element_at(m, j),
          xxhash64(pmod(coalesce(get(filter(at, b -> b > j), 0), at[0]) - j, {bins}),
                   element_at(m, coalesce(get(filter(at, b -> b > j), 0), at[0])))))""").alias("signature"))


def _bucket_keys(sigs: DataFrame, rows: int, bins: int) -> DataFrame:
    """(entity, band, depth, key): the key of ``depth`` bands from ``band`` on, depth 1, 2, 4, .. all."""
    bands = bins // rows
    depths = [1 << k for k in range(bands.bit_length()) if 1 << k <= bands]
    hashes = F.expr(f"transform(sequence(0, {bands - 1}), j -> xxhash64(slice(signature, j * {rows} + 1, {rows})))")
    twice = sigs.select("entity", F.concat(hashes, hashes).alias("bands"))
    keys = F.array(*(F.struct(F.lit(d).alias("depth"), F.xxhash64(F.slice("bands", F.col("band") + 1, F.lit(d))).alias("key")) for d in depths))
    return (twice.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
            .select("entity", "band", F.explode(keys).alias("k")).select("entity", "band", "k.depth", "k.key"))


def candidate_pairs(sigs: DataFrame, rows: int = ROWS, bins: int = BINS, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """Distinct (a, b), a < b, of entities that share a bucket."""
    keys = _bucket_keys(sigs, rows, bins)
    sizes = keys.groupBy("band", "depth", "key").agg(F.count(F.lit(1)).alias("n"))
    deepest = 1 << ((bins // rows).bit_length() - 1)
    sized = keys.join(sizes.hint("merge"), ["band", "depth", "key"])
    # the shallowest bucket that is small enough; entities of one such bucket choose it alike
    fits = F.when((F.col("n") <= most_in_bucket) | (F.col("depth") == deepest),
                  F.struct("depth", "key", "n"))
    chosen = sized.groupBy("entity", "band").agg(F.min(fits).alias("c"))
    parts = F.ceil(F.col("c.n") / most_in_bucket)
    chosen = chosen.where(F.col("c.n") > 1).select(
        "entity", "band", "c.depth", "c.key",
        F.pmod(F.xxhash64("entity", "band"), F.greatest(parts, F.lit(1))).alias("part"))
    bucket = ["band", "depth", "key", "part"]
    other = chosen.select(*bucket, F.col("entity").alias("b"))
    pairs = chosen.withColumnRenamed("entity", "a").join(other.hint("merge"), bucket)
    return pairs.where(F.col("a") < F.col("b")).select("a", "b").distinct()


def _with_sizes(pairs: DataFrame, sizes: DataFrame, names=("n",)) -> DataFrame:
    """``pairs`` with the columns ``names`` of both entities, as na and nb for n."""
    for side in ("a", "b"):
        one = sizes.select(F.col("entity").alias(side), *(F.col(n).alias(n + side) for n in names))
        pairs = pairs.join(one.hint("merge"), side)
    return pairs


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df``, stored, with a column id: 0, 1, 2, .. in this order."""
    at = F.monotonically_increasing_id()        # the task, and the row in it from bit 33 down
    rows, place = stored(df.orderBy(*order).withColumn("at", at), "ordered", False)
    tasks = rows.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("task")) - F.col("rows")        # one row a task
    found = rows.withColumn("task", F.shiftright("at", 33)).join(F.broadcast(tasks.select("task", before.alias("before"))), "task")
    ids, _ = stored(found.withColumn("id", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).select(*df.columns, "id"), "numbered", False)
    removed(df.sparkSession, place)
    return ids


def _starts(*columns) -> np.ndarray:
    """The rows at which one of the columns, Arrow or numpy, differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1] if isinstance(c, np.ndarray) else pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _listed(batches):
    """One list of (entity, least, tasks) per member with several, of rows sorted by member."""
    held = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        if not rows.num_rows:
            continue
        starts = _starts(rows["member"].chunk(0))
        held = rows.slice(starts[-1]).to_batches()          # the last member may go on
        yield from _several(rows.slice(0, starts[-1]), starts[:-1])
    if held:
        yield from _several(pa.Table.from_batches(held), np.zeros(1, np.int64))


def _several(rows: pa.Table, starts: np.ndarray):
    several = np.diff(np.append(starts, rows.num_rows)) > 1
    if several.any():
        kept = rows.filter(pa.array(np.repeat(several, np.diff(np.append(starts, rows.num_rows))))).combine_chunks()
        length = np.diff(np.append(starts, rows.num_rows))[several]
        one = pa.StructArray.from_arrays([kept[c].chunk(0) for c in ("entity", "least", "tasks")], ["entity", "least", "tasks"])
        yield pa.RecordBatch.from_arrays([_lists(np.cumsum(length) - length, one)], ["of"])


def _pairs_in(turn: int, turns: int) -> Callable:
    """Pairs of each list's entities, the first one of this turn, added up by batch:
    (a, task, least, others, counts) with a's others and what it shares with each."""
    def rows(batches):
        for batch in batches:
            lists = batch.column("of")
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            if not length.sum():
                continue
            entity, least, tasks = lists.flatten().flatten()
            named = entity.dictionary_encode()
            names, code = named.dictionary, named.indices.to_numpy().astype(np.int64)
            hashes = pd.util.hash_array(names.to_numpy(zero_copy_only=False))
            of = np.empty((2, len(names)), np.int64)        # least and tasks of an entity
            of[:, code] = least.to_numpy(), tasks.to_numpy()
            later = np.repeat(np.cumsum(length), length) - np.arange(len(code)) - 1
            later[(hashes % np.uint64(turns) != turn)[code]] = 0
            upto, bits = np.cumsum(later), len(names).bit_length()
            cuts = np.searchsorted(upto, np.arange(PAIRS_A_CALL, upto[-1], PAIRS_A_CALL))
            for lo, hi in pairwise(np.unique([0, *cuts, len(code)])):
                n = later[lo:hi]
                at = np.repeat(np.arange(lo, hi), n)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                keys, counts = np.unique(code[at] << bits | code[at + 1 + nth], return_counts=True)
                if not len(keys):
                    continue
                a, b = keys >> bits, keys & (1 << bits) - 1
                task = np.zeros(len(a), np.int64)
                if of[1].max() > 1:
                    task = (hashes[b] // np.uint64(turns) % of[1].astype(np.uint64)[a]).astype(np.int64)
                    by = np.lexsort((task, a))
                    a, b, counts, task = a[by], b[by], counts[by], task[by]
                starts = _starts(a, task)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(a[starts])), pa.array(task[starts], pa.int32()), pa.array(of[0][a[starts]]),
                     _lists(starts, names.take(pa.array(b))), _lists(starts, pa.array(counts, pa.int32()))],
                    ["a", "task", "least", "others", "counts"])
    return rows


def _added(rows: pa.Table) -> pa.RecordBatch:
    """(a, b, shared) of rows that are sorted by a and task, from ``least`` on."""
    a, task, least, others, counts = (c.chunk(0) for c in rows.combine_chunks().columns)
    starts = _starts(a, task)
    length = pc.list_value_length(others).to_numpy(zero_copy_only=False)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(a))))
    named = others.flatten().dictionary_encode()
    bits = len(named.dictionary).bit_length()
    keys = np.repeat(group, length) << bits | named.indices.to_numpy()
    by = np.argsort(keys)
    keys = keys[by]
    first = _starts(keys)
    shared = np.add.reduceat(counts.flatten().to_numpy()[by], first, dtype=np.int64)
    group = keys[first] >> bits
    kept = shared >= least.to_numpy()[starts][group]
    return pa.RecordBatch.from_arrays(
        [a.take(pa.array(starts[group[kept]])), named.dictionary.take(pa.array(keys[first][kept] & (1 << bits) - 1)), pa.array(shared[kept])],
        ["a", "b", "shared"])


def _summed(batches):
    """``_added`` for whole (a, task) of about ``PAIRS_A_CALL`` pairs together."""
    held, pairs, due = [], 0, PAIRS_A_CALL
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            pairs += len(batch.column("others").flatten())
        if pairs >= due:
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = int(_starts(rows["a"].chunk(0), rows["task"].chunk(0))[-1])
            if cut:
                yield _added(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            pairs = sum(len(b.column("others").flatten()) for b in held)
            due = max(PAIRS_A_CALL, 2 * pairs)
    if held:
        yield _added(pa.Table.from_batches(held))


def ordinary_shared(members: DataFrame) -> DataFrame:
    """(a, b, shared) of all pairs that share one of ``members``, distinct (entity, member), a the lesser.

    ``members`` may say of its entities from which count a pair of theirs matters (``least``,
    asked of the lesser one) and over how many tasks an entity's pairs are dealt (``tasks``)."""
    spark = members.sparkSession
    for name in {"least", "tasks"} - set(members.columns):
        members = members.withColumn(name, F.lit(1))
    kind = members.schema["entity"].dataType
    members = members.select("member", "entity", F.col("least").cast("long"), F.col("tasks").cast("int"))
    listed = T.StructType([T.StructField("of", T.ArrayType(members.drop("member").schema))])
    lists, lists_at = stored(members.repartition("member").sortWithinPartitions("member", "entity").mapInArrow(_listed, listed), "lists", False)
    n = F.size("of").cast("long")
    with shuffles_go(spark):
        rows, pairs = lists.agg(F.sum(n), F.sum(n * (n - 1) / 2)).first()
    turns = int(-(-(pairs or 0) // (PAIRS_A_MEMBERSHIP * (rows or 1)))) or 1
    sent = T.StructType([T.StructField("a", kind), T.StructField("task", T.IntegerType()), T.StructField("least", T.LongType()),
                         T.StructField("others", T.ArrayType(kind)), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    counted = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("shared", T.LongType())])
    found = []
    for turn in range(turns):
        some = lists.mapInArrow(_pairs_in(turn, turns), sent).repartition("a", "task").sortWithinPartitions("a", "task")
        found.append(stored(some.mapInArrow(_summed, counted), "shared", False)[0])
    removed(spark, lists_at)
    return reduce(DataFrame.union, found)


def shared_members(pairs: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) of candidate pairs; ``members`` is distinct (entity, member).

    The smaller set's members are looked up in the other's; both steps join on the
    entity and a salt or member, so a hub entity is spread over ``SALTS`` tasks at least."""
    p = _with_sizes(pairs, sizes)
    first = F.col("na") <= F.col("nb")
    p = p.select("a", "b", "na", "nb", F.when(first, F.col("a")).otherwise(F.col("b")).alias("small"),
                 F.when(first, F.col("b")).otherwise(F.col("a")).alias("large"))
    salt = F.pmod(F.xxhash64(F.lit(2), F.col("member")), F.lit(SALTS)).cast("int")
    dealt = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    small = members.select(F.col("entity").alias("small"), "member", salt.alias("salt"))
    large = members.select(F.col("entity").alias("large"), "member")
    hits = dealt.join(small.hint("merge"), ["small", "salt"]).join(large.hint("merge"), ["large", "member"], "left_semi")
    return hits.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))


def similar_entities(facts: DataFrame, entity: str, member: str, top: int = 10, least: float = 0.3,
                     bins: int = BINS, rows: int = ROWS, most_in_bucket: int = MOST_IN_BUCKET,
                     most_with_member: int = MOST_WITH_MEMBER) -> DataFrame:
    """For every entity its ``top`` most similar ones of Jaccard ``least`` or more: target_id, rank,
    entity_id, shared_members, members, target_members, jaccard (6 digits).

    Ties by entity id.  Rows with a null entity or member count nowhere.
    """
    spark = facts.sparkSession
    # the sets are written once: hubs, sizes and memberships read them
    raw, raw_at = stored(facts.select(F.col(entity).alias("entity"), F.col(member).alias("member")).where(
        F.col("entity").isNotNull() & F.col("member").isNotNull()).distinct(), "members", False)
    hubs, hubs_at = stored(raw.groupBy("member").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") > most_with_member)
                           .select("member", F.lit(True).alias("hub")), "hubs", False)
    marked = raw.join(hubs, "member", "left")
    # numbers for names, the lesser sets first: the rows of the counts are shorter, four bytes if they can
    ids = numbered(marked.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count("hub").alias("h")), "n", "entity")
    with shuffles_go(spark):
        ids = ids.withColumn("id", F.col("id").cast("int")) if ids.count() < 1 << 31 else ids
    members, members_at = stored(marked.join(ids, "entity").select(F.col("id").alias("entity"), "member", "hub", "n", "h"), "memberships", False)
    removed(spark, raw_at)
    removed(spark, hubs_at)
    sizes = ids.select(F.col("id").alias("entity"), "n", "h")
    # two sets of n members or more are that similar from 2 * least * n / (1 + least) shared ones on; all hubs may be
    needed = F.ceil(2 * least / (1 + least) * (1 - 1e-9) * F.col("n")) - F.col("h")
    ordinary = _with_sizes(ordinary_shared(members.where("hub is null").select(
        "entity", "member", needed.alias("least"), F.ceil(F.col("n") / MEMBERS_A_TASK).alias("tasks"))), sizes, ("n", "h"))
    most = F.col("shared") + F.least("ha", "hb")       # of the bound: all hubs of the lesser one
    ordinary, _ = stored(ordinary.where(most / (F.col("na") + F.col("nb") - most) >= least), "ordinary", False)
    of_heavy = members.where((F.col("h") > 0) & (F.col("h") >= F.lit(least) * F.col("n"))).select("entity", "member")
    sigs, sigs_at = stored(densified(signatures(of_heavy, "entity", "member", bins), bins), "signatures", False)
    pairs, _ = stored(candidate_pairs(sigs, rows, bins, most_in_bucket).union(
        ordinary.where(F.least("ha", "hb") > 0).select("a", "b")).distinct(), "candidates", False)
    removed(spark, sigs_at)
    hubs, _ = stored(members.where("hub").select("entity", "member"), "hub-members", False)
    removed(spark, members_at)
    found = ordinary.select("a", "b", "na", "nb", "shared").union(shared_members(pairs, hubs, sizes)).groupBy("a", "b", "na", "nb").agg(
        F.sum("shared").alias("shared"))
    union = F.col("na") + F.col("nb") - F.col("shared")
    found = found.withColumn("j", F.col("shared") / union).where(F.col("j") >= least)
    for side in ("a", "b"):
        found = found.join(ids.select(F.col("id").alias(side), F.col("entity").alias(f"name_{side}")).hint("merge"), side).drop(side)
    found = found.withColumnsRenamed({"name_a": "a", "name_b": "b"})
    sides = F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("b").alias("e"), F.col("nb").alias("n"), F.col("na").alias("tn")),
                              F.struct(F.col("b").alias("t"), F.col("a").alias("e"), F.col("na").alias("n"), F.col("nb").alias("tn"))))
    both = found.select("shared", "j", sides.alias("s"))
    both = both.select(F.col("s.t").alias("target_id"), F.col("s.e").alias("entity_id"), F.col("shared").alias("shared_members"),
                       F.col("s.n").alias("members"), F.col("s.tn").alias("target_members"), "j")
    w = Window.partitionBy("target_id").orderBy(F.col("j").desc(), "entity_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(
        "target_id", "rank", "entity_id", "shared_members", "members", "target_members", F.round("j", 6).alias("jaccard"))
