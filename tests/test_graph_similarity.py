"""Connected components, linked cohorts and all-pairs similarity against brute force."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from clickpath.operators import cohorts, similarity
from clickpath.operators.graph import connected_components
from tests.conftest import IMP_SCHEMA


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {x: find(x) for x in root}


def found(spark, edges, schema="a string, b string"):
    return {r.node: r.component for r in connected_components(spark.createDataFrame(edges, schema), "a", "b").collect()}


def test_components_of_chains_hubs_and_random_graphs(spark):
    rng = random.Random(4)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    rng.shuffle(chain)
    hub = [("hub", f"h{i:05d}") for i in range(20_000)]
    loose = [(f"r{rng.randrange(400)}", f"r{rng.randrange(400)}") for _ in range(300)]
    edges = chain + hub + loose + loose[:20] + [("alone", "alone"), ("hub", "hub"), (None, "x"), ("y", None)]
    rng.shuffle(edges)
    want = union_find([e for e in edges if None not in e])
    assert found(spark, edges) == want
    numbers = [(rng.randrange(500), rng.randrange(500)) for _ in range(350)]
    assert found(spark, numbers, "a long, b long") == union_find(numbers)
    assert found(spark, [], "a string, b string") == {}


def test_linked_cohorts_and_a_hub_publisher(spark):
    """A publisher that everyone visits links nobody; its rows count all the same."""
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        rows.append(("PID_HUB", "A", f"C{i:02d}", t, 50))
        own = f"PID_{i // 6}" if i < 30 else None             # five rings of six, the rest without a link
        if own:
            rows.append((own, "A", f"C{i:02d}", t, 30))
    rows += [("PID_0", "A", "C06", t, 30), (None, "A", "C01", t, 1)]     # a bridge joins the first two rings
    imps = spark.createDataFrame([r for r in rows if r[0]], IMP_SCHEMA)
    suspects = imps.select("cookie_id").distinct()
    got = {r.cookie_id: r for r in cohorts.linked_cohort_members(imps, suspects).collect()}
    assert len(got) == 60
    assert {got[f"C{i:02d}"].cohort_id for i in range(12)} == {"C00"}
    assert all(got[f"C{i:02d}"].cohort_id == f"C{i // 6 * 6:02d}" for i in range(12, 30))
    assert all(got[f"C{i:02d}"].cohort_id == f"C{i:02d}" and got[f"C{i:02d}"].linked_publishers == 0 for i in range(30, 60))
    assert (got["C06"].linked_publishers, got["C06"].impressions, got["C06"].linked_impressions, got["C06"].linked_share) == (2, 110, 60, 0.545455)
    assert sum(r.impressions for r in got.values()) == sum(r[4] for r in rows if r[0])
    groups = {r.cohort_id: r for r in cohorts.linked_cohorts(imps, suspects).collect()}
    assert (groups["C00"].cookies, groups["C00"].publishers, groups["C12"].publishers, groups["C59"].publishers) == (12, 2, 1, 0)
    assert sum(r.cookies for r in groups.values()) == 60


def exact_pairs(sets, least):
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        j = shared / len(sets[a] | sets[b])
        if j >= least:
            out[a, b] = (shared, j)
    return out


def member_sets(rng, groups=30, size=6):
    sets = {}
    for g in range(groups):
        base = [f"{g}-{i}" for i in range(rng.randint(3, 300))]
        for k in range(size):
            keep = rng.choice([0.3, 0.6, 0.9, 1.0])
            s = {x for x in base if rng.random() < keep} | {f"own-{g}-{k}-{i}" for i in range(rng.randint(0, 30))}
            sets[f"E{g:02d}{k}"] = s or {base[0]}
    return sets


def test_similar_entities_recall_and_exact_figures(spark):
    rng = random.Random(8)
    sets = member_sets(rng)
    rows = [(e, m) for e, s in sets.items() for m in s]
    rows += rows[:500] + [(None, "x"), ("E000", None)]
    facts = spark.createDataFrame(rows, "e string, m string").repartition(7)
    want = exact_pairs(sets, 0.3)
    got = similarity.similar_entities(facts, "e", "m", top=1000).collect()
    pairs = {tuple(sorted((r.target_id, r.entity_id))) for r in got}
    assert pairs <= set(want) and len(pairs) >= 0.99 * len(want) and len(got) == 2 * len(pairs)
    for r in got:
        shared, j = want[tuple(sorted((r.target_id, r.entity_id)))]
        assert (r.shared_members, r.members, r.target_members) == (shared, len(sets[r.entity_id]), len(sets[r.target_id]))
        assert abs(r.jaccard - j) < 1e-6
    top = similarity.similar_entities(facts, "e", "m", top=2).collect()
    best = {}
    for (a, b), (_, j) in want.items():
        best.setdefault(a, []).append((-j, b))
        best.setdefault(b, []).append((-j, a))
    right = sum((r.entity_id == sorted(best[r.target_id])[r.rank - 1][1]) for r in top)
    assert right >= 0.99 * sum(min(2, len(v)) for v in best.values())
    assert similarity.similar_entities(facts.limit(0), "e", "m").count() == 0


def test_oversized_buckets_pair_linearly(spark):
    """Many equal and many nearly equal sets: pairs stay below entities x bucket size x bands."""
    rng = random.Random(1)
    base = [f"m{i}" for i in range(40)]
    rows = [(f"S{i:04d}", m) for i in range(600) for m in base]
    rows += [(f"T{i:04d}", m) for i in range(300) for m in base if rng.random() < 0.9]
    facts = spark.createDataFrame(rows, "e string, m string")
    sigs = similarity.densified(similarity.signatures(facts, "e", "m", 32), 32)
    counts = []
    for n in (300, 600):
        some = sigs.where(f"entity < 'S{n:04d}' or (entity like 'T%' and entity < 'T{n // 2:04d}')")
        counts.append(similarity.candidate_pairs(some, 2, 32, 8).count())
    assert counts[1] < 2.6 * counts[0] and counts[1] < 900 * 8 * 16
    got = similarity.similar_entities(facts, "e", "m", top=3, bins=32, most_in_bucket=8).groupBy("target_id").count().collect()
    assert sum(r["count"] == 3 for r in got) > 0.95 * 900


def test_signatures_merge(spark):
    rng = random.Random(2)
    facts = spark.createDataFrame([(f"E{rng.randrange(5)}", f"m{rng.randrange(300)}") for _ in range(2000)], "e string, m string")
    a, b = facts.randomSplit([0.5, 0.5], 3)
    whole = similarity.signatures(facts, "e", "m", 64)
    parts = similarity.signatures(a, "e", "m", 64).union(similarity.signatures(b, "e", "m", 64)).groupBy("entity", "bin").min("value")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(whole) == key(parts)
    assert all(len(r.signature) == 64 for r in similarity.densified(whole, 64).collect())


def test_hub_members_and_ordinary_ones_give_all_pairs(spark):
    """Whichever members count as hubs, the pairs and their figures are those of brute force."""
    rng = random.Random(5)
    groups = [[f"m{rng.randrange(400)}" for _ in range(40)] for _ in range(8)]
    hubs = [f"hub{h}" for h in range(12)]
    sets = {f"E{i:02d}": {m for m in groups[i % 8] if rng.random() < 0.8} | {h for h in hubs if rng.random() < 0.7} for i in range(60)}
    sets |= {f"H{i:02d}": {h for h in hubs if rng.random() < 0.8} | {f"own{i}"} for i in range(15)}     # alike by hubs alone
    want = {(a, b, len(x & y), len(y), len(x)) for a, x in sets.items() for b, y in sets.items()
            if a != b and len(x & y) / len(x | y) >= 0.3}
    facts = spark.createDataFrame([(e, m) for e, s in sets.items() for m in s], "e string, m string")
    for most in (0, 10, 1000):
        got = similarity.similar_entities(facts, "e", "m", top=1000, rows=1, most_with_member=most).collect()
        assert {(r.target_id, r.entity_id, r.shared_members, r.members, r.target_members) for r in got} == want and len(got) == len(want)


def test_no_exploded_table_is_broadcast(spark, scratch):
    """A stored table of few bytes stands for millions of rows once its bands or salts are exploded."""
    sigs = spark.createDataFrame([("a", [1] * 8), ("b", [1] * 8)], "entity string, signature array<bigint>")
    sigs.write.parquet(f"{scratch}/sigs")
    pairs = similarity.candidate_pairs(spark.read.parquet(f"{scratch}/sigs"), 1, 8)
    spark.createDataFrame([("a", "x"), ("b", "x")], "entity string, member string").write.parquet(f"{scratch}/members")
    members = spark.read.parquet(f"{scratch}/members")
    pairs.write.parquet(f"{scratch}/pairs")
    shared = similarity.shared_members(spark.read.parquet(f"{scratch}/pairs"), members, members.groupBy("entity").agg(F.count("*").alias("n")))
    for df in (pairs, shared, similarity.ordinary_shared(members)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in shared.collect()] == [("a", "b", 1, 1, 1)]


def shared_counts(sets):
    """{(a, b): shared} by brute force, a < b."""
    counts = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    return {p: n for p, n in counts.items() if n}


def test_pairs_counted_in_turns_and_dealt_over_tasks(spark, monkeypatch):
    """Turns, pieces and tasks change nothing; ``least`` of the lesser entity leaves out the lower counts."""
    monkeypatch.setattr(similarity, "PAIRS_A_MEMBERSHIP", 1)
    monkeypatch.setattr(similarity, "PAIRS_A_CALL", 40)
    rng = random.Random(11)
    sets = {e: {rng.randrange(300) for _ in range(rng.randrange(1, 40))} for e in range(70)}
    want = shared_counts(sets)
    rows = [(e, f"m{m}", 1 + e % 3, 1 + e % 4) for e, s in sets.items() for m in s]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "entity int, member string, least long, tasks int").repartition(5)
    found = [tuple(r) for r in similarity.ordinary_shared(frame.select("entity", "member", "tasks")).collect()]
    assert len(found) == len(want) and {(a, b): n for a, b, n in found} == want
    found = [tuple(r) for r in similarity.ordinary_shared(frame).collect()]
    assert len(found) == len(set(found)) and {(a, b): n for a, b, n in found} == {(a, b): n for (a, b), n in want.items() if n >= 1 + a % 3}
    names = frame.select(F.format_string("E%03d", "entity").alias("entity"), "member")
    found = similarity.ordinary_shared(names).collect()
    assert {(int(r.a[1:]), int(r.b[1:])): r.shared for r in found} == want and len(found) == len(want)
    assert similarity.ordinary_shared(names.limit(0)).collect() == []


SENT = pa.schema([("a", pa.int32()), ("task", pa.int32()), ("least", pa.int64()), ("others", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def test_pairs_are_added_up_before_they_are_sent(monkeypatch):
    """Lists of the same entities give each pair once a batch, in every turn other first entities; sums go on over batches."""
    kind = pa.list_(pa.struct([("entity", pa.int32()), ("least", pa.int64()), ("tasks", pa.int32())]))
    lists = [[{"entity": e, "least": 2, "tasks": 1 + 2 * (e == 0)} for e in of] for of in [range(6)] * 200 + [(0, 9), (7, 8), (7, 8)]]
    batches = [pa.RecordBatch.from_arrays([pa.array(some, kind)], ["of"]) for some in (lists[:100], lists[100:], [])]
    want = {(a, b): 200 for a, b in itertools.combinations(range(6), 2)} | {(7, 8): 2}
    for call in (1 << 22, 700, 3):
        monkeypatch.setattr(similarity, "PAIRS_A_CALL", call)
        turns = [pa.Table.from_batches(similarity._pairs_in(k, 3)(batches), SENT) for k in range(3)]
        seen = [set(t["a"].to_pylist()) for t in turns]
        assert sum(map(len, seen)) == len(set().union(*seen))
        if call > 700:
            assert sum(len(x) for t in turns for x in t["others"].to_pylist()) == 2 * 15 + 2
        found = Counter()
        for t in turns:
            for b in similarity._summed(t.sort_by([("a", "ascending"), ("task", "ascending")]).to_batches(max_chunksize=2)):
                found.update({(a, b): n for a, b, n in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        assert found == want



def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString(" ").split() if "shuffle_" in f}


def test_shuffle_files_go_when_a_step_stands(spark):
    """Before the result is read, no step's shuffle files are left, and the session's setting is as it was."""
    rng = random.Random(3)
    facts = spark.createDataFrame([(f"E{rng.randrange(40)}", f"m{rng.randrange(500)}") for _ in range(4000)], "e string, m string")
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    similar = similarity.similar_entities(facts, "e", "m", most_with_member=20)
    for _ in range(40):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert similar.count() >= 0
