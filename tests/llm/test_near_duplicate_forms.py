"""The near-duplicate operator on filled-in forms: many texts that share most of their
shingles, some similar enough and some not."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clickpath.llm import neardup
from clickpath.llm.common import text_digest


def forms(n: int, fields: int, values: int, length: int = 150, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    frame = [f"f{i}" for i in range(length)]
    places = [(i + 1) * length // (fields + 1) for i in range(fields)]
    out = []
    for _ in range(n):
        text = list(frame)
        for p in places:
            text[p] = f"v{p}x{rng.randrange(values)}"
        out.append(" ".join(text))
    return out


def brute_force(texts: list[str]) -> list[int]:
    """The least index of each text's class, by comparing all pairs."""
    bags = []
    for t in texts:
        w = t.lower().split()
        bags.append(Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j):
                both = sum((bags[i] & bags[j]).values())
                if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return [root(i) for i in range(len(texts))]


def mixture() -> list[str]:
    rng = random.Random(9)
    texts = forms(60, 5, 6) + forms(60, 8, 3, seed=4) + forms(40, 12, 4, 90, seed=5)
    for t in texts[:30]:  # other lengths: the size filter and the two prefixes differ
        w = t.split()
        at = rng.randrange(len(w))
        texts.append(" ".join(w[:at] + w[at + rng.randrange(1, 40):]))
        texts.append(" ".join(w + w[:rng.randrange(1, 40)]))
    return sorted(set(texts))


@pytest.mark.parametrize("turns, easy, split", [(0, 0, 7), (2, 0, 3)])
def test_open_texts_are_resolved_exactly(spark, monkeypatch, turns, easy, split):
    """All texts open and no class known: what ``resolve`` alone finds is all there is."""
    monkeypatch.setattr(neardup, "TURNS", turns)
    monkeypatch.setattr(neardup, "EASY", easy)
    monkeypatch.setattr(neardup, "SPLIT", split)
    rows = mixture()
    texts = spark.createDataFrame(list(enumerate(rows)), "i int, text string").withColumn("node", text_digest(F.col("text"))).cache()
    none = spark.createDataFrame([], "node binary, label binary")
    got = neardup.resolve(texts.select("node"), texts.select("node", "text"), none)
    label = {r.i: bytes(r.label or r.node) for r in texts.join(got, "node", "left").collect()}
    mine, want = defaultdict(set), defaultdict(set)
    for i, least in enumerate(brute_force(rows)):
        mine[label[i]].add(i)
        want[least].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert len(want) > 3 and max(map(len, want.values())) > 20


def test_forms_equal_brute_force(spark):
    rows = mixture() + forms(5, 5, 6)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    least = brute_force(rows)
    size = Counter(least)
    got = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in neardup.report(docs).collect()}
    assert got == {(i, c, size[c], i == c) for i, c in enumerate(least)}


def test_joined_rows_grow_with_the_texts(spark, monkeypatch):
    """One form with five fill-ins of 20 values: the rows formed by the pair steps, all
    texts open and no class known."""
    formed = {}

    def rows_formed(n):
        total = []
        cross, lead = neardup.cross_pairs, neardup.leader_pairs
        monkeypatch.setattr(neardup, "cross_pairs", lambda rows: (total.append(rows.where("label <> dom").agg(F.sum("m")).first()[0]), cross(rows))[1])
        monkeypatch.setattr(neardup, "leader_pairs", lambda rows, turn: (total.append(rows.where("label <> dom").count()), lead(rows, turn))[1])
        texts = spark.createDataFrame([(t,) for t in forms(n, 5, 20)], "text string").withColumn("node", text_digest(F.col("text")))
        texts = texts.dropDuplicates(["node"]).cache()
        neardup.resolve(texts.select("node"), texts, spark.createDataFrame([], "node binary, label binary"))
        monkeypatch.undo()
        return sum(total)

    for n in (500, 2000):
        formed[n] = rows_formed(n)
    assert formed[2000] < 8 * formed[500]  # 16 times for a quadratic join
