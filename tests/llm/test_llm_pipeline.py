"""The pipeline end to end on awkward tables: nulls, empty and repeated rows, extra columns with
clashing names, an empty table.  The filtering stages are compared with plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, hits long, `label` string, copies long, shard long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def similar(a, b):
    a, b = (Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) for w in (words(a), words(b)))
    return sum((a & b).values()) >= 0.8 * sum((a | b).values())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 300))) for _ in range(24)]
    passage = [" ".join(texts[k].split()[20:40]) for k in (2, 5)]
    near = [" ".join([*t.split()[:-2], "other", "end"]) for t in texts[8:14]]
    long = " ".join(rng.choice(vocab) for _ in range(20_000))
    texts += near + near[:2] + [texts[0], None, "", " \n", "few words", "$$ ## || %% && ** << >> $ # | %", "again and again it goes " * 30, long]
    rows = [(i, t, ["en", None][i % 2], [None, "b", "a", "é"][i % 4], len(t or ""), "n", i, "l", 1, 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[8], (None, texts[4], None, None, None, None, None, None, None, None),
             (None, " ".join(rng.choice(vocab) for _ in range(80)), None, "b", None, None, None, None, None, None)]
    sf = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    items = [(1, passage[0]), (2, passage[1]), (None, None), (3, ""), (1, passage[0])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows, passage


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_on_awkward_tables(spark, tables):
    sf, rows, passages = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns

    docs = corpus_pipeline.quality(spark, docs, sf).checkpoint()
    assert docs.columns == columns
    good = [r for r in rows if len((r[1] or "").split()) >= 10 and "again and" not in r[1] and "$$" not in r[1]]
    assert _rows(docs) == sorted(good, key=str)

    docs = corpus_pipeline.near_dedup(spark, docs, sf).checkpoint()
    assert docs.columns == columns
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if good[i][1] == good[j][1] or similar(good[i][1], good[j][1]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, r in zip(group, good):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert _rows(docs) == sorted(best.values(), key=str)

    before = _rows(docs)
    docs = corpus_pipeline.decontaminate(spark, docs, sf).checkpoint()
    assert docs.columns == columns

    def contaminated(text):
        w, hit = words(text), set()
        for q in map(words, passages):
            for s in range(len(q) - 12):
                for at in range(len(w) - 12):
                    if w[at:at + 13] == q[s:s + 13]:
                        hit.update(range(at, at + 13))
        return bool(hit) and 20 * len(hit) >= len(w)
    clean = [r for r in before if not contaminated(r[1])]
    assert len(clean) == len(before) - 2 and _rows(docs) == clean

    mixed = corpus_pipeline.mix(spark, docs, sf).checkpoint()
    assert mixed.columns == columns
    size, taken = Counter(), Counter()
    for r in clean:
        size[r[3]] += len(r[1].split())
    for r in mixed.collect():
        taken[r.source] += len((r.text or "").split())
    assert set(taken) == set(size) and all(taken[s] <= 2.1 * size[s] for s in size)
    assert corpus_pipeline.tokenize(spark, mixed, sf).count() > 0


def test_run_on_awkward_and_empty_tables(spark, tables, tmp_path):
    sf, _, _ = tables
    first, again = (corpus_pipeline.run(spark, sf) for _ in range(2))
    assert first.count() > 0 and _rows(first) == _rows(again)
    empty = str(tmp_path)
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    none = corpus_pipeline.run(spark, empty)
    assert none.columns == first.columns and none.count() == 0
