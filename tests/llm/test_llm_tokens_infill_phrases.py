"""Token counts, fill-in-middle and collocations against the library or brute force, on
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clickpath.llm import bytesutil, collocations, infill, tokencount

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    vocab = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(60)]
    texts = [None, "", " ", "\n", "a", "x<P>y", "no <S mark>", "<M", "漢字 é\U0001F600 " * 50, "▁ ▁", " " * 3000, "tot" * 400, "a\x00b\tc"]
    for _ in range(40):
        texts.append("".join(rng.choice(vocab) + rng.choice(["  ", " ", " ", " ", ". ", "\t", "\n", ", "]) for _ in range(rng.randint(1, 300))))
    texts += [" ".join(rng.choice(vocab) for _ in range(30_000)), texts[-1], texts[-2]]
    rows = [(i, t, [None, "en", "und", "en", "fr"][i % 5], "s", 0) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[21], None, None, None)]
    return spark.createDataFrame(rows, DOC).cache()


def clashing(docs):
    return docs.withColumnRenamed("source", "n").withColumnRenamed("n_chars", "form").withColumn("TOKENS", docs.doc_id).withColumn("id", docs.lang)


# ---- 11 ----------------------------------------------------------------------------

def library():
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.MODEL))


def test_token_counts_equal_the_library(spark, docs):
    model = library()
    rows = docs.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 4096) for r in rows)
    for table in (docs, clashing(docs)):
        assert Counter(map(tuple, tokencount.count(table).collect())) == want
    assert any(k[3] for k in want) and not all(k[3] for k in want)
    assert tokencount.count(docs.limit(0)).count() == 0


def test_ragged_merging_of_awkward_sequences():
    import public_tokenizers
    rng = random.Random(3)
    texts = [" " * k for k in range(80)] + ["tes" * k for k in range(60)] + ["ab" * 3000, "a" * 9000, " " * 9000, "others" * 900]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (63, 64, 65, 4000, 6000)]
    texts += ["".join(rng.choice("aeotsn▁ \n.'éß漢0<>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    model = library()
    vocabulary = tokencount.Vocabulary(public_tokenizers.path(tokencount.MODEL))
    want = [len(t) for t in model.encode(texts)]
    assert vocabulary.count(*bytesutil.buffers(pa.array(texts))).tolist() == want
    assert vocabulary.count(*bytesutil.buffers(pa.array(texts[::-1]))).tolist() == want[::-1]      # from the worker's cache


# ---- 12 ----------------------------------------------------------------------------

def test_fill_in_middle_equals_brute_force(spark, docs):
    def brute(doc_id, text):
        t = text or ""
        h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
        n = len(t)
        p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            return doc_id, n, "plain", None, None, t
        if h4 % 100 < 20:
            return doc_id, n, "spm", p, q - p, f"<S>{t[q:]}<P>{t[:p]}<M>{t[p:q]}"
        return doc_id, n, "psm", p, q - p, f"<P>{t[:p]}<S>{t[q:]}<M>{t[p:q]}"

    rows = docs.collect()
    want = Counter(brute(r.doc_id, r.text) for r in rows)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    for table in (docs, clashing(docs)):
        out = infill.rearrange(table)
        assert Counter(map(tuple, out.collect())) == want
    back = infill.restore(infill.rearrange(docs)).collect()
    texts = Counter((r.doc_id, r.text or "") for r in rows)
    assert Counter((r.doc_id, r.restored) for r in back) == texts
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = Counter((r.output_sha256, r.restored_sha256) for r in infill.report(docs).collect())
    assert digests == Counter((sha(brute(r.doc_id, r.text)[5]), sha(r.text or "")) for r in rows)
    assert infill.report(docs.limit(0)).count() == 0


def test_scatter_and_gather_of_random_batches():
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("aé漢\U0001F600<>PSM "), rng.integers(0, 12))) for _ in range(4000)]
    moved = np.array([bool(t) and not any(m in t for m in ("<P>", "<S>", "<M>")) and rng.random() < 0.8 for t in texts])
    first = moved & (rng.random(len(texts)) < 0.4)
    cuts = np.sort(np.stack([rng.integers(0, len(t) + 1, 2) for t in texts]), 1)
    out, offs = infill.scatter(*bytesutil.buffers(pa.array(texts)), moved, first, cuts[:, 0], cuts[:, 1])
    for i, (t, (p, q)) in enumerate(zip(texts, cuts)):
        want = t if not moved[i] else f"<S>{t[q:]}<P>{t[:p]}<M>{t[p:q]}" if first[i] else f"<P>{t[:p]}<S>{t[q:]}<M>{t[p:q]}"
        assert out[offs[i]:offs[i + 1]].tobytes().decode() == want
    back, at = infill.gather(out, offs, moved, first)
    assert [back[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == texts


# ---- 13 ----------------------------------------------------------------------------

def brute_phrases(rows, least, longest, top):
    counts = {}
    for r in rows:
        f = counts.setdefault("und" if r.lang is None else r.lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        some = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inner = {b[i:i + k] for b, c in some.items() for k in range(2, len(b)) for i in range(len(b) - k + 1) if c >= some[b[i:i + k]]}
        found = []
        for p, a in some.items():
            if p not in inner:
                s, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -s))
    return out


@pytest.mark.parametrize("least,head,top", [(3, collocations.HEAD, 2000), (3, 16, 2000), (2, 0, 50)])
def test_collocations_equal_brute_force(spark, docs, least, head, top):
    got = collocations.mine(clashing(docs), min_count=least, head=head, top=top)
    rows = docs.collect()
    want = brute_phrases(rows, least, 5, top)
    assert len({w[0] for w in want}) == 3 and max(len(w[2].split()) for w in want) > 2
    assert {tuple(r) for r in got.collect()} == want


def test_collocations_of_few_rows(spark, docs):
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.where("text is null")).count() == 0
    long = spark.createDataFrame([(1, "Of THE of the " * 20_000, None, "s", 0)], DOC)
    got = {tuple(r) for r in collocations.mine(long).collect()}
    assert got == brute_phrases(long.collect(), 100, 5, 2000)


def test_tiles_equal_plain_counts():
    rng = np.random.default_rng(2)
    head = 4 * collocations.TILE
    a = np.where(rng.random(60_000) < 0.8, rng.zipf(1.3, 60_000) % head, rng.integers(0, head, 60_000))
    b = np.where(rng.random(60_000) < 0.9, rng.zipf(1.3, 60_000) % head, (1 << 62) + rng.integers(0, 50, 60_000))
    want = Counter(zip(a.tolist(), b.tolist()))
    for dense in (1, 500, 1 << 30):
        x, y, c = collocations.tiled_counts(a, b, head, dense)
        assert len(x) == len(want) and dict(zip(zip(x.tolist(), y.tolist()), c.tolist())) == want
    assert all(len(v) == 0 for v in collocations.tiled_counts(a[:0], b[:0]))
