"""Token ids in packed rows: best-fit decreasing with a segment tree over capacities.

Every task tokenises its documents, ends each with the end-of-text id and cuts
what is longer than a row into row-sized segments and a rest, without loss.  The
segments of a shard (about ``SHARD_TOKENS``) are packed longest first: a segment
tree over the capacities 1..L counts open rows by free space and finds the
tightest row that fits in log L steps.  Nothing is shuffled; memory is one shard.

The vocabulary file is a parameter and is not part of this package; tokenisers are
never trained.  A null text is tokenised as the empty one: its end-of-text id.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LENGTH = 2048
SHARD_TOKENS = 1 << 21
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = ("shard string, row long, n_tokens int, doc_ids array<bigint>, doc_starts array<bigint>, "
          "cu_seqlens array<int>, position_resets array<int>, input_ids binary")


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary in rank order; ``end`` is the id after the last rank."""
    path: str = VOCABULARY

    def load(self):
        import tiktoken
        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


class CapacityTree:
    """Counts of open rows by free space 0..size; finds the tightest that fits."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (free space, row) of least free space >= need, or None."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        self._change(free, -1)
        return free, self.rows[free].pop()


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of segment numbers: longest first (ties in order), tightest row first."""
    tree, rows = CapacityTree(most), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        got = tree.take(lengths[k])
        if got is None:
            rows.append([])
            got = most, len(rows) - 1
        rows[got[1]].append(k)
        if got[0] > lengths[k]:
            tree.add(got[0] - lengths[k], got[1])
    return rows


def packed_rows(docs: list, length: int, end: int, shard: str) -> pa.RecordBatch:
    """Pack (doc id, uint16/uint32 ids) into rows of ``length``, padded with ``end``."""
    segments = [(d, at, ids[at:at + length]) for d, ids in docs for at in range(0, len(ids), length)]
    rows = best_fit([len(s[2]) for s in segments], length)
    out: dict[str, list] = {n: [] for n in ("n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "position_resets", "input_ids")}
    for members in rows:
        matrix = np.full(length, end, segments[members[0]][2].dtype)
        ends = np.cumsum([len(segments[k][2]) for k in members])
        starts = np.r_[0, ends[:-1]]
        for k, a, b in zip(members, starts, ends):
            matrix[a:b] = segments[k][2]
        out["n_tokens"].append(int(ends[-1]))
        out["doc_ids"].append([segments[k][0] for k in members])
        out["doc_starts"].append([segments[k][1] for k in members])
        out["cu_seqlens"].append(np.r_[0, ends].astype(np.int32))
        out["position_resets"].append(starts.astype(np.int32))
        out["input_ids"].append(matrix.tobytes())
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(out["n_tokens"], pa.int32()),
         pa.array(out["doc_ids"], pa.list_(pa.int64())), pa.array(out["doc_starts"], pa.list_(pa.int64())),
         pa.array(out["cu_seqlens"], pa.list_(pa.int32())), pa.array(out["position_resets"], pa.list_(pa.int32())),
         pa.array(out["input_ids"], pa.binary())],
        names=["shard", "row", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "position_resets", "input_ids"])


_loaded: dict[Tokenizer, tuple] = {}


def _packer(tokenizer: Tokenizer, length: int, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext
        if tokenizer not in _loaded:
            _loaded[tokenizer] = tokenizer.load()
        encoding, end = _loaded[tokenizer]
        kind = np.uint16 if end < 1 << 16 else np.uint32
        part = TaskContext.get().partitionId()
        held, tokens, shard = [], 0, 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                found = np.array([*encoding.encode_ordinary(texts[i].as_py() or ""), end], kind)
                held.append((ids[i].as_py(), found))
                tokens += len(found)
                if tokens >= shard_tokens:
                    yield packed_rows(held, length, end, f"{part}-{shard}")
                    held, tokens, shard = [], 0, shard + 1
        if held:
            yield packed_rows(held, length, end, f"{part}-{shard}")
    return run


def pack(docs: DataFrame, tokenizer: Tokenizer = Tokenizer(), length: int = LENGTH, shard_tokens: int = SHARD_TOKENS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row of ``length`` ids.

    ``input_ids`` is the row's little-endian id matrix line (two bytes an id if the
    vocabulary allows), padded with the end id after ``n_tokens``; ``cu_seqlens``
    are the cumulative segment lengths, ``position_resets`` the offsets where
    position ids start at 0 again; segment k holds the tokens of ``doc_ids[k]`` from
    ``doc_starts[k]`` on.  All documents are there, empty ones as their end id.
    """
    if not os.path.exists(tokenizer.path):
        raise FileNotFoundError(f"tokenizer vocabulary {tokenizer.path}")
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(_packer(tokenizer, length, shard_tokens), SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, a file a task; an existing path is an error."""
    packed.write.parquet(path)
