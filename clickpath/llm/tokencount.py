"""Token counts of a piece vocabulary by rank-synchronous merging of ragged arrays.

A batch of texts becomes one array of code points.  It is cut wherever two adjacent
characters occur side by side in no piece: no merge can cross such a place, so the
runs between (the pre-tokens) are counted on their own, each different one once.
The pre-tokens are one ragged array of symbols; a round finds each sequence's
lowest-rank pair and merges all its occurrences at once, and a sequence without a
pair leaves with the number of its symbols.

Merging all occurrences at once equals merging them one by one from the left unless
the new symbol forms a pair of no worse rank with a neighbour.  Pieces that can do so
are known from the vocabulary; a sequence in which one occurs twice merges the first
only.  Sequences where rounds would be many (over ``LONG`` symbols, or over
``REPEATED`` with such a piece) are merged one pair at a time from a heap instead, in
n log n steps, with the same result.

One ``mapInArrow``, no shuffle; memory is one slice of ``SLICE_BYTES`` or the longest
text.  A null or empty text has no tokens; a character that no piece has counts one
token a UTF-8 byte.  Repeated rows are counted each; an empty table gives no rows.
Only the id and text columns are read, so other columns' names cannot clash.
Pre-tokens are told apart by 64-bit hashes (a wrong pair: 2^-64).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesutil as B

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SLICE_BYTES = 4 << 20
SPACE = 0x2581                 # the vocabulary's visible space
HASHED = 64                    # pre-tokens up to this length are counted once a worker
LONG = 4096
REPEATED = 64
CACHE = 1 << 20
NO_PAIR = np.iinfo(np.int64).max
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces, their merge ranks and the pairs that form them, as arrays."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if any(model.is_unused(i) for i in range(size)) or not any(model.is_byte(i) for i in range(size)):
            raise ValueError(f"{path}: only vocabularies with byte pieces and without unused ones")
        self.ids = {model.id_to_piece(i): i for i in range(size)
                    if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        ids, size = self.ids, size + 1
        score = {p: -model.get_score(i) for p, i in ids.items()}
        levels = {s: k for k, s in enumerate(sorted(set(score.values())))}
        rank = {p: levels[s] for p, s in score.items()}
        self.size = size
        # characters: piece id, tokens of the character alone
        self.symbol = np.zeros(0x110000, np.int32)
        self.cost = np.ones(0x110000, np.uint8)
        self.cost[0x80:], self.cost[0x800:], self.cost[0x10000:] = 2, 3, 4
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)], self.cost[ord(p)] = i, 1
        # neighbours: which characters stand side by side in a piece
        inside = sorted({c for p in ids if len(p) > 1 for c in p})
        self.place = np.zeros(0x110000, np.uint16)
        self.place[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.beside = np.zeros((len(inside) + 1,) * 2, bool)
        pairs, risky = {}, np.zeros(size, bool)
        for p, i in ids.items():
            for k in range(1, len(p)):
                self.beside[self.place[ord(p[k - 1])], self.place[ord(p[k])]] = True
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * size + right] = (rank[p], i)
                for part, known in ((p[:k], left), (p[k:], right)):
                    if known is not None and len(part) > 1 and rank[part] >= rank[p]:
                        risky[known] = True
        self.risky = risky
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self._seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        probe = "ﬁ ａ  x́ \t<s>　 ▁a①"
        if len(model.encode(probe)) != int(self.count(*B.buffers(pa.array([probe])))[0]):
            raise ValueError(f"{path}: only vocabularies that leave the text as it is")

    def pairs(self, sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of the pair that starts at each symbol."""
        key = np.empty(len(sym), np.int64)
        key[:-1] = sym[:-1].astype(np.int64) * self.size + sym[1:]
        key[ends - 1] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NO_PAIR), self.merged[at]

    def survivors(self, sym: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence of the ragged array (``lens`` symbols each, > 0)."""
        out = np.zeros(len(lens), np.int64)
        which = np.arange(len(lens))
        apart = lens > LONG
        if apart.any():
            self._one_by_one(sym, lens, apart, which, out)
            sym, lens, which = sym[np.repeat(~apart, lens)], lens[~apart], which[~apart]
        while len(which):
            ends = np.cumsum(lens)
            starts = ends - lens
            rank, merged = self.pairs(sym, ends)
            low = np.minimum.reduceat(rank, starts)
            done = low == NO_PAIR
            if done.any():
                out[which[done]] = lens[done]
                stay = np.repeat(~done, lens)
                sym, rank, merged, lens, which, low = sym[stay], rank[stay], merged[stay], lens[~done], which[~done], low[~done]
                if not len(which):
                    break
                ends = np.cumsum(lens)
                starts = ends - lens
            owner = np.repeat(np.arange(len(lens)), lens)
            at = np.flatnonzero(rank == low[owner])
            # of occurrences that overlap, every other one from the left
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            run = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            at = at[run % 2 == 0]
            seq = owner[at]
            first = np.ones(len(at), bool)
            first[1:] = seq[1:] != seq[:-1]
            careful = np.zeros(len(lens), bool)
            careful[seq[~first]] = True
            has_risky = np.zeros(len(lens), bool)
            has_risky[seq[self.risky[merged[at]]]] = True
            careful &= has_risky
            if careful.any():
                at = at[first | ~careful[seq]]
                apart = careful & (lens > REPEATED)
                if apart.any():
                    self._one_by_one(sym, lens, apart, which, out)
                    at = at[~apart[owner[at]]]
            sym[at] = merged[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            lens = lens - np.bincount(owner[at], minlength=len(lens))
            if careful.any() and apart.any():
                stay &= ~apart[owner]
                lens, which = lens[~apart], which[~apart]
            sym = sym[stay]
        return out

    def _one_by_one(self, sym, lens, apart, which, out) -> None:
        ends = np.cumsum(lens)
        for k in np.flatnonzero(apart):
            out[which[k]] = self._from_heap(sym[ends[k] - lens[k]:ends[k]].tolist())

    def _from_heap(self, sym: list[int]) -> int:
        """Symbols left of one sequence, merged pair by pair: lowest rank, then leftmost."""
        if not hasattr(self, "table"):
            self.table = {k: (int(r), int(m)) for k, r, m in zip(self.keys.tolist(), self.ranks, self.merged)}
        n, table = len(sym), self.table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = after[i]
            found = table.get(sym[i] * self.size + sym[j]) if j < n else None
            if found:
                heapq.heappush(heap, (found[0], i, sym[i], j, sym[j], found[1]))

        for i in range(n):
            offer(i)
        left = n
        while heap:
            _, i, a, j, b, m = heapq.heappop(heap)
            if sym[i] != a or after[i] != j or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = m, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return left

    def _once(self, cps: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Token counts of the pre-tokens, each different short one computed once."""
        out = np.empty(len(starts), np.int64)
        short = lens <= HASHED
        if not short.all():
            long = np.flatnonzero(~short)
            out[long] = self.survivors(self.symbol[_gathered(cps, starts[long], lens[long])], lens[long])
        short = np.flatnonzero(short)
        s, n = starts[short], lens[short]
        h, live, k = n.astype(np.uint64), np.arange(len(s)), 0
        while len(live):
            h[live] = (h[live] ^ cps[s[live] + k]) * _STEP
            h[live] ^= h[live] >> np.uint64(29)
            k += 1
            live = live[n[live] > k]
        different, first, inverse = np.unique(B.mix(h), return_index=True, return_inverse=True)
        counts = np.empty(len(different), np.int64)
        seen, known = self._seen
        at = np.minimum(np.searchsorted(seen, different), max(len(seen) - 1, 0))
        old = seen[at] == different if len(seen) else np.zeros(len(different), bool)
        counts[old] = known[at[old]]
        new = first[~old]
        if len(new):
            counts[~old] = self.survivors(self.symbol[_gathered(cps, s[new], n[new])], n[new])
            keep = (seen, known) if len(seen) + len(new) <= CACHE else (seen[:0], known[:0])
            seen = np.concatenate([keep[0], different[~old]])
            order = np.argsort(seen)
            self._seen = seen[order], np.concatenate([keep[1], counts[~old]])[order]
        out[short] = counts[inverse]
        return out

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text of a byte buffer."""
        marks = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        cps = np.where(cps == 0x20, np.uint32(SPACE), cps)
        filled = np.diff(marks) > 0
        cps = np.insert(cps, marks[:-1][filled], SPACE)        # each text starts with a space
        marks = marks + np.concatenate([[0], np.cumsum(filled)])
        if not len(cps):
            return np.zeros(len(filled), np.int64)
        place = self.place[cps]
        first = np.ones(len(cps), bool)
        first[1:] = ~self.beside[place[:-1], place[1:]]
        first[marks[:-1][filled]] = True
        starts = np.flatnonzero(first)
        lens = np.diff(np.append(starts, len(cps)))
        tokens = self.cost[cps[starts]].astype(np.int64)
        more = np.flatnonzero(lens > 1)
        if len(more):
            tokens[more] = self._once(cps, starts[more], lens[more])
        sums = np.concatenate([[0], np.cumsum(tokens)])
        return np.diff(sums[np.searchsorted(starts, marks)])


def _gathered(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The values of the spans, one after the other."""
    ends = np.cumsum(lens)
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lens), lens)]


_loaded: dict[str, Vocabulary] = {}


def _counter(model: str):
    def run(batches):
        if model not in _loaded:
            import public_tokenizers
            _loaded[model] = Vocabulary(public_tokenizers.path(model))
        vocabulary = _loaded[model]
        for batch in batches:
            counts = [vocabulary.count(*B.buffers(batch.column(1).slice(i, j - i)))
                      for i, j in B.slices(batch.column(1), SLICE_BYTES)]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``model`` is the name of a public vocabulary with byte fallback; it is read on the
    executors and is no part of this package.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = rows.mapInArrow(_counter(model), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
