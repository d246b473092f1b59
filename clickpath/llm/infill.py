"""Fill-in-middle rearrangement by displacement scatter.

The cuts of a document come from its id's hash, in the JVM.  A batch's texts stay in
one Arrow buffer: a scan over its bytes turns cuts in code points into byte places, a
difference array holds the change of displacement at the start of each segment, its
cumulative sum says for every byte how far it moves, and one numpy scatter writes all
outputs.  ``restore`` finds the three marks in an output, builds the same kind of
array over the original's bytes and gathers them back; it needs output and form only.

One ``mapInArrow`` each, no shuffle, no loop over rows.  A null text counts as empty
and stays plain; a null id hashes as the empty string after the seed.  A text that
holds a mark stays plain, so the marks of an output are always the inserted ones.
Repeated rows give equal outputs; an empty table gives no rows.  Only the id and text
columns are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesutil as B

#: The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = {m: np.frombuffer(m.encode(), np.uint8) for m in (PREFIX, SUFFIX, MIDDLE)}
_W = 3
SLICE_BYTES = 8 << 20


def _places(size: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """0..size-1, each moved by the shift of its segment (``starts`` ascend; of segments
    that start together all but the last are empty)."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    return np.arange(size) + np.cumsum(change[:size])


def scatter(data: np.ndarray, offs: np.ndarray, moved: np.ndarray, suffix_first: np.ndarray,
            cut1: np.ndarray, cut2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs; cuts are code points within the text."""
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(chars[:-1], offs[:-1])
    lo, hi = offs[:-1], offs[1:]
    b1 = np.where(moved, chars[np.minimum(first + cut1, len(chars) - 1)], hi)
    b2 = np.where(moved, chars[np.minimum(first + cut2, len(chars) - 1)], hi)
    out_offs = np.concatenate([[0], np.cumsum(hi - lo + 3 * _W * moved)])
    o, n_prefix, n_suffix = out_offs[:-1], b1 - lo, hi - b2
    to_prefix = np.where(moved, o + _W + np.where(suffix_first, n_suffix + _W, 0), o)
    to_suffix = o + _W + np.where(suffix_first, 0, n_prefix + _W)
    to_middle = o + 3 * _W + n_prefix + n_suffix
    places = _places(len(data), np.stack([lo, b1, b2], 1).ravel(),
                     np.stack([to_prefix - lo, to_middle - b1, to_suffix - b2], 1).ravel())
    out = np.empty(out_offs[-1], np.uint8)
    out[places] = data
    for mark, at in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        out[(at[moved] - _W)[:, None] + np.arange(_W)] = _MARKS[mark]
    return out, out_offs


def gather(data: np.ndarray, offs: np.ndarray, moved: np.ndarray, suffix_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts whose outputs these are."""
    lo, hi = offs[:-1], offs[1:]
    at = np.flatnonzero((data[:-2] == 0x3C) & (data[2:] == 0x3E)) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], [m[1] for m in _MARKS.values()])]
    row = np.searchsorted(hi, at, "right")
    at = at[moved[row] & (at + _W <= hi[row])]
    if len(at) != 3 * moved.sum():
        raise ValueError("an output without its three marks")
    q1, q2, q3 = (lo.copy() for _ in range(3))
    q1[moved], q2[moved], q3[moved] = at.reshape(-1, 3).T
    second, third = (q1 + _W, q2 - q1 - _W), (q2 + _W, q3 - q2 - _W)
    prefix = [np.where(suffix_first, b, a) for a, b in zip(second, third)]
    suffix = [np.where(suffix_first, a, b) for a, b in zip(second, third)]
    middle = q3 + _W, hi - q3 - _W
    text_offs = np.concatenate([[0], np.cumsum(hi - lo - 3 * _W * moved)])
    t0, t3 = text_offs[:-1], text_offs[1:]
    t1 = np.where(moved, t0 + prefix[1], t3)
    t2 = np.where(moved, t1 + middle[1], t3)
    places = _places(int(text_offs[-1]), np.stack([t0, t1, t2], 1).ravel(),
                     np.stack([np.where(moved, prefix[0], lo) - t0, middle[0] - t1, suffix[0] - t2], 1).ravel())
    return data[places], text_offs


def _texts(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    arrays = [pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
              for data, offs in parts]
    return pa.concat_arrays(arrays).cast(pa.string()) if arrays else pa.array([], pa.string())


def _column(batch, name: str, i: int, j: int) -> np.ndarray:
    return batch.column(name).slice(i, j - i).to_numpy(zero_copy_only=False)


def _rearranged(batches):
    for batch in batches:
        parts = []
        for i, j in B.slices(batch.column("text"), SLICE_BYTES):
            form = _column(batch, "form", i, j)
            parts.append(scatter(*B.buffers(batch.column("text").slice(i, j - i)), form != "plain", form == "spm",
                                 _column(batch, "cut1", i, j), _column(batch, "cut2", i, j)))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n", "form", "cut1", "cut2")] + [_texts(parts)],
                                         names=["doc_id", "n", "form", "cut1", "cut2", "output"])


def _restored(batches):
    for batch in batches:
        parts = []
        for i, j in B.slices(batch.column("output"), SLICE_BYTES):
            form = _column(batch, "form", i, j)
            parts.append(gather(*B.buffers(batch.column("output").slice(i, j - i)), form != "plain", form == "spm"))
        yield pa.RecordBatch.from_arrays([*batch.columns, _texts(parts)], names=[*batch.schema.names, "restored"])


def rearrange(docs: DataFrame, seed: int = 1, moved_percent: int = 90, suffix_first_percent: int = 20,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (code points), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output (text).

    The four numbers of a document are the first 32-bit groups of the SHA-256 of
    ``seed:id``; two give the cuts, one says whether it moves, one which part leads.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       *(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))
    rows = rows.withColumn("n", F.char_length("text").cast("long"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = (F.when((F.col("n") == 0) | (F.col("h3") % 100 >= moved_percent) | marked, "plain")
            .when(F.col("h4") % 100 < suffix_first_percent, "spm").otherwise("psm"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("cut1"), F.greatest(a, b).alias("cut2"))
    out = rows.mapInArrow(_rearranged, "doc_id long, n long, form string, cut1 long, cut2 long, output string")
    moved = F.col("form") != "plain"
    return out.select("doc_id", "n", "form", F.when(moved, F.col("cut1")).alias("prefix_chars"),
                      F.when(moved, F.col("cut2") - F.col("cut1")).alias("middle_chars"), "output")


def restore(outputs: DataFrame) -> DataFrame:
    """The rows with ``restored``, the text rebuilt from ``output`` and ``form``."""
    return outputs.mapInArrow(_restored, outputs.select("*", F.lit("").alias("restored")).schema)


def report(docs: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them."""
    out = restore(rearrange(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
