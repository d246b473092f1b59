"""Vectorised work on the UTF-8 bytes of Arrow text columns.

Texts stay in the Arrow buffer: words are found by a 256-entry class table and
hashed with prefix sums of a polynomial, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PIECE = 1 << 20

#: Byte classes. LOWER_ALNUM is the class of letters, digits and all bytes of
#: non-ASCII characters; SPACED is all but ASCII white space.
LOWER_ALNUM = np.zeros(256, bool)
LOWER_ALNUM[0x30:0x3A] = LOWER_ALNUM[0x41:0x5B] = LOWER_ALNUM[0x61:0x7B] = LOWER_ALNUM[0x80:] = True
SPACED = np.ones(256, bool)
SPACED[0x09:0x0E] = SPACED[0x20] = False

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(32)
_LOWER += np.uint64(1)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = int(offs[0]), int(offs[-1])
    return data[lo:hi], offs - lo


def slices(column, most_bytes: int):
    """Row ranges whose texts hold at most ``most_bytes`` (a longer text alone)."""
    _, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most_bytes, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of a byte class within rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[:-1][offs[:-1] < len(data)]
    first[at] = inside[at]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, with A-Z read as a-z.

    Prefix sums of byte * base**position modulo 2**64, in pieces of a megabyte:
    a span's hash is the difference of two sums, divided by base**start.
    """
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + _PIECE, "right")))
        lo, size = int(s[i]), int(e[j - 1] - s[i])
        power, inverse = _power_tables(max(size, _PIECE) + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_LOWER[data[lo:lo + size]] * power[:size], out=sums[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * inverse[a]
        i = j
    return mix(out)


def row_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First span of each row, and one past the last row's: a span belongs to row r
    if its index is in [result[r], result[r + 1])."""
    return np.searchsorted(starts, offs)
