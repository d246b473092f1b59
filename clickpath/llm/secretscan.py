"""Secret scan with structural confirmation.

Base spans come from three patterns.  The method adds spans that are secrets by
their structure: base64 or hex candidates are decoded and reported only if the
bytes parse as a key encoding (DER with nested lengths that fill their parents,
OpenSSH wire fields) or the token's header and claims are JSON (signed tokens).
Lines of a key may be indented or joined by escaped line ends (a key inside a
JSON or source string).  DER public keys, certificates and requests are told by
their shape (algorithm identifier before a bit string, two integers) and not
reported; OpenSSH lines are reported as ``ssh`` whichever half of a pair they hold.

A byte-level pass over the Arrow buffer marks the few texts that can hold a
candidate of each kind; only those are decoded and searched.  One ``mapInArrow``,
no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesutil as B

#: Kinds in report order: the first three are the base patterns.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
_RANK = {k: i for i, k in enumerate(KINDS)}
BASE = KINDS[:3]

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
# A line end inside a key: white space and the next line's indentation, or an escape.
_BREAK = r"(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\+r)?\\+n)"
_BREAKS = re.compile(_BREAK)
_ESCAPE_END = r"(?:(?<=\\)[nrt])?"
_BASE64 = re.compile(_ESCAPE_END + r"([A-Za-z0-9+/]{24,}(?:" + _BREAK + r"[A-Za-z0-9+/]{4,})*={0,2})")
_URL_SAFE = re.compile(_ESCAPE_END + r"(?!-----)([A-Za-z0-9_-]{24,}(?:" + _BREAK + r"(?!-----)[A-Za-z0-9_-]{4,})*={0,2})")
_FROM_URL_SAFE = str.maketrans("-_", "+/")
_LONG_HEX = re.compile(r"[0-9a-fA-F]{32,}")
_SSH_NAME = re.compile(rb"(ssh|ecdsa|sk)-[A-Za-z0-9@.-]{3,60}\Z")
SLICE_BYTES = 16 << 20

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[0x30:0x3A] = _HEX_BYTES[0x61:0x67] = True
_B64_BYTES = np.zeros(256, bool)
_B64_BYTES[0x30:0x3A] = _B64_BYTES[0x41:0x5B] = _B64_BYTES[0x61:0x7B] = True
_B64_BYTES[[ord(c) for c in "+/_=-."]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at ``at``, or None."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at:at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _elements(data: bytes, at: int, end: int, depth: int = 0) -> list | None:
    """The elements that fill ``data[at:end]`` exactly, SEQUENCEs among them filled too."""
    out = []
    while at < end:
        e = _element(data, at, end)
        if e is None or depth > 12:
            return None
        if e[0] == 0x30 and _elements(data, e[1], e[2], depth + 1) is None:
            return None
        out.append(e)
        at = e[2]
    return out


def der_length(data: bytes) -> int | None:
    """Bytes of the DER key structure that ``data`` starts with, or None.

    A key is a SEQUENCE whose elements fill it exactly, two or more, the first an
    INTEGER or a SEQUENCE, and whose nested SEQUENCEs are filled exactly too.
    """
    whole = _element(data, 0, len(data))
    if whole is None or whole[0] != 0x30 or whole[2] < 16:
        return None
    parts = _elements(data, whole[1], whole[2])
    return whole[2] if parts and len(parts) >= 2 and parts[0][0] in (0x02, 0x30) else None


def is_public(data: bytes) -> bool:
    """Whether a structure that ``der_length`` accepts is a public one: a public key
    (algorithm, bit string), a certificate or the like (body, algorithm, bit string)
    or a bare RSA public key (modulus, small exponent)."""
    whole = _element(data, 0, len(data))
    parts = _elements(data, whole[1], whole[2])
    tags = [p[0] for p in parts]
    if tags in ([0x30, 0x03], [0x30, 0x30, 0x03]):
        inner = _element(data, parts[-2][1], parts[-2][2])  # an algorithm begins with an object identifier
        return inner is not None and inner[0] == 0x06
    return tags == [0x02, 0x02] and parts[0][2] - parts[0][1] >= 64 and parts[1][2] - parts[1][1] <= 8


def ssh_length(data: bytes) -> int | None:
    """Bytes of the OpenSSH key that ``data`` starts with, or None."""
    if data.startswith(b"openssh-key-v1\0"):
        return len(data)
    at = fields = 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data) or n == 0:
            break
        if fields == 0 and not _SSH_NAME.match(data[4:4 + n]):
            return None
        if fields >= 2 and _SSH_NAME.match(data[at + 4:at + 4 + n]):
            break  # the next key
        at, fields = at + 4 + n, fields + 1
    return at if fields >= 2 else None


def _is_token(found: str) -> bool:
    """A signed token: header and claims are JSON objects, the header names ``alg``."""
    try:
        head, claims = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in found.split(".")[:2])
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str)


def _decoded(chars: str) -> bytes:
    chars = chars[:len(chars) - (len(chars) % 4 == 1)]
    return base64.b64decode(chars + "=" * (-len(chars) % 4))


def _names_ssh(chars: str, start: int) -> bool:
    if not chars.startswith("AAAA", start):
        return False
    raw = _decoded(chars[start:start + 96])
    return bool(_SSH_NAME.match(raw[4:4 + int.from_bytes(raw[:4], "big")]))


def _keys(found: str) -> list[tuple[str, int, int]]:
    """Keys (kind, start, end) in base64 lines: from each line's start and from the end
    of the key before.  Only what can begin a key is decoded."""
    found = _BREAKS.sub(lambda m: "\n" * len(m.group()), found)
    at = [k for k, c in enumerate(found) if c not in "\n="]
    chars = "".join(found[k] for k in at).translate(_FROM_URL_SAFE)
    lines = [k for k in range(len(at) - 1, -1, -1) if k == 0 or found[at[k] - 1] == "\n"]
    out, end, following = [], 0, False
    while lines or following:
        start = end if following else lines.pop()
        following = False
        if start < end or start >= len(chars):
            continue
        head, kind, n = chars[start:start + 96], "", None
        if head[0] == "M":
            raw = _decoded(head)
            size = 2 + raw[1] if raw[1:2] and raw[1] < 0x80 else 2 + (raw[1] & 0x7F) + int.from_bytes(raw[2:2 + (raw[1] & 0x7F)], "big") if raw[1:2] and raw[1] & 0x7F <= 4 else 0
            if 0 < size <= (len(chars) - start) * 3 // 4:
                kind, n = "der", der_length(_decoded(chars[start:start - (-size * 4 // 3)]))
        elif head.startswith("b3BlbnNzaC1rZXktdjEA"):
            kind, n = "ssh", ssh_length(_decoded(chars[start:]))
        elif _names_ssh(chars, start):
            stop = next((k for k in reversed(lines) if k > start and _names_ssh(chars, k)), len(chars))
            kind, n = "ssh", ssh_length(_decoded(chars[start:stop]))
        if n is not None:
            end, following = min(len(at), start - (-n * 4 // 3)), True
            last = at[end - 1] + 1
            while last < len(found) and found[last] == "=":
                last += 1
            if kind != "der" or not is_public(_decoded(chars[start:end])):
                out.append((kind, at[start], last))
    return out


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Structurally confirmed spans (kind, start, end) of a text."""
    out = [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if _is_token(m.group())]
    found = {}
    for pattern in (_BASE64, _URL_SAFE):
        for m in pattern.finditer(text):
            if pattern is _BASE64 or "-" in m.group(1) or "_" in m.group(1):
                for kind, start, end in _keys(m.group(1)):
                    place = kind, m.start(1) + start
                    found[place] = max(found.get(place, 0), m.start(1) + end)
    out += [(kind, start, end) for (kind, start), end in found.items()]
    for m in _LONG_HEX.finditer(text):
        raw = bytes.fromhex(m.group()[:len(m.group()) // 2 * 2])
        for kind, parse in (("der", der_length), ("ssh", ssh_length)):
            if (n := parse(raw)) is not None and not (kind == "der" and is_public(raw)):
                out.append((kind, m.start(), m.start() + 2 * n))
    return out


def base_spans(text: str, kinds=BASE) -> list[tuple[str, int, int]]:
    out = []
    if "assign" in kinds:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "access" in kinds:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    if "hex" in kinds:
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2])))


def _rows_with(raw: bytes, needle: bytes, offs: np.ndarray) -> np.ndarray:
    at, places = raw.find(needle), []
    while at >= 0:
        row = int(np.searchsorted(offs, at, "right")) - 1
        places.append(row)
        at = raw.find(needle, max(at + 1, int(offs[row + 1]) - len(needle) + 1))
    return np.array(places, np.int64)


def candidates(column) -> dict[str, np.ndarray]:
    """Per pass, the rows that can hold a match (a superset)."""
    data, offs = B.buffers(column)
    n = len(offs) - 1
    out = {k: np.zeros(n, bool) for k in (*BASE, "structure")}
    for name, member, least in (("hex", _HEX_BYTES, 16), ("structure", _B64_BYTES, 20)):
        s, e = B.spans(data, offs, member)
        long_enough = s[e - s >= least]
        out[name][np.searchsorted(offs, long_enough, "right") - 1] = True
    out["access"][_rows_with(data.tobytes(), b"AKIA", offs)] = True
    lower = _LOWER[data].tobytes()
    for word in KEYWORDS:
        out["assign"][_rows_with(lower, word, offs)] = True
    return out


def _scanner(text_col: str):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(batch.schema.get_field_index(text_col))
            for i, j in B.slices(texts, SLICE_BYTES):
                marks = candidates(texts.slice(i, j - i))
                any_ = np.logical_or.reduce(list(marks.values()))
                counts = np.zeros((3, j - i), np.int64)
                base, every = [""] * (j - i), [""] * (j - i)
                for r in np.flatnonzero(any_).tolist():
                    text = texts[i + r].as_py()
                    found = base_spans(text, [k for k in BASE if marks[k][r]])
                    for k in range(3):
                        counts[k, r] = sum(s[0] == BASE[k] for s in found)
                    base[r] = joined(found)
                    every[r] = joined(found + confirmed(text)) if marks["structure"][r] else base[r]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *(pa.array(c) for c in counts),
                     pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array(every, pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and
    all spans as ``kind:start:end`` (code points, end exclusive).  Null and empty
    texts have no spans, an empty table gives no rows; repeated rows are scanned one by
    one; other columns are not read, whatever their names."""
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(_scanner("text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
