"""Secret scans: an Aho-Corasick prefilter, anchored expressions at its hits, checksums of found tokens.

The automaton runs once over each text, lower-cased in A-Z, and reports where a keyword stands. Only there
is the kind's expression matched, anchored at the hit, so that its matches are those of a left-to-right
search: nothing but a keyword can begin one. Hex runs have no keyword; their prefilter looks for
``HEX_LEAST`` hex digits in a row. Tokens with an embedded CRC-32 in base 62 (kinds ``forge`` and
``registry``) count only if their checksum holds; they are additional spans and never replace others.

Defined results: a null text is empty and has no span; spans are in code points, end exclusive; texts of
any length are scanned whole; repeated rows each get a row; of spans that begin at one place all are told, in the order of
``KINDS``; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, tidy

HEX_LEAST, ACCESS_LEAST, ASSIGN_LEAST = 24, 20, 6
KINDS = ("assign", "access", "hex", "forge", "registry")
BASE_KINDS = KINDS[:3]

# Keywords and expressions of the kinds.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge", "npm_": "registry",
}
ANCHORED = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "forge": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "registry": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_RUN = re.compile(rb"[0-9a-f]+")
_HEX_MARK = bytes(1 if b in b"0123456789abcdef" else 0 for b in range(256))


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def checksum_holds(random: bytes, check: bytes) -> bool:
    """Whether ``check`` is the CRC-32 of ``random`` in six base-62 digits."""
    crc, digits = zlib.crc32(random), b""
    while crc:
        crc, d = divmod(crc, 62)
        digits = BASE62[d : d + 1] + digits
    return digits.rjust(6, b"0") == check


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans of a text: (start, end, kind) in code points, by start and then kind as listed."""
    data = text.encode()
    found: list[tuple[int, int, str]] = []
    ends = dict.fromkeys(KINDS, 0)
    for at, (kind, n) in automaton.iter(data.lower().decode("latin-1")):
        begin = at - n + 1
        if begin < ends[kind] or not (m := ANCHORED[kind].match(data, begin)):
            continue
        ends[kind] = m.end()
        if (
            len(m[1]) >= ASSIGN_LEAST if kind == "assign"
            else m.end() - begin >= ACCESS_LEAST if kind == "access"
            else checksum_holds(m[1], m[2])
        ):
            found.append((begin, m.end(), kind))
    marks, at = data.translate(_HEX_MARK), 0
    while (at := marks.find(b"\1" * HEX_LEAST, at)) >= 0:
        m = _HEX_RUN.match(data, at)
        found.append((at, m.end(), "hex"))
        at = m.end()
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    if len(data) != len(text):
        points, seen = {0: 0}, 0
        for p in sorted({p for s in found for p in s[:2]}):
            points[p] = points[seen] + len(data[seen:p].decode())
            seen = p
        found = [(points[b], points[e], k) for b, e, k in found]
    return found


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, end, kind) of every row."""

    def run(batches):
        automaton = _automaton()
        for b in batches:
            spans = [find(t, automaton) if t else [] for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans], KIND)],
                ["doc_id", "spans"],
            )

    KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, spans array<struct<start: long, end: long, kind: string>>"
    )


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(told([s for s in spans if s[2] in BASE_KINDS]).encode()).hexdigest()
