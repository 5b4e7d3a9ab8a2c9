"""Secrets in whole texts: an automaton of keywords finds where to look, anchored patterns decide there, embedded checksums confirm.

An Aho-Corasick automaton over all keywords reads each text once, in lower case. A pattern is tried only where one of its keywords begins, anchored
there; a keyword inside an earlier match of its kind doesn't count, so the matches are the leftmost ones that don't overlap. Long
hexadecimal runs have no keyword: their letters are folded into one class, and 32 of that class in a row are the keyword.

The base kinds are assignments, access keys and hexadecimal runs. Kinds with a checksum in the token itself (``CHECKED``) are added: 30 characters of base 62 and the
crc32 of them in six more. Of their matches those whose checksum disagrees are dropped.

Patterns and keywords are ASCII, so all works on UTF-8 bytes, and the few spans found are counted in code points at the end.

Defined cases: a null text is empty and has no spans; a null doc_id stays null; rows that repeat are rows of the result each; texts are read whole
however long, in memory linear in the text; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
#: Keywords in lower case, of the kinds that have one. The names and prefixes that the kinds are known by.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{36})"),
}
CHECKED = ("github", "npm")
#: Least characters of an assigned value, an access key and a hexadecimal run.
VALUE, ACCESS, HEX = 8, 16, 32
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HEXES = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_RUN = b"\1" * HEX

Span = tuple[int, int, int]


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (KINDS.index(kind), len(w)))
    found.make_automaton()
    return found


def checksum(body: bytes) -> str:
    """The crc32 of body as six digits of base 62."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(1) - m.start(1) >= VALUE
    if kind == "access":
        return m.end() - m.start() >= ACCESS
    return checksum(m[1][:30]).encode() == m[1][30:]


def _runs(raw: bytes) -> Iterator[Span]:
    """Maximal hexadecimal runs of HEX characters or more."""
    folded = raw.translate(_HEXES)
    at = folded.find(_RUN)
    while at >= 0:
        end = folded.find(b"\0", at)
        end = len(raw) if end < 0 else end
        yield at, KINDS.index("hex"), end
        at = folded.find(_RUN, end)


def find_spans(text: str) -> list[Span]:
    """(start, index of the kind, end) of every secret, by start and kind, in code points."""
    raw = text.encode()
    hits = sorted((end - n + 1, k) for end, (k, n) in _automaton().iter(raw.translate(_LOWER).decode("latin-1")))
    spans, free = list(_runs(raw)), [0] * len(KINDS)
    for at, k in hits:
        if at >= free[k] and (m := PATTERNS[KINDS[k]].match(raw, at)):
            free[k] = m.end()
            if _valid(KINDS[k], m):
                spans.append((at, k, m.end()))
    spans.sort()
    if len(raw) == len(text) or not spans:
        return spans
    place, points, at = {}, 0, 0
    for b in sorted({x for s, _, e in spans for x in (s, e)}):
        points, at = points + len(raw[at:b].decode()), b
        place[b] = points
    return [(place[s], k, place[e]) for s, k, e in spans]


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    return map_arrow(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each secret in text replaced by mark; spans that overlap are replaced together. A null text stays null."""

    def clean(text: str) -> str:
        out, at = [], 0
        for s, _, e in find_spans(text):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array([None if t is None else clean(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return map_arrow(docs, run, docs.schema.simpleString()[7:-1])


def scan_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: counts and a digest of the base kinds, and all spans as text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, told = [[] for _ in range(BASE)], [], []
            for t in b.column(1):
                spans = find_spans(t.as_py())
                for k in range(BASE):
                    counts[k].append(sum(1 for s in spans if s[1] == k))
                digests.append(hashlib.sha256(_told([s for s in spans if s[1] < BASE]).encode()).hexdigest())
                told.append(_told(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(told, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(docs.select("doc_id", text_of().alias("text")), run, schema)
