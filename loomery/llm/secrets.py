"""Secret scan: patterns, and a token-efficiency test for random strings.

Natural language and identifiers cost few tokens for their length under a BPE
vocabulary; keys and passwords do not.  Runs of 20 or more credential
characters with at least one letter are measured in characters per token; below
``MAX_RATIO`` a run is reported, unless it is a known digest (hex of a usual
digest's length), a UUID, an identifier of words, in the caller's list
of known strings, or already inside a pattern's span.  What looks like an
identifier is one only if each of its letter groups has ``MAX_RATIO``
characters per token or more on its own.

Defined results: a null text counts as empty; spans are in code points, end
exclusive; a null doc_id is passed through; repeated rows are reported once
each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
MIN_RUN, MAX_RATIO = 20, 2.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run is maximal, so shorter matches fail alike
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_ALL_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
# Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
# Words of two letters or more and short numbers; possessive, so it never backtracks.
_IDENTIFIER = re.compile(r"(?:[-_/=+]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]{1,4}+))++\Z")
_LETTERS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")  # its letter groups
_HEX_CLASS = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"hhhhhhhhhhhhhhhh" in text.encode("latin-1", "replace").translate(_HEX_CLASS):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def looks_named(run: str, known: frozenset[str] = frozenset()) -> bool:
    """Whether a run is a digest, a UUID, or listed."""
    if run in known or _UUID.match(run):
        return True
    return len(run) in _DIGEST_LENGTHS and bool(_ALL_HEX.match(run))


class TokenEfficiency:
    """Characters per token under a rank file's vocabulary."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        from loomery.llm.bpe import read_ranks

        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})

    def ratio(self, run: str) -> float:
        return len(run) / max(len(self.plain.encode_ordinary(run)), 1)

    def of_words(self, run: str) -> bool:
        """Whether a run is an identifier whose letter groups are all efficient themselves."""
        return bool(_IDENTIFIER.match(run)) and all(self.ratio(group) >= MAX_RATIO for group in _LETTERS.findall(run))

    def spans(self, text: str, base: list[tuple[int, int, int]], max_ratio: float, known: frozenset[str]) -> list[tuple[int, int, int]]:
        out, at, reach = [], 0, 0
        ordered = sorted((s, e) for s, _, e in base)
        for m in _RUN.finditer(text):
            run = m[0]
            while at < len(ordered) and ordered[at][0] < m.end():
                reach, at = max(reach, ordered[at][1]), at + 1
            if reach > m.start() or not any(c.isalpha() for c in run) or looks_named(run, known):
                continue
            if self.ratio(run) < max_ratio and not self.of_words(run):
                out.append((m.start(), 3, m.end()))
        return out


def scan_secrets(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO, known: frozenset[str] = frozenset()) -> DataFrame:
    """``(doc_id, spans array<struct<kind,start,end>>)`` of every row, in order of start, then kind."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TokenEfficiency(ranks, pattern)
        for batch in batches:
            found = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + test.spans(text, base, max_ratio, known))
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return slim.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")
