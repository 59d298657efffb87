"""Byte-level BPE as a monoid over text: encode halves, join, and repair the seam.

A node of the tree is a stretch of text with its token ids.  Leaves of a few
words are encoded directly; two neighbours are joined by re-encoding a window
around the seam that grows outwards until the tokens outside are provably those
of the joined text.  There are two proofs:

* A *cut* is a position after a non-space character and before a space, tab or
  line end, or between an ASCII letter and an ASCII digit.  No match of the splitting
  pattern contains one (white space appears only as a match's first character or in
  matches of white space alone, and the look-ahead of the latter never looks past a
  non-space), so tokens on both sides of it do not depend on each other.  Most seams
  lie inside one word and end here.
* Where no cut is near (scripts without spaces, long blobs), the pattern splits
  the stretch between the nearest cuts as one text and as two; matches that both
  ways have keep their ids.  A match made of one match from each side is joined
  token by token: the window doubles until the pairs of tokens at both its edges
  encode to themselves.  A sequence in which every two neighbours do is the
  encoding of its bytes: take the first merge that would cross a border between
  two tokens; up to then the merges inside these two are those of the pair
  alone, of which it would be the least too, so the pair would not encode to itself.

Decoding concatenates bytes up a tree of halves.

Defined results: a null text counts as empty and has no ids; empty, very
long and repeated texts need no special case; a null doc_id is passed through;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.shingles import trim

#: About ten words, and as many ids as they have at most.
LEAF_CHARS, LEAF_IDS = 64, 64
#: How far from a seam a cut counts as near.
NEAR = 64
_PAIRS = 1 << 18
_CUT = r"(?<=\S)(?<![\x1c-\x1f])(?=[ \n\t\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
_NEXT_CUT, _LAST_CUT = regex.compile(_CUT), regex.compile("(?r)" + _CUT)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class TreeCodec:
    """Encodes and decodes by the ranks of a file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS):
        import tiktoken

        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.leaf = max(leaf, 1)
        self.split = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _cut(text: str, at: int) -> bool:
        return text[at] in " \n\t\r" and not text[at - 1].isspace()

    def _agree(self, one: int, two: int) -> bool:
        """Whether the bytes of two tokens encode to these two."""
        known = self.pairs.get((one, two))
        if known is None:
            if len(self.pairs) > _PAIRS:
                self.pairs.clear()
            known = self.pairs[one, two] = self._piece(self.tokens[one] + self.tokens[two]) == [one, two]
        return known

    def _piece(self, raw: bytes) -> list[int]:
        return self.plain._encode_single_piece(raw)

    def repair(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two encoded halves of one match of the pattern."""
        if not left or not right or self._agree(left[-1], right[0]):
            return left + right
        take, more = 1, 1
        while True:
            a, b = max(len(left) - take, 0), min(more, len(right))
            window = self._piece(b"".join([self.tokens[i] for i in left[a:] + right[:b]]))
            before = a == 0 or self._agree(left[a - 1], window[0])
            after = b == len(right) or self._agree(window[-1], right[b])
            if before and after:
                return left[:a] + window + right[b:]
            take, more = take if before else take * 2, more if after else more * 2

    def _matches(self, text: str, low: int, high: int, ids: list[int]) -> dict[tuple[int, int], list[int]] | None:
        """The pattern's matches of a stretch with their ids; None if a token crosses their borders."""
        out, at = {}, 0
        for m in self.split.finditer(text[low:high]):
            missing, first = len(m[0].encode()), at
            while missing > 0 and at < len(ids):
                missing -= len(self.tokens[ids[at]])
                at += 1
            if missing:
                return None
            out[low + m.start(), low + m.end()] = ids[first:at]
        return out if at == len(ids) else None

    def _far(self, text: str, start: int, seam: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of a stretch without a cut near the seam, from those of its two sides."""
        # Classes of letters are the same in both pattern engines for characters as old as these.
        settled = all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in set(text[start:end]))
        one = self._matches(text, start, seam, left) if settled else None
        two = self._matches(text, seam, end, right) if settled else None
        if one is None or two is None:
            return self.plain.encode_ordinary(text[start:end])
        ends = {a: b for a, b in one}
        out: list[int] = []
        for m in self.split.finditer(text[start:end]):
            a, b = start + m.start(), start + m.end()
            half = ends.get(a)
            if (a, b) in one:
                out += one[a, b]
            elif (a, b) in two:
                out += two[a, b]
            elif half is not None and (half, b) in two:
                out += self.repair(one[a, half], two[half, b])
            else:
                out += self._piece(m[0].encode())
        return out

    def _join(self, text: str, low: int, seam: int, high: int, left: list[int], right: list[int]) -> list[int]:
        start, end = seam, seam
        while start > low and not self._cut(text, start):
            start -= 1
            if seam - start > NEAR:
                found = _LAST_CUT.search(text, low + 1, start)
                start = found.start() if found else low
                break
        while end < high and not self._cut(text, end):
            end += 1
            if end - seam > NEAR:
                found = _NEXT_CUT.search(text, end, high)
                end = found.start() if found and found.start() < high else high
                break
        if start == end:
            return left + right
        tokens = self.tokens
        keep, missing = len(left), len(text[start:seam].encode())
        while missing > 0:
            keep -= 1
            missing -= len(tokens[left[keep]])
        skip, more = 0, len(text[seam:end].encode())
        while more > 0:
            more -= len(tokens[right[skip]])
            skip += 1
        if seam - start <= NEAR and end - seam <= NEAR:
            window = self.plain.encode_ordinary(text[start:end])
        else:
            window = self._far(text, start, seam, end, left[keep:], right[:skip])
        return left[:keep] + window + right[skip:]

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self.plain.encode_ordinary(text[low:high])
        seam = (low + high) // 2
        return self._join(text, low, seam, high, self._encode(text, low, seam), self._encode(text, seam, high))

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _codec(path: str, pattern: str, leaf: int) -> TreeCodec:
    key = (path, pattern, leaf)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = TreeCodec(read_ranks(path), pattern, leaf)
    return _CODECS[key]


_CODECS: dict[tuple, TreeCodec] = {}


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern, leaf)
        for batch in batches:
            trim()
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                ids = [codec.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return slim.mapInArrow(encode, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """Encode and decode in one pass: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern, leaf)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for t in batch.column(1):
                ids = codec.encode(t.as_py() or "")
                counts.append(len(ids))
                digits = codec.digits
                coded.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], names=names)
            trim()

    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
