"""String and number algorithms that need more than expressions, over Arrow batches of texts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_palindrome(text: str) -> str:
    """The longest palindrome, the earliest of equals, in linear time."""
    gaps = "\0" + "\0".join(text) + "\0" if text else ""
    reach, centre, right, best = [0] * len(gaps), 0, 0, (0, 0)
    for i in range(len(gaps)):
        r = min(right - i, reach[2 * centre - i]) if i < right else 0
        while i - r - 1 >= 0 and i + r + 1 < len(gaps) and gaps[i - r - 1] == gaps[i + r + 1]:
            r += 1
        reach[i] = r
        if i + r > right:
            centre, right = i, i + r
        if r > best[0]:
            best = (r, i)
    n, at = best
    return text[(at - n) // 2 : (at - n) // 2 + n]


def suffix_array(text: str) -> np.ndarray:
    """Starts of all suffixes in the order of their code points, by ranks of doubling prefixes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(n - width, 0)] = rank[width:]
        order = np.lexsort((after, rank))
        first, second = rank[order], after[order]
        fresh = np.concatenate(([0], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.sum() == n - 1:
            return order
        width *= 2


def search(text: str, pattern: str, starts: np.ndarray) -> list[int]:
    """Places of a pattern, in order, from a suffix array."""

    def bound(beyond: bool) -> int:
        low, high = 0, len(starts)
        while low < high:
            mid = (low + high) // 2
            own = text[starts[mid] : starts[mid] + len(pattern)]
            if own < pattern or (beyond and own == pattern):
                low = mid + 1
            else:
                high = mid
        return low

    return sorted(int(i) for i in starts[bound(False) : bound(True)])


def multiply(x: str, y: str) -> str:
    """The product of two decimal numbers of any length."""
    sys.set_int_max_str_digits(0)
    return str(int(x) * int(y))


def _mapped(rows: DataFrame, columns: list[str], one, kind: str, out: str) -> DataFrame:
    """``rows`` with ``one(*values)`` as column ``out``; a null among the values gives null."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    slim = rows.select(*rows.columns)
    places = [rows.columns.index(c) for c in columns]
    typed = {"string": pa.string(), "array<bigint>": pa.list_(pa.int64())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*[batch.column(p).to_pylist() for p in places], strict=True)
            made = [None if None in v else one(*v) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, typed)], names=[*batch.schema.names, out])

    return slim.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), f"{out} {kind}"]))


def palindromes(texts: DataFrame, text_col: str, out: str = "palindrome") -> DataFrame:
    return _mapped(texts, [text_col], longest_palindrome, "string", out)


def suffix_arrays(texts: DataFrame, text_col: str, out: str = "starts") -> DataFrame:
    return _mapped(texts, [text_col], lambda t: suffix_array(t).tolist(), "array<bigint>", out)


def products(rows: DataFrame, x: str, y: str, out: str = "product") -> DataFrame:
    return _mapped(rows.withColumns({x: F.col(x).cast("string"), y: F.col(y).cast("string")}), [x, y], multiply, "string", out)
