"""N-gram Jaccard self-join: components of documents linked at a similarity or more.

The plan, each step over all rows and none gathering a group:

1. Count shingles in a sketch of bounded size.  Its counts, then the shingle's
   value, are one global order, rare first; any order is exact, this one keeps
   common passages out of the prefixes.
2. Two sets can reach ``percent`` only if they share one of their first
   ``n - ceil(percent * n / 100) + 1`` shingles.  Those are the nodes of the first
   level of a prefix tree of *shared* shingles: a node stands for the first shingles, in
   the global order, that all pairs below it have in common, and its depth is their
   partial overlap.  Of two sets the shorter must have a shared shingle early enough for
   a partner of its own length; members that are not early enough for any such
   partner in the node, and nodes left with one member, are dropped.
3. Within a node, pairs must pass the length bound and the
   remaining-length bound from their positions.  Nodes of up to ``SMALL``
   emit such pairs.  Larger nodes pair all members with a few leaders first, and those
   that still span several components with some more.  Only
   connectivity is asked for, so a group of thousands of near copies is then one
   component and costs a few pairs a member; pairs inside one component are skipped.  A node that is
   still open is finished pair by pair with whole sets (step 4 is then done, and only links that join components come out)
   if it is small (against the number of children its members would have), and else
   extended by the next shared shingle: pairs that go on sharing meet in a child, all others part.  So every
   pair is either tested, bounded out, or already connected.
4. Pairs whose parity bits show that they cannot share enough are left out
   (the bound is exact); the others are verified with whole sets: the sets to test against one probe form
   a prefix tree in the global order, walked depth first with the overlap of
   shared prefixes carried over and subtrees left as soon as the
   remaining lengths cannot reach the required overlap.
5. Links and equal sets are joined into components by distributed min-label rounds.

Shingles are compared as 64-bit values (two of n distinct shingles collide with
probability below n*n / 2**65).

Defined results: a null text has no words; documents without words have an
empty set and link with nothing; documents of fewer than five words have one
shingle; repeated ids are one node with all their texts; rows with a
null id get a null component; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.shingles import buffers, chunks, mix, shingle_sets, trim
from loomery.operators.skew import join_back, join_ids
from loomery.plans.components import connected_components
from loomery.sources.staging import discard, staged

SMALL, LEADERS, MORE_LEADERS = 16, 4, 32
#: An open node of up to FULL members, or FULL_CHILDREN times the children of one, is tested pair by pair:
#: comparing a pair by lengths and positions costs some nanoseconds, a child a row.
FULL, FULL_CHILDREN = 2048, 4
#: Members of a large node that one task compares with a few leaders, or with as many others.
BLOCK = 128
_SLICE = 1 << 14
#: Values of either side that one product of sets holds, and its columns.
_VALUES, _COLUMNS = 1 << 19, 1 << 12
_SEEN = 200_000


def prefix_length(n, percent: int):
    """Of numbers, arrays or columns."""
    return n - (F.floor((n * percent + 99) / F.lit(100)) if isinstance(n, Column) else (percent * n + 99) // 100) + 1


def needed_overlap(total, percent: int):
    """Least overlap of two sets with ``total`` elements together."""
    return (percent * total + 99 + percent) // (100 + percent)


def sketch_slots(rows: int) -> int:
    """Slots of the shingle sketch: by the number of rows, 4 MB to 64 MB of counts."""
    return 1 << min(max((4 * max(rows, 1) - 1).bit_length(), 20), 24)


def _slot(values: np.ndarray, slots: int) -> np.ndarray:
    return (values >> np.uint64(40)).astype(np.int64) & (slots - 1)


def _sets(batch_texts: pa.Array):
    """``(first row, offsets, values)`` of the texts, some megabytes at a time."""
    offsets, data = buffers(batch_texts)
    for low, high in chunks(offsets):
        values, at = shingle_sets(offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]])
        yield low, at, values
    trim()


def _signature(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


_MEASURED = "doc long, n long, sig binary, slice long, counts binary"
_MEASURED_ARROW = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("slice", pa.int64()), ("counts", pa.binary())])


def measure(docs: DataFrame, slots: int) -> DataFrame:
    """Set sizes and signatures of all rows, and each task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for low, at, values in _sets(batch.column(1)):
                counts += np.bincount(_slot(values, slots), minlength=slots).astype(np.uint32)
                rows = len(at) - 1
                sigs = [_signature(values[at[i] : at[i + 1]]) if at[i] < at[i + 1] else None for i in range(rows)]
                none = pa.nulls(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, rows), pa.array(np.diff(at)), pa.array(sigs, pa.binary()), none.cast(pa.int64()), none.cast(pa.binary())], schema=_MEASURED_ARROW)
        for k in range(0, slots, _SLICE):
            if counts[k : k + _SLICE].any():
                yield pa.RecordBatch.from_pylist([{"slice": k // _SLICE, "counts": counts[k : k + _SLICE].tobytes()}], _MEASURED_ARROW)

    return docs.mapInArrow(run, _MEASURED)


def merge_sketch(measured: DataFrame, slots: int) -> np.ndarray:
    """Global counts on a fine logarithmic scale, two bytes a slot."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_py(), np.uint32).astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    parts = measured.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(add, "slice long, counts binary")
    out = np.zeros(slots, np.uint64)
    for r in parts.coalesce(16).toLocalIterator():  # slots values in all, one part at a time
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["counts"], np.uint64)
    return np.minimum(np.log2(out + 1.0) * 1024, 65535).astype(np.uint16)


def _ordered(at: np.ndarray, values: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in the global order within each row, and the rows."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, ranks[_slot(values, len(ranks))], row))
    return values[order], row


def postings(docs: DataFrame, ranks, percent: int) -> DataFrame:
    """``(h, doc, n, pos)`` of every shingle of the prefixes; a set a task has seen is not posted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = ranks.value, set()
        for batch in batches:
            ids = batch.column(0)
            for low, at, values in _sets(batch.column(1)):
                n = np.diff(at)
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero(n):
                    key = _signature(values[at[i] : at[i + 1]])
                    if key not in seen and ids[low + int(i)].is_valid:
                        fresh[i] = True
                        seen.add(key)
                if len(seen) > _SEEN:
                    seen.clear()
                values, row = _ordered(at, values, order)
                pos = np.arange(len(values)) - at[row]
                keep = (pos < prefix_length(n, percent)[row]) & fresh[row]
                row = row[keep]
                doc = ids.slice(low, len(n)).fill_null(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[keep].view(np.int64)), pa.array(doc[row]), pa.array(n[row].astype(np.int32)), pa.array(pos[keep].astype(np.int32))],
                    names=["h", "doc", "n", "pos"],
                )

    return docs.mapInArrow(run, "h long, doc long, n int, pos int")


def _possible(n_a, pos_a, n_b, pos_b, level: int, percent: int):
    """The length bound and the remaining-length bound of pairs whose ``level``-th shared shingle is at ``pos``."""
    fits = np.minimum(n_a, n_b) * 100 >= percent * np.maximum(n_a, n_b)
    rest = level + np.minimum(n_a - pos_a - 1, n_b - pos_b - 1)
    return fits & (rest >= needed_overlap(n_a + n_b, percent))


def nodes(posted: DataFrame, level: int, percent: int) -> DataFrame:
    """``(h, doc, n, pos, f)``: members that can have a partner in their node, and how many there are.

    The shorter of a pair has at least ``needed_overlap(2 n)`` shingles from its
    shared ones on, and the longer what the shortest such partner asks.
    """
    by_node = Window.partitionBy("h")
    rest = F.lit(level) + F.col("n") - F.col("pos") - 1

    def needed(total: Column) -> Column:
        return F.floor((total * percent + 99 + percent) / F.lit(100 + percent))

    short = rest >= needed(2 * F.col("n"))
    seen = posted.withColumn("f", F.count("*").over(by_node)).withColumn("least", F.min(F.when(short, F.col("n"))).over(by_node)).filter("f > 1")
    partner = F.greatest("least", F.ceil(F.col("n") * F.lit(percent) / F.lit(100)))
    long = (F.col("least") <= F.col("n")) & (rest >= needed(F.col("n") + partner))
    kept = seen.filter(short | F.coalesce(long, F.lit(False))).drop("f", "least")
    return kept.withColumn("f", F.count("*").over(by_node)).filter("f > 1")


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    keyed = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keyed[:, 0]), pa.array(keyed[:, 1])], names=["a", "b"])


def small_pairs(members: DataFrame, level: int, percent: int) -> DataFrame:
    """All possible pairs of nodes of up to ``SMALL`` members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            block = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("h", "doc", "n", "pos")])
            if held is not None:
                block = np.concatenate([held, block], axis=1)
            cut = int(np.flatnonzero(block[0] != block[0, -1])[-1]) + 1 if (block[0] != block[0, -1]).any() else 0
            held = block[:, cut:]
            yield pairs(block[:, :cut])
        if held is not None:
            yield pairs(held)

    def pairs(x: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero(x[0, :-d] == x[0, d:]) if x.shape[1] > d else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + d
            ok = (x[1, i] != x[1, j]) & _possible(x[2, i], x[3, i], x[2, j], x[3, j], level, percent)
            left.append(x[1, i[ok]])
            right.append(x[1, j[ok]])
        return _pair_batch(np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64))

    return members.select("h", "doc", "n", "pos").repartition("h").sortWithinPartitions("h", "doc").mapInArrow(run, "a long, b long")


def leader_pairs(members: DataFrame, low: int, high: int, level: int, percent: int) -> DataFrame:
    """Possible pairs of the ``low``-th to ``high``-th members of each node, by id, with
    the members after them in other components.

    A node is dealt out in blocks.  The first
    ``high`` of each block hold the first ``high`` of the node, and those that
    lead are sent to all its blocks, so a hot node is spread over many tasks and
    each holds the leaders alone.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("f") / BLOCK)).cast("int")
    dealt = members.select("h", "doc", "n", "pos", "comp", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    first = dealt.withColumn("r", F.row_number().over(Window.partitionBy("h", "block").orderBy("doc"))).filter(F.col("r") <= high)
    led = first.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("doc"))).filter(F.col("r").between(low + 1, high))
    sent = led.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "doc", "n", "pos", "comp")
    rows = sent.unionByName(dealt.select("h", "block", F.lit(1).alias("side"), "doc", "n", "pos", "comp"))

    return _compared(rows, level, percent)


def _compared(rows: DataFrame, level: int, percent: int) -> DataFrame:
    """Possible pairs of the leaders (side 0) of each block and its members after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, led = None, []
        for batch in batches:
            place = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("h", "block", "side")])
            block = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("doc", "n", "pos", "comp")])
            for part in np.split(np.arange(place.shape[1]), np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1):
                if not len(part):
                    continue
                group, side, own = tuple(place[:2, part[0]].tolist()), place[2, part[0]], block[:, part]
                if group != now:
                    now, led = group, []
                if side == 0:
                    led.append(own)
                    continue
                step = max(1, 2_000_000 // len(part))
                for leaders in led:
                    for k in range(0, leaders.shape[1], step):
                        l, m = leaders[:, k : k + step, None], own[:, None, :]
                        i, j = np.nonzero((l[0] < m[0]) & (l[3] != m[3]) & _possible(l[1], l[2], m[1], m[2], level, percent))
                        if len(i):
                            yield _pair_batch(leaders[0, k : k + step][i], own[0][j])

    return rows.repartition("h", "block").sortWithinPartitions("h", "block", "side", "doc").mapInArrow(run, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``: a product of their incidence matrices.

    Some sets and some columns are taken at a time, so memory is bounded by the sets.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    for rows in _runs(left):
        for columns in _runs(right):
            own = left[rows] + right[columns]
            values, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(v) for v in own])
            order = np.argsort(values, kind="stable")
            code = np.cumsum(np.diff(values[order], prepend=values[order[0]]) != 0)
            twice = np.bincount(code)[code] > 1
            owner, code = owner[order][twice], code[twice]
            code = np.cumsum(np.diff(code, prepend=code[:1]) != 0)
            cut, some = len(left[rows]), np.zeros((len(left[rows]), len(right[columns])), np.int64)
            for k in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
                x = np.zeros((len(own), _COLUMNS), np.float32)
                part = slice(*np.searchsorted(code, (k, k + _COLUMNS)))
                x[owner[part], code[part] - k] = 1
                some += (x[:cut] @ x[cut:].T).astype(np.int64)  # whole numbers up to _COLUMNS, exact
            out[rows, columns] = some
    return out


def _runs(sets: list[np.ndarray]) -> Iterator[slice]:
    """Slices of ``sets`` with up to ``_VALUES`` values, or one set."""
    low, held = 0, 0
    for k, values in enumerate(sets):
        if k > low and held + len(values) > _VALUES:
            yield slice(low, k)
            low, held = k, 0
        held += len(values)
    yield slice(low, len(sets))


def linked_sets(left: list[np.ndarray], right: list[np.ndarray], asked: np.ndarray, percent: int) -> np.ndarray:
    """Of the pairs marked in ``asked``, those that link: parity bits first, then whole sets."""
    out = np.zeros(asked.shape, bool)
    rows, columns = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
    if not len(rows):
        return out
    asked, left, right = asked[np.ix_(rows, columns)], [left[i] for i in rows], [right[j] for j in columns]
    n, m = np.array([len(v) for v in left]), np.array([len(v) for v in right])
    need = needed_overlap(n[:, None] + m, percent)
    size = parity_size(max(n.max(), m.max()))
    x, y = (np.stack([np.frombuffer(parity_bits(v, size), np.uint8) for v in own]) for own in (left, right))
    for i in range(len(left)):
        odd = np.bitwise_count(x[i] ^ y).sum(axis=1, dtype=np.int64)
        asked[i] &= (n[i] + m - odd) // 2 >= need[i]
    i, j = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
    if len(i):
        at = np.ix_(i, j)
        out[np.ix_(rows[i], columns[j])] = asked[at] & (overlaps([left[k] for k in i], [right[k] for k in j]) >= need[at])
    return out


class Forest:
    """Components joined so far; a link within one is not needed."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (parent := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(parent, parent)
            x = parent
        return x

    def joining(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The places of those links of ``a`` and ``b`` that join two components."""
        kept = []
        for k in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0, return_index=True)[1].tolist() if len(a) else []:
            p, q = self.root(int(a[k])), self.root(int(b[k]))
            if p != q:
                self.up[max(p, q)] = min(p, q)
                kept.append(k)
        return kept


def full_pairs(members: DataFrame, level: int, percent: int) -> DataFrame:
    """Pairs of members of each node in different components: the possible ones, or, of
    members with their whole sets in ``items``, links that connect all that link.

    A node's members are dealt into parts of about ``BLOCK``; every two parts, and each with
    itself, are one cell, so that all cells are of one size whatever the node's.  With sets, every possible
    pair of a cell is tested there and a cell gives fewer links than it has members, however
    many of its pairs are possible or link.
    """
    whole = ["items"] if "items" in members.columns else []
    parts = F.greatest(F.lit(1), F.ceil(F.col("f") / BLOCK)).cast("int")
    dealt = members.select("h", "doc", "n", "pos", "comp", *whole, parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    met = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = (F.col("part") > F.col("met")).cast("int").alias("side")
    rows = met.select("h", F.least("part", "met").alias("block"), F.greatest("part", "met").alias("other"), side, "doc", "n", "pos", "comp", *whole)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
        now, held, sets = None, [], []
        for batch in batches:
            place = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("h", "block", "other")])
            own = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("side", "doc", "n", "pos", "comp")])
            for part in np.split(np.arange(place.shape[1]), np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1):
                if not len(part):
                    continue
                group = tuple(place[:, part[0]].tolist())
                if held and group != now:
                    yield now[1] == now[2], np.concatenate(held, axis=1), sets
                    held, sets = [], []
                now = group
                held.append(own[:, part])
                if whole:
                    sets += [np.frombuffer(batch.column("items")[int(i)].as_py(), np.uint64) for i in part]
        if held:
            yield now[1] == now[2], np.concatenate(held, axis=1), sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for alone, (side, doc, n, pos, comp), sets in cells(batches):
            left, forest = np.flatnonzero(side == 0), Forest()
            right = left if alone else np.flatnonzero(side == 1)
            step = max(1, 2_000_000 // max(len(right), 1))
            for k in range(0, len(left), step):
                l, m = left[k : k + step, None], right[None, :]
                asked = ((doc[l] < doc[m]) if alone else (doc[l] != doc[m])) & (comp[l] != comp[m]) & _possible(n[l], pos[l], n[m], pos[m], level, percent)
                if whole:
                    asked = linked_sets([sets[i] for i in l[:, 0]], [sets[j] for j in right], asked, percent)
                i, j = np.nonzero(asked)
                a, b = l[i, 0], right[j]
                if whole:
                    kept = forest.joining(comp[a], comp[b])
                    a, b = a[kept], b[kept]
                if len(a):
                    yield _pair_batch(doc[a], doc[b])

    return rows.repartition("h", "block", "other").sortWithinPartitions("h", "block", "other").mapInArrow(run, "a long, b long")


def with_sets(docs: DataFrame, ranks, members: DataFrame) -> DataFrame:
    """Members with their whole sets in the global order, ``items``."""
    ends = staged(members.select("doc").distinct(), "jaccard-members")
    sets = ordered_sets(join_ids(docs, ends, "doc", "left_semi"), ranks).select("doc", F.col("n").alias("whole"), "items")
    # An id with several texts has several sets; a node's member is the one of its size.
    return members.join(sets, "doc").filter("n = whole").drop("whole")


def children(docs: DataFrame, ranks, members: DataFrame, level: int, percent: int) -> DataFrame:
    """The members of open nodes, posted once for each shingle that may be their next shared one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, doc, pos = (batch.column(k).to_numpy() for k in ("h", "doc", "pos"))
            for i, items in enumerate(batch.column("items")):
                values = np.frombuffer(items.as_py(), np.uint64)
                n, low = len(values), int(pos[i]) + 1
                nexts = values[low : prefix_length(n, percent) + level]
                if not len(nexts):
                    continue
                made = mix(nexts + mix(h[i : i + 1].view(np.uint64)))
                columns = [pa.array(made.view(np.int64)), *(pa.array(np.full(len(nexts), x, k)) for x, k in ((doc[i], np.int64), (n, np.int32)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(low, low + len(nexts), dtype=np.int32))], names=["h", "doc", "n", "pos"])

    joined = with_sets(docs, ranks, members.select("h", "doc", "n", "pos")).select("h", "doc", "pos", "items")
    return joined.mapInArrow(run, "h long, doc long, n int, pos int")


class PrefixTree:
    """Sets in the global order as a trie: sorted sequences and the prefix each shares with the one before."""

    STEP = 256

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda k: sequences[k].byteswap().tobytes())
        self.sequences = [sequences[k] for k in self.order]
        self.shared = [0]
        for x, y in zip(self.sequences, self.sequences[1:], strict=False):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def linked(self, probe: np.ndarray, percent: int) -> list[bool]:
        """For each sequence (in input order), whether its Jaccard similarity with ``probe`` reaches ``percent``."""
        found = np.sort(probe)
        out = [False] * len(self.order)
        run: np.ndarray | None = None  # overlap after each element of the current path
        for k, sequence in enumerate(self.sequences):
            n, shared = len(sequence), self.shared[k]
            need = int(needed_overlap(n + len(found), percent))
            depth = min(shared, len(run) if run is not None else 0)
            path = run[:depth] if run is not None else np.zeros(0, np.int64)
            overlap = int(path[-1]) if depth else 0
            pieces = [path]
            while depth < n:
                if overlap + min(n - depth, len(found) - overlap) < need:
                    break
                part = sequence[depth : depth + self.STEP]
                at = np.minimum(np.searchsorted(found, part), len(found) - 1)
                hits = overlap + np.cumsum(found[at] == part)
                pieces.append(hits)
                overlap = int(hits[-1])
                depth += len(part)
            run = np.concatenate(pieces)
            out[self.order[k]] = depth == n and overlap >= need
        return out


def parity_size(n: int) -> int:
    return max(1 << max(int(n) - 1, 1).bit_length(), 512)


def parity_bits(values: np.ndarray, size: int | None = None) -> bytes:
    """A bit for each of ``size`` buckets, or about as many as values: whether an odd number of values falls there."""
    size = size or parity_size(len(values))
    odd = np.bincount((values >> np.uint64(8)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """The most two sets can share: each bucket of odd difference holds a value of one set alone."""
    x, y = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def _ends(pairs: DataFrame) -> DataFrame:
    return staged(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "jaccard-ends")


def ordered_sets(docs: DataFrame, ranks) -> DataFrame:
    """``(doc, n, bits, items)``: the whole sets in the global order, and their parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, at, values in _sets(batch.column(1)):
                values, _ = _ordered(at, values, ranks.value)
                own = [values[at[i] : at[i + 1]] for i in range(len(at) - 1)]
                columns = [pa.array(np.diff(at)), pa.array([parity_bits(v) for v in own], pa.binary()), pa.array([v.tobytes() for v in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(own)), *columns], names=["doc", "n", "bits", "items"])

    return docs.mapInArrow(run, "doc long, n long, bits binary, items binary").filter("n > 0")


def verify(docs: DataFrame, ranks, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: those whose parity bits allow it, tested with whole sets."""
    sets = staged(ordered_sets(join_ids(docs, _ends(pairs), "doc", "left_semi"), ranks), "jaccard-sets")

    def sides(rows: DataFrame, *columns: str) -> list[DataFrame]:
        return [rows.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in ("a", "b")]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [overlap_bound(n, x, m, y) >= needed_overlap(n + m, percent) for n, x, m, y in zip(*[batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sides(sets, "n", "bits")
    close = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    pairs = staged(close.mapInArrow(bound, "a long, b long").distinct(), "jaccard-close")
    left, right = sides(join_ids(sets, _ends(pairs), "doc", "left_semi"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("b").to_numpy()
            order = np.argsort(b, kind="stable")
            found_a, found_b = [], []
            for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
                if not len(part):
                    continue
                for probe in {batch.column("items_b")[int(i)].as_py() for i in part}:
                    own = [int(i) for i in part if batch.column("items_b")[int(i)].as_py() == probe]
                    tree = PrefixTree([np.frombuffer(batch.column("items_a")[i].as_py(), np.uint64) for i in own])
                    for i, good in zip(own, tree.linked(np.frombuffer(probe, np.uint64), percent), strict=True):
                        if good:
                            found_a.append(batch.column("a")[i].as_py())
                            found_b.append(int(b[i]))
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
    links = staged(joined.mapInArrow(run, "a long, b long").distinct(), "jaccard-links")
    discard(sets)
    return links


def jaccard_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    slots = sketch_slots(docs.count())
    measured = staged(measure(slim, slots), "jaccard-measured")
    ranks = spark.sparkContext.broadcast(merge_sketch(measured, slots))  # at most 32 MB
    rows = measured.filter("slice is null").select("doc", "n", "sig")

    level = 1
    members = staged(nodes(postings(slim, ranks, percent), level, percent), "jaccard-nodes")
    first = _first_pairs(members.withColumn("comp", F.col("doc")), level, percent)
    edges = verify(slim, ranks, staged(first.distinct(), "jaccard-pairs"), percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    same = rows.filter("sig is not null and doc is not null").groupBy("sig").agg(F.min("doc").alias("least"), F.count("*").alias("size")).filter("size > 1")
    same = staged(same, "jaccard-same")
    total = same.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    equal = join_back(rows.filter("doc is not null"), same, "sig", "size", total, "inner").select(F.col("doc").alias("src"), F.col("least").alias("dst"))
    edges = staged(edges.unionByName(equal).filter("src <> dst").distinct(), "jaccard-edges")
    labels = staged(connected_components(edges), "jaccard-labels")

    led = LEADERS
    while True:
        large = members.filter(F.col("f") > SMALL)  # smaller nodes are tested in full
        named = large.join(labels.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc", "left")
        named = named.withColumn("comp", F.coalesce("comp", "doc"))
        # Children of a member: the places left in its prefix.
        wide = F.avg(prefix_length(F.col("n"), percent) + level - F.col("pos") - 1)
        of_node = named.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), F.min("n").alias("least"), wide.alias("wide"))
        # Where sets may share no more than the node's depth there may be no next shingle.
        full = (F.col("m") <= F.greatest(F.lit(FULL), FULL_CHILDREN * F.col("wide"))) | (F.lit(level) >= F.ceil(F.col("least") * F.lit(percent) / F.lit(100)))
        open_ = staged(of_node.filter("low <> high").select("h", full.alias("full")), "jaccard-open-nodes")
        parts = {r["full"] for r in open_.select("full").distinct().collect()}
        if not parts:
            break
        found, links = [], []
        if led < MORE_LEADERS:
            members = staged(join_ids(named, open_.select("h"), "h", "left_semi"), "jaccard-open")
            found.append(leader_pairs(members, led, MORE_LEADERS, level, percent))
            members, led, parts = members.drop("comp"), MORE_LEADERS, set()
        if True in parts:
            rest = staged(join_ids(named, open_.filter("full").select("h"), "h", "left_semi"), "jaccard-open")
            links.append(staged(full_pairs(with_sets(slim, ranks, rest), level, percent).distinct(), "jaccard-links"))
        if False in parts:
            deeper = staged(join_ids(named, open_.filter("not full").select("h"), "h", "left_semi"), "jaccard-open")
            level, led = level + 1, LEADERS
            members = staged(nodes(children(slim, ranks, deeper, level - 1, percent), level, percent), "jaccard-nodes")
            known = deeper.select("doc", "comp").distinct()
            found.append(_first_pairs(members.join(known, "doc"), level, percent))
        if found:
            pairs = staged(reduce(DataFrame.unionByName, found).distinct(), "jaccard-pairs")
            if pairs.limit(1).collect():
                links.append(verify(slim, ranks, pairs, percent))
        more = reduce(DataFrame.unionByName, links).select(F.col("a").alias("src"), F.col("b").alias("dst")) if links else None
        if more is not None and more.limit(1).collect():
            # The old labels stand for the old edges.
            stars = labels.filter("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
            labels = staged(connected_components(stars.unionByName(more)), "jaccard-labels")
        if parts == {True}:
            break

    named = rows.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    return named.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _first_pairs(members: DataFrame, level: int, percent: int) -> DataFrame:
    """Pairs of new nodes: all of the small ones, those with leaders of the large ones."""
    small, large = members.filter(F.col("f") <= SMALL), members.filter(F.col("f") > SMALL)
    return small_pairs(small, level, percent).unionByName(leader_pairs(large, 0, LEADERS, level, percent))
