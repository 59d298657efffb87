"""Ordered and range structures.

Where updates can be undone (sums), the structure is its node paths: an update
is one row for each node it touches, a query one for each node it reads,
and a running sum within a node, by time, answers all queries of all keys
in one sort of n log n rows.  Structures that cannot be undone are machines for
:func:`~loomery.operators.keyed.run_by_key`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.errors import BadRequest


def _path(index: Column, size: int, sign: int) -> Column:
    """Nodes from ``index`` on, each its lowest bit further."""
    start = F.struct(index.cast("long").alias("at"), F.array().cast("array<bigint>").alias("path"))
    steps = F.sequence(F.lit(0), F.lit(max(size, 1).bit_length()))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        return F.struct((at + sign * at.bitwiseAND(-at)).alias("at"), F.array_append(s["path"], at).alias("path"))

    return F.filter(F.aggregate(steps, start, step, lambda s: s["path"]), lambda p: (p > 0) & (p <= size))


def _up(index: Column, size: int) -> Column:
    """Nodes of a binary indexed tree that an update of ``index`` (from 1) touches."""
    return _path(index, size, 1)


def _down(index: Column, size: int) -> Column:
    """Nodes that a prefix up to ``index`` reads."""
    return _path(index, size, -1)


def prefix_sums(updates: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """``(k, q, total, touches)``: sums of ``delta`` over ``index <= upto`` of the updates before each query.

    ``updates`` are ``(k, seq, index, delta)`` and ``queries`` ``(k, seq, q, upto)``,
    indexes from 1 to ``size``; at one ``seq`` updates come first.  ``touches`` counts nodes read.
    """
    long = [F.col("k"), F.col("seq").cast("long").alias("seq")]
    added = updates.select(*long, F.explode(_up(F.col("index").cast("long"), size)).alias("node"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("q"), F.col("delta").cast("long").alias("delta"))
    read = queries.select(*long, F.explode(_down(F.least(F.col("upto").cast("long"), F.lit(size)), size)).alias("node"), F.lit(1).alias("side"), F.col("q").cast("long").alias("q"), F.lit(0).cast("long").alias("delta"))
    by_node = Window.partitionBy("k", "node").orderBy("seq", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = added.unionByName(read).withColumn("held", F.sum("delta").over(by_node)).filter("side = 1")
    found = held.groupBy("k", "q").agg(F.sum("held").alias("total"), F.count("*").alias("touches"))
    return queries.select("k", F.col("q").cast("long").alias("q")).join(found, ["k", "q"], "left").select("k", "q", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("touches", F.lit(0)).alias("touches"))


def range_sums(updates: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """``(k, q, total, touches)`` over ``lo <= index <= hi`` of each query ``(k, seq, q, lo, hi)``."""
    ends = queries.select("k", "seq", (F.col("q") * 2).alias("q"), F.col("hi").alias("upto")).unionByName(queries.select("k", "seq", (F.col("q") * 2 + 1).alias("q"), (F.col("lo") - 1).alias("upto")))
    sign = 1 - F.col("q") % 2 * 2
    return prefix_sums(updates, ends, size).groupBy("k", F.floor(F.col("q") / 2).alias("q")).agg(F.sum(F.col("total") * sign).alias("total"), F.sum("touches").alias("touches"))


def ranged_sums(updates: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """Sums over ranges after adding ``delta`` to whole ranges ``(k, seq, lo, hi, delta)``: two trees, of slopes and of offsets."""
    rises = updates.select("k", "seq", F.col("lo").alias("index"), "delta", (F.col("delta") * (F.col("lo") - 1)).alias("offset"))
    falls = updates.select("k", "seq", (F.col("hi") + 1).alias("index"), (-F.col("delta")).alias("delta"), (-F.col("delta") * F.col("hi")).alias("offset"))
    both = rises.unionByName(falls).filter(F.col("index") <= size)
    ends = queries.select("k", "seq", (F.col("q") * 2).alias("q"), F.col("hi").alias("upto")).unionByName(queries.select("k", "seq", (F.col("q") * 2 + 1).alias("q"), (F.col("lo") - 1).alias("upto")))
    slopes = prefix_sums(both.select("k", "seq", "index", "delta"), ends, size).select("k", "q", F.col("total").alias("slope"))
    offsets = prefix_sums(both.select("k", "seq", "index", F.col("offset").alias("delta")), ends, size).select("k", "q", F.col("total").alias("offset"))
    placed = ends.select("k", F.col("q").cast("long").alias("q"), "upto").join(slopes, ["k", "q"]).join(offsets, ["k", "q"])
    part = (F.col("slope") * F.col("upto") - F.col("offset")) * (1 - F.col("q") % 2 * 2)
    return placed.groupBy("k", F.floor(F.col("q") / 2).alias("q")).agg(F.sum(part).cast("long").alias("total"))


def block_sums(values: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """``(k, q, total)``: sums over ranges where an update *sets* an index: whole blocks and single cells.

    ``values`` are ``(k, seq, index, value)``, the first of an index sets it from 0; at most 2 ``block`` cells and the blocks between are read.
    """
    before = F.lag("value", 1, 0).over(Window.partitionBy("k", "index").orderBy("seq"))
    deltas = values.withColumn("delta", F.col("value") - before)
    at = F.floor(F.col("index") / block)
    nodes = F.array(F.struct(F.lit(0).alias("kind"), F.col("index").cast("long").alias("node")), F.struct(F.lit(1).alias("kind"), at.alias("node")))
    added = deltas.select("k", "seq", F.explode(nodes).alias("n"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("q"), F.col("delta").cast("long").alias("delta"))
    first, last = F.ceil(F.col("lo") / block), F.floor((F.col("hi") + 1) / block)  # whole blocks: first to last - 1

    def cells(low: Column, high: Column, kind: int) -> Column:
        run = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(run, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("node")))

    whole = first < last
    mixed = F.concat(cells(F.col("lo"), first * block - 1, 0), cells(first, last - 1, 1), cells(last * block, F.col("hi"), 0))
    read = queries.select("k", "seq", F.explode(F.when(whole, mixed).otherwise(cells(F.col("lo"), F.col("hi"), 0))).alias("n"), F.lit(1).alias("side"), F.col("q").cast("long").alias("q"), F.lit(0).cast("long").alias("delta"))
    by_node = Window.partitionBy("k", "n").orderBy("seq", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = added.unionByName(read).withColumn("held", F.sum("delta").over(by_node)).filter("side = 1")
    return held.groupBy("k", "q").agg(F.sum("held").alias("total"))


def distinct_counts(values: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """``(k, q, n)``: distinct ``value`` at positions ``lo`` to ``hi`` (from 1), all queries offline.

    A position starts a new value of the range if the one before it with its
    value lies before ``lo``; up to ``hi`` that is a prefix count, less the ``lo - 1`` positions before the range.
    """
    before = F.lag("pos", 1, 0).over(Window.partitionBy("k", "value").orderBy("pos"))
    starts = values.select("k", F.col("pos").alias("seq"), (before + 1).alias("index"), F.lit(1).alias("delta"))
    asked = queries.select("k", F.col("hi").alias("seq"), "q", F.col("lo").alias("upto"))
    counted = prefix_sums(starts, asked, size)
    return counted.join(queries.select("k", F.col("q").cast("long").alias("q"), "lo"), ["k", "q"]).select("k", "q", (F.col("total") - F.col("lo") + 1).alias("n"))


def range_minima(values: DataFrame, queries: DataFrame, longest: int) -> DataFrame:
    """``(k, q, least)`` over positions ``lo <= pos < hi``: a sparse table of runs of 1, 2, 4... and two look-ups a query.

    Ranges are at most ``longest`` wide; an empty one gives null.
    """
    if longest < 1:
        raise BadRequest("ranges hold one position or more")
    levels = longest.bit_length()
    by_key = Window.partitionBy("k").orderBy("pos")
    table = values.select("k", "pos", F.array(*[F.min("value").over(by_key.rowsBetween(0, (1 << j) - 1)) for j in range(levels)]).alias("least"))
    wide = F.col("hi") - F.col("lo")
    asked = queries.filter(wide > 0).withColumn("level", F.floor(F.log2(wide)).cast("int"))
    ends = F.array(F.col("lo").cast("long"), (F.col("hi") - F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    spots = asked.select("k", "q", "level", F.explode(F.array_distinct(ends)).alias("pos"))
    found = spots.join(table.withColumn("pos", F.col("pos").cast("long")), ["k", "pos"]).groupBy("k", "q").agg(F.min(F.get("least", F.col("level"))).alias("least"))
    return queries.select("k", "q").join(found, ["k", "q"], "left")


class SegmentTree:
    """Point updates and folds over ``lo <= index < hi``; an empty range gives the identity."""

    def __init__(self, size: int, identity: int = 1 << 60, combine=min):
        if size < 1:
            raise BadRequest("a tree needs a size")
        self.size, self.identity, self.combine = size, identity, combine
        self.nodes = [identity] * (2 * size)

    def update(self, index: int, value: int) -> None:
        at = index + self.size
        self.nodes[at] = value
        while at > 1:
            at //= 2
            self.nodes[at] = self.combine(self.nodes[2 * at], self.nodes[2 * at + 1])

    def query(self, lo: int, hi: int) -> int:
        left, right, a, b = self.identity, self.identity, lo + self.size, hi + self.size
        while a < b:
            if a % 2:
                left, a = self.combine(left, self.nodes[a]), a + 1
            if b % 2:
                b -= 1
                right = self.combine(self.nodes[b], right)
            a, b = a // 2, b // 2
        return self.combine(left, right)


class LazySegmentTree:
    """Adds to ranges and sums over inclusive ranges; what a whole node owes is kept at the node."""

    def __init__(self, size: int):
        if size < 1:
            raise BadRequest("a tree needs a size")
        self.size, self.total, self.owed = size, [0] * (4 * size), [0] * (4 * size)

    def _visit(self, lo: int, hi: int, delta: int | None, node: int, a: int, b: int) -> int:
        """Sum of the part of ``lo..hi`` in the node's ``a..b``, after adding ``delta`` to it."""
        if hi < a or b < lo:
            return 0
        if lo <= a and b <= hi:
            if delta:
                self.total[node] += delta * (b - a + 1)
                self.owed[node] += delta
            return self.total[node]
        both = min(hi, b) - max(lo, a) + 1
        if delta:
            self.total[node] += delta * both
        mid = (a + b) // 2
        return self._visit(lo, hi, delta, 2 * node, a, mid) + self._visit(lo, hi, delta, 2 * node + 1, mid + 1, b) + (0 if delta else self.owed[node] * both)

    def add_range(self, lo: int, hi: int, delta: int) -> None:
        self._visit(lo, hi, delta, 1, 0, self.size - 1)

    def range_sum(self, lo: int, hi: int) -> int:
        return self._visit(lo, hi, None, 1, 0, self.size - 1)


class SkipList:
    """An ordered set; ``coin()`` decides whether a tower grows by a level."""

    def __init__(self, coin, max_level: int = 16):
        self.coin, self.height, self.visited = coin, max_level, 0
        self.head: list = [None, [None] * max_level]  # a node: key, next nodes by level

    def _before(self, key) -> list:
        path, node, self.visited = [self.head] * self.height, self.head, 0
        for level in reversed(range(self.height)):
            while node[1][level] is not None and node[1][level][0] < key:
                node = node[1][level]
                self.visited += 1
            path[level] = node
        return path

    def contains(self, key) -> bool:
        found = self._before(key)[0][1][0]
        return found is not None and found[0] == key

    def insert(self, key) -> bool:
        path = self._before(key)
        there = path[0][1][0]
        if there is not None and there[0] == key:
            return False
        tall = 1
        while tall < self.height and self.coin():
            tall += 1
        node = [key, [path[level][1][level] for level in range(tall)]]
        for level in range(tall):
            path[level][1][level] = node
        return True

    def to_list(self) -> list:
        out, node = [], self.head[1][0]
        while node is not None:
            out.append(node[0])
            node = node[1][0]
        return out


class Treap:
    """An ordered set as a tree whose shape is that of the keys' priorities (least on top)."""

    def __init__(self, priority):
        self.priority, self.root = priority, None  # a node: key, priority, left, right

    def insert(self, key) -> None:
        path, node = [], self.root
        while node is not None:
            if node[0] == key:
                return
            path.append((node, 2 if key < node[0] else 3))
            node = node[path[-1][1]]
        made = [key, self.priority(key), None, None]
        while path and path[-1][0][1] > made[1]:  # rotate the new node above its parent
            above, side = path.pop()
            above[side], made[5 - side] = made[5 - side], above
        if path:
            path[-1][0][path[-1][1]] = made
        else:
            self.root = made

    def walk(self):
        """``(node, depth)`` of all nodes, by key."""
        stack, node, depth = [], self.root, 1
        while stack or node is not None:
            while node is not None:
                stack.append((node, depth))
                node, depth = node[2], depth + 1
            node, depth = stack.pop()
            yield node, depth
            node, depth = node[3], depth + 1

    def height(self) -> int:
        return max((d for _, d in self.walk()), default=0)

    def heap_property_holds(self) -> bool:
        return all(child is None or child[1] >= n[1] for n, _ in self.walk() for child in n[2:])


class XorTrie:
    """Numbers of ``bits`` bits in a binary trie: the most any of them differs from a query."""

    def __init__(self, bits: int = 31):
        self.bits, self.root = bits, [None, None]

    def insert(self, value: int) -> None:
        if not 0 <= value < 1 << self.bits:
            raise BadRequest(f"{value} does not fit {self.bits} bits")
        node = self.root
        for b in reversed(range(self.bits)):
            side = value >> b & 1
            if node[side] is None:
                node[side] = [None, None]
            node = node[side]

    def max_xor(self, query: int) -> int | None:
        node, out = self.root, 0
        if node == [None, None]:
            return None
        for b in reversed(range(self.bits)):
            want = 1 - (query >> b & 1)
            side = want if node[want] is not None else 1 - want
            out |= (side ^ (query >> b & 1)) << b
            node = node[side]
        return out
