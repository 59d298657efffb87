"""Benchmark decontamination, in DataFrame expressions only.

For every benchmark item, windows of documents as long as the item (in words)
are fingerprinted with a 64-bit SimHash of their 5-word shingles.  Fingerprints
of one window length are matched with the items' through a multi-index:
``RADIUS + 1`` blocks of bits, of which two fingerprints within the radius must
agree in one (pigeonhole), so all within it are found.  Candidates are verified
by the weighted Jaccard similarity of the shingles, weights being multiplicities.
A document shorter than an item is one window as a whole, of its own length.

Not every window is fingerprinted.  A window of an item's length can reach the
similarity only if at least ``least_shared`` of its positions hold a shingle of
some item of that length, and a shorter document only if as many of its positions do as
the similarity asks of both lengths; a bit table of the benchmark's shingles finds
documents that can have such windows in the scan itself, and only these go on.

Blocks of three or four bits select little by themselves, so the index is keyed by a
block and an *anchor*.  Shingles are ordered by the number of items of one length that
hold them, rare first, then by value; two multisets that share at least o of their n
shingles share one of the first n - o + 1 of both.  These are the anchors, and a
window meets only items with an equal anchor and an equal block.

Both bounds lose nothing.  At a similarity of exactly 0.8 a fingerprint differs in about
9.7 bits with a deviation of 2.9, so a radius of 19 holds all but about 1 in 2,000 such
windows, and a leak has several; a document shorter than the item has only one.

The bit table grows with the benchmark and is sent with the plan, so it is used
up to ``MAX_TABLE_SHINGLES`` shingles; beyond, shingles are joined by shuffling.

Words are lower-cased runs of letters and digits.  Defined results: null texts
and items without words match nothing; items of fewer than five words have
their whole sequence as one shingle; repeated rows give repeated-row matches
under one (doc_id, item_id), and so do benchmark rows of one id, each tested by
itself; an empty table on either side gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.sources.staging import staged

WIDTH, PERCENT, RADIUS = 5, 80, 19
MAX_TABLE_SHINGLES = 1 << 19
_GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words; the split leaves an empty string at most at either end."""
    return F.split(F.lower(text), _GAP)


def _trimmed(w: Column) -> Column:
    first = (F.get(w, F.lit(0)) == "").cast("int")
    last = ((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == "")).cast("int")
    return F.slice(w, first + 1, F.size(w) - first - last)


def _shingles(w: Column, width: int) -> Column:
    """Hashes of all ``width``-word shingles, in order."""
    at = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))


def least_shared(n: Column, percent: int = PERCENT) -> Column:
    """Shingles two windows of n each must share: ceil(2 n p / (100 + p))."""
    return F.ceil(n * F.lit(2 * percent) / F.lit(100 + percent)).cast("int")


def _can_reach(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m that share so many can reach the similarity."""
    return shared * (100 + percent) >= (n + m) * percent


def simhash(shingles: Column) -> Column:
    """Bit b is set when it is set in more than half of the hashes."""

    def vote(out: Column, b: Column) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return out.bitwiseOR(F.when(ones * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), vote)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """``radius + 1`` structs of block number and bits that cover all 64."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    parts = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("bits"))
        for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))
    ]
    return F.array(*parts)


def _counted(shingles: Column) -> Column:
    """A multiset as a set: each hash with the number of equal ones before it."""
    ordered = F.sort_array(shingles)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i.cast("bigint") - F.array_position(ordered, h)))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    split = benchmark.select(F.col(id_col).cast("long").alias("item_id"), _trimmed(words(F.col(text_col))).alias("w")).filter(F.size("w") > 0)
    shingles = F.when(F.size("w") >= WIDTH, _shingles(F.col("w"), WIDTH)).otherwise(F.array(F.xxhash64("w")))
    rows = split.select("item_id", F.size("w").alias("length"), F.least(F.size("w"), F.lit(WIDTH)).alias("width"), shingles.alias("shingles"))
    return rows.withColumn("item", F.monotonically_increasing_id()).withColumn("fingerprint", simhash(F.col("shingles"))).withColumn("counted", _counted(F.col("shingles")))


def _bit_table(gate: DataFrame, count: int) -> tuple[Column, int]:
    """A constant array of longs with one bit for each shingle, at least 8 bits a shingle."""
    bits = 1 << min(max((64 * count - 1).bit_length(), 16), 22)
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    cells = gate.select(F.shiftright(slot, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    table = [0] * (bits // 64)
    for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect():  # at most bits / 64 rows
        table[r["cell"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), bits


def _candidates(docs: DataFrame, gate: DataFrame, width: int, shortest: int, longest: int, percent: int) -> DataFrame:
    """Documents in which ``shortest`` gate positions lie within ``longest`` words, and
    those shorter than ``longest`` with enough of them for an item of one word more:
    ``(key, doc_id, shingles, hits)``."""
    hashed = F.transform(F.transform(F.array(words(F.col("text"))), _trimmed), lambda w: _shingles(w, width))
    gate = gate.filter(F.col("width") == width).select("h").distinct()
    count = gate.count()

    def close(hits: Column, n: Column) -> Column:
        ends = F.sequence(F.lit(0), F.size(hits) - shortest)
        near = F.exists(ends, lambda k: F.get(hits, k + (shortest - 1)) - F.get(hits, k) <= longest - width)
        part = (n <= longest - width) & _can_reach(F.size(hits), n, n + 1, percent)
        return F.when(F.size(hits) >= shortest, near).otherwise(F.lit(False)) | part

    if count <= MAX_TABLE_SHINGLES:
        table, bits = _bit_table(gate, count)

        def held(h: Column) -> Column:
            cell = F.shiftright(h, 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int")
            return F.getbit(F.get(table, cell), h.bitwiseAND(F.lit(63)).cast("int")) == 1

        def places(shingles: Column) -> Column:
            at = F.when(F.size(shingles) > 0, F.sequence(F.lit(0), F.size(shingles) - 1)).otherwise(F.array().cast("array<int>"))
            return F.struct(shingles.alias("shingles"), F.filter(at, lambda i: held(F.get(shingles, i))).alias("hits"))

        # One generator over nested lambdas: every step is evaluated once a row, and no
        # filter on a derived array can be pushed down and repeat it.
        kept = F.filter(F.transform(hashed, places), lambda x: close(x["hits"], F.size(x["shingles"])))
        found = docs.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.shingles", "x.hits")
        return found.withColumn("key", F.monotonically_increasing_id())
    keyed = staged(docs.select("doc_id", F.explode(hashed).alias("shingles")).withColumn("key", F.monotonically_increasing_id()), "decon-hashed")
    places = keyed.select("key", F.size("shingles").alias("n"), F.posexplode("shingles").alias("at", "h")).join(gate, "h", "left_semi")
    listed = staged(places.groupBy("key", "n").agg(F.sort_array(F.collect_list("at")).alias("hits")), "decon-hits")
    return keyed.join(listed.filter(close(F.col("hits"), F.col("n"))).drop("n"), "key")


def _windows(found: DataFrame, gate: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """``(key, doc_id, length, start, shingles)`` of all windows that can reach the similarity.

    ``length`` is the item's; a document shorter than that is one window from 0.
    """
    marks = F.transform("hits", lambda i: F.struct(i.alias("at"), F.get("shingles", i).alias("h")))
    places = found.select("key", F.size("shingles").alias("n"), F.explode(marks).alias("m")).select("key", "n", "m.at", "m.h")
    exact = places.join(gate.filter(F.col("width") == width).select("h", "length", "held"), "h")
    marked = F.sort_array(F.collect_set(F.struct("at", "held", "h"))).alias("marks")
    runs = exact.groupBy("key", "length", "n").agg(marked).withColumn("at", F.col("marks.at")).join(sizes, "length")
    span = F.col("length") - width  # the last shingle starts this far into the window
    enough = runs.filter(F.size("at") >= F.col("least"))

    def starts(k: Column) -> Column:
        last, first = F.get("at", k + F.col("least") - 1), F.get("at", k)
        low = F.greatest(last - span, F.lit(0))
        return F.when(low <= first, F.sequence(low, F.greatest(first, low))).otherwise(F.array().cast("array<int>"))

    every = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("least")), starts)))
    placed = enough.select("key", "length", "n", "marks", F.explode(every).alias("start")).filter(F.col("start") + span < F.col("n"))
    part = runs.filter((F.col("n") <= span) & _can_reach(F.size("at"), F.col("n"), span + 1, percent))
    placed = placed.unionByName(part.select("key", "length", "n", "marks", F.lit(0).alias("start")))
    size = F.least(F.col("n"), span + 1)
    inside = F.filter("marks", lambda m: (m["at"] >= F.col("start")) & (m["at"] <= F.col("start") + span))
    rare = F.sort_array(F.transform(inside, lambda m: F.struct(m["held"].alias("held"), m["h"].alias("h"))))
    # Shingles no item holds come first in the order and leave the fewer places to the others.
    open_ = size - _overlap(size, span + 1, percent) + 1 - (size - F.size(inside))
    anchors = F.array_distinct(F.slice(rare, 1, F.greatest(open_, F.lit(0)))["h"])
    placed = placed.select("key", "length", "start", anchors.alias("anchors")).filter(F.size("anchors") > 0)
    whole = placed.join(found.select("key", "doc_id", "shingles"), "key")
    return whole.select("key", "doc_id", "length", "start", "anchors", F.slice("shingles", F.col("start") + 1, F.col("length") - (width - 1)).alias("shingles"))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Shingles that multisets of n and m must share to reach the similarity."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent)).cast("int")


def _index(items: DataFrame, gate: DataFrame, percent: int, radius: int) -> DataFrame:
    """One row for each item, anchor and block: ``(length, a, b, item, item_id, n_item, item_print, item_counted)``."""
    n = F.size("shingles")
    listed = items.select("item", "length", "width", n.alias("n"), F.explode("shingles").alias("h")).join(gate, ["width", "length", "h"])
    rare = F.sort_array(F.collect_list(F.struct("held", "h")))
    # The least two sets can share is what the larger asks of one that it holds.
    first = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).cast("int") + 1
    anchors = listed.groupBy("item", "n").agg(rare.alias("rare")).select("item", F.explode(F.array_distinct(F.slice("rare", 1, first)["h"])).alias("a"))
    kept = items.select("item", "item_id", "length", n.alias("n_item"), F.col("fingerprint").alias("item_print"), F.col("counted").alias("item_counted"), F.explode(blocks(F.col("fingerprint"), radius)).alias("b"))
    return kept.join(anchors, "item")


def near_items(printed: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """Windows and items with an anchor and a block in common and fingerprints within the radius."""
    cells = F.flatten(F.transform("anchors", lambda a: F.transform(blocks(F.col("fingerprint"), radius), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    probes = printed.select("key", "doc_id", "length", "start", "fingerprint", F.explode(cells).alias("c")).select("*", "c.*").drop("c")
    near = probes.join(index, ["length", "a", "b"]).withColumn("hamming", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))).filter(F.col("hamming") <= radius)
    return near.select("key", "length", "start", "item", "item_id", "n_item", "hamming", "item_counted").dropDuplicates(["key", "length", "start", "item"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, similarity, window_start, hamming)``: the best window of each match."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = staged(_items(benchmark, item_col, item_text), "decon-items")
    gate = staged(items.select("item", "width", "length", F.explode(F.array_distinct("shingles")).alias("h")).groupBy("width", "length", "h").agg(F.count("*").alias("held")), "decon-gate")
    sizes = items.select("width", "length", least_shared(F.size("shingles"), percent).alias("least")).distinct()
    out = None
    bounds = sizes.groupBy("width").agg(F.min("least").alias("least"), F.max("length").alias("longest")).collect()  # at most five rows
    index = staged(_index(items, gate, percent, radius), "decon-index")
    for bound in bounds:
        width = bound["width"]
        found = staged(_candidates(docs, gate, width, bound["least"], bound["longest"], percent), "decon-found")
        windows = _windows(found, gate, sizes.filter(F.col("width") == width).select("length", "least"), width, percent)
        printed = staged(windows.withColumn("fingerprint", simhash(F.col("shingles"))), "decon-windows")
        pairs = near_items(printed, index, radius)
        tested = pairs.join(printed.select("key", "doc_id", "length", "start", "shingles"), ["key", "length", "start"])
        shared = F.size(F.array_intersect(_counted(F.col("shingles")), F.col("item_counted")))
        scored = tested.select("doc_id", "item_id", "start", "hamming", shared.alias("shared"), (F.size("shingles") + F.col("n_item") - shared).alias("whole"))
        good = scored.filter(F.col("shared") * 100 >= F.col("whole") * percent)
        out = good if out is None else out.unionByName(good)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, window_start int, hamming int")
    best = F.max(F.struct((F.col("shared") / F.col("whole")).alias("similarity"), (-F.col("start")).alias("back"), (-F.col("hamming")).alias("far")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("window_start"), (-F.col("best.far")).alias("hamming")
    )
