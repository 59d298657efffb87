"""Sketches, range structures and ordered sets against plain definitions."""

import random
from collections import Counter

import pytest

from loomery.errors import BadRequest
from loomery.operators import sketches as k
from loomery.operators import strings, structures
from loomery.operators.keyed import run_by_key, summarise
from loomery.operators.sequence_machines import Halves, LargestRectangle, LongestWithin, Split, Stretch


def stream(rng, n=3000, items=200):
    return [int(rng.paretovariate(1.0)) % items for _ in range(n)]


def fed(summary, items):
    for i in items:
        summary.observe(i)
    return summary


def test_misra_gries_holds_all_frequent_items_alone_and_merged():
    rng = random.Random(1)
    for _ in range(30):
        items = stream(rng)
        heavy = {i for i, n in Counter(items).items() if n * 10 > len(items)}
        parts = [fed(k.MisraGries(10), items[a::3]) for a in range(3)]
        for p in parts[1:]:
            parts[0].merge(p)
        for summary in (fed(k.MisraGries(10), items), parts[0]):
            assert heavy <= set(summary.candidates()) and len(summary.candidates()) < 10 and summary.seen == len(items)
            assert all(n <= Counter(items)[i] for i, n in summary.candidates().items())


@pytest.mark.parametrize("by_age", [False, True])
def test_space_saving_bounds_alone_and_merged(by_age):
    rng = random.Random(2)
    for _ in range(20):
        items = stream(rng)
        true = Counter(items)
        parts = [fed(k.SpaceSaving(20, by_age), items[a::2]) for a in range(2)]
        parts[0].merge(parts[1])
        for summary in (fed(k.SpaceSaving(20, by_age), items), parts[0]):
            assert all(n - over <= true[key] <= n for key, n, over in summary.hitters(20))
            assert {i for i, n in true.items() if n * 20 > len(items)} <= {key for key, _, _ in summary.hitters(20)}
    first = fed(k.SpaceSaving(2, by_age), ["b", "a", "c"])
    assert [key for key, _, _ in first.hitters(2)] == (["c", "a"] if by_age else ["c", "b"])


def test_quantiles_are_near_alone_and_merged():
    rng = random.Random(3)
    for _ in range(10):
        values = [int(rng.expovariate(0.01)) for _ in range(2000)]
        parts = [fed(k.QuantileSummary(100), values[a::4]) for a in range(4)]
        for p in parts[1:]:
            parts[0].merge(p)
        for summary in (fed(k.QuantileSummary(100), values), parts[0]):
            for rank in (0.1, 0.5, 0.9):
                q = summary.quantile(rank)
                assert sum(v < q for v in values) / 2000 - 0.05 <= rank <= sum(v <= q for v in values) / 2000 + 0.05
    with pytest.raises(BadRequest):
        k.QuantileSummary(10).quantile(0.5)


def test_dgim_is_within_a_half_with_few_buckets():
    rng = random.Random(4)
    bits, sketch = [], k.Dgim(100)
    for _ in range(3000):
        bits.append(rng.random() < 0.4)
        sketch.observe(bits[-1])
        assert abs(sketch.estimate() - sum(bits[-100:])) * 2 <= sum(bits[-100:]) and sketch.bucket_count() <= 16


def test_cuckoo_filter_adds_deletes_and_refuses_when_full():
    f = k.CuckooFilter(64)
    added = [i for i in range(1000) if f.add(i)]
    assert 200 < len(added) <= 256 and all(map(f.contains, added)) and f.load() == len(added) / 256
    assert all(f.delete(i) for i in added[::2]) and all(map(f.contains, added[1::2]))
    assert sum(map(f.contains, range(10_000, 11_000))) < 100
    with pytest.raises(BadRequest):
        k.CuckooFilter(3)


def test_range_trees_equal_lists():
    rng = random.Random(5)
    for _ in range(20):
        n = rng.randrange(1, 40)
        minima, sums, low, adds = structures.SegmentTree(n), structures.LazySegmentTree(n), [1 << 60] * n, [0] * n
        for _ in range(200):
            a, b = sorted((rng.randrange(n), rng.randrange(n)))
            if rng.random() < 0.5:
                low[a] = rng.randrange(1000)
                minima.update(a, low[a])
                delta = rng.randrange(-9, 10)
                adds[a : b + 1] = [x + delta for x in adds[a : b + 1]]
                sums.add_range(a, b, delta)
            assert minima.query(a, b) == min(low[a:b], default=1 << 60) and sums.range_sum(a, b) == sum(adds[a : b + 1])


def test_ordered_sets():
    rng = random.Random(6)
    keys = [rng.randrange(500) for _ in range(400)]
    tower, tree, trie = structures.SkipList(lambda: rng.random() < 0.5), structures.Treap(lambda key: hash((key, "p")) % 1000003), structures.XorTrie(10)
    for key in keys:
        tower.insert(key)
        tree.insert(key)
        trie.insert(key)
        assert tree.heap_property_holds()
    assert tower.to_list() == sorted(set(keys)) == [n[0] for n, _ in tree.walk()]
    assert all(tower.contains(x) == (x in set(keys)) for x in range(500)) and tower.visited < 200 and tree.height() < 40
    assert all(trie.max_xor(q) == max(q ^ x for x in keys) for q in range(0, 1024, 7))
    assert structures.XorTrie(3).max_xor(1) is None


def test_strings_equal_definitions():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choices("ab🙂", k=rng.randrange(12)))
        best = max((text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1) if text[i:j] == text[i:j][::-1]), key=len)
        assert strings.longest_palindrome(text) == best
        starts = strings.suffix_array(text)
        assert starts.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        pattern = "".join(rng.choices("ab", k=rng.randrange(1, 3)))
        assert strings.search(text, pattern, starts) == [i for i in range(len(text)) if text.startswith(pattern, i)]
    assert strings.multiply("9" * 5000, "-" + "8" * 6000) == strings.multiply("-" + "8" * 6000, "9" * 5000)
    assert strings.longest_palindrome("x" * 100_000) == "x" * 100_000 and strings.suffix_array("ab" * 50_000)[0] == 99_998


def test_machines_of_sequences():
    rng = random.Random(8)
    for _ in range(200):
        values = [rng.randrange(8) for _ in range(rng.randrange(1, 14))]

        def run(machine):
            for v in values:
                machine.step(v)
            return machine.finish()

        n = len(values)
        runs = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
        assert run(LargestRectangle()) == [(max(min(values[i:j]) * (j - i) for i, j in runs),)]
        longest = max((j - i for i, j in runs if sum(values[i:j]) <= 9), default=0)
        assert run(LongestWithin(9)) == ([(longest,)] if longest else [])
        crossed = sum(values[i] > values[j] for i in range(n) for j in range(i + 1, n))
        assert run(Stretch()) == ([(crossed,)] if crossed else [])
        sums = {0}
        for v in values:
            sums |= {s + v for s in sums}
        total = sum(values)
        assert run(Split()) == [(min(abs(total - 2 * s) for s in sums), total % 2 == 0 and total // 2 in sums)]
        assert run(Halves(11)) == [(11 in sums,)]


class Total:
    def __init__(self):
        self.total, self.merged = 0, 0

    def observe(self, x):
        self.total += x or 0

    def merge(self, other):
        self.total += other.total

    def step(self, x):
        self.total += x or 0
        return [(self.total,)]

    def finish(self):
        return ()


def test_runners_take_null_keys_empty_tables_and_hot_keys(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else i % 2, i, None if i % 5 == 0 else i) for i in range(2000)], "k long, seq long, v long")
    want = {key: sum(i for i in range(2000) if (None if i % 7 == 0 else i % 2) == key and i % 5) for key in (None, 0, 1)}
    assert {r["k"]: r["t"] for r in summarise(rows.repartition(7), "k", "v", Total, lambda s: [(s.total,)], "t long").collect()} == want
    run = run_by_key(rows.repartition(5), ["k"], ["seq"], ["v"], Total, "t long").collect()
    assert len(run) == 2000 and all(max(r["t"] for r in run if r["k"] == key) == total for key, total in want.items())
    assert run_by_key(rows.limit(0), ["k"], ["seq"], ["v"], Total, "t long").collect() == []
    assert summarise(rows.limit(0), "k", "v", Total, lambda s: [(s.total,)], "t long").collect() == []
