"""Range structures and ordered sets over each user's log of updates (all kinds but ``purchase``) and queries (``purchase``)."""

from __future__ import annotations

import hashlib
from itertools import count

from loomery.operators import structures as s
from loomery.operators.keyed import run_by_key
from loomery.suites.frames import frame
from loomery.suites.machines import DUCK_EVENTS

SIZE = 16
_EV = f"WITH ev AS ({DUCK_EVENTS})"
_ADDS = f"SELECT k, seq, v % {SIZE} + 1 AS index, v AS delta, v AS value FROM {{ev}} WHERE kind <> 'purchase'"
_SPANS = "SELECT k, seq, v % 8 + 1 AS lo, v % 8 + 1 + seq % 9 AS hi, v AS delta FROM {ev} WHERE kind <> 'purchase'"
_ASKS = "SELECT k, seq, seq AS q, v % 8 + 1 AS lo, v % 8 + 1 + seq % 9 AS hi FROM {ev} WHERE kind = 'purchase'"
_PLACES = "SELECT k, seq, v, CAST(row_number() OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS pos, count(*) OVER (PARTITION BY k) AS n FROM {ev}"


def _of(spark, sf_dir, text):
    return spark.sql(text, ev=frame(spark, sf_dir, "ev"))


def fenwick(spark, sf_dir):
    return s.range_sums(_of(spark, sf_dir, _ADDS), _of(spark, sf_dir, _ASKS), SIZE)


def fenwickrange(spark, sf_dir):
    return s.ranged_sums(_of(spark, sf_dir, _SPANS), _of(spark, sf_dir, _ASKS), SIZE + 1)


def sqrtdecomp(spark, sf_dir):
    return s.block_sums(_of(spark, sf_dir, _ADDS), _of(spark, sf_dir, _ASKS), 4)


def mos(spark, sf_dir):
    places = _of(spark, sf_dir, f"SELECT k, pos, v % 12 AS value, pos AS q, pos AS lo, least(n, pos + seq % 20) AS hi, n FROM ({_PLACES}) x")
    longest = places.agg({"n": "max"}).first()[0] or 1
    return s.distinct_counts(places.select("k", "pos", "value"), places.select("k", "q", "lo", "hi"), longest + 1)


def sparsetable(spark, sf_dir):
    places = _of(spark, sf_dir, f"SELECT k, pos, v AS value, pos AS q, pos AS lo, least(n + 1, pos + seq % 16) AS hi FROM ({_PLACES}) x")
    return s.range_minima(places.select("k", "pos", "value"), places.select("k", "q", "lo", "hi"), SIZE)


class _Minima:
    def __init__(self):
        self.tree = s.SegmentTree(SIZE + 1)

    def step(self, seq, kind, v):
        if kind == "purchase":
            return [(seq, self.tree.query(v % 8 + 1, v % 8 + 1 + seq % 9))]
        self.tree.update(v % SIZE + 1, v)
        return ()

    def finish(self):
        return ()


class _Sums:
    def __init__(self):
        self.tree = s.LazySegmentTree(SIZE + 2)

    def step(self, seq, kind, v):
        lo, hi = v % 8 + 1, v % 8 + 1 + seq % 9
        if kind == "purchase":
            return [(seq, self.tree.range_sum(lo, hi))]
        self.tree.add_range(lo, hi, v)
        return ()

    def finish(self):
        return ()


def _hash(x: int) -> int:
    return int(hashlib.sha256(str(x).encode()).hexdigest()[:8], 16)


class _Listed:
    def __init__(self):
        flips = count()
        self.list = s.SkipList(lambda: _hash(next(flips)) % 2 == 1)

    def step(self, v):
        self.list.insert(v)
        return ()

    def finish(self):
        keys = self.list.to_list()
        return [(len(keys), ",".join(map(str, keys)), all(map(self.list.contains, keys)) and not self.list.contains(-1))]


class _Treed:
    def __init__(self):
        self.tree = s.Treap(_hash)

    def step(self, v):
        self.tree.insert(v)
        return ()

    def finish(self):
        keys = [n[0] for n, _ in self.tree.walk()]
        return [(len(keys), keys[0], keys[-1], self.tree.root[0], self.tree.height(), self.tree.heap_property_holds() and keys == sorted(keys))]


class _Differing:
    def __init__(self):
        self.trie, self.best = s.XorTrie(), 0

    def step(self, v):
        self.trie.insert(v)
        self.best = max(self.best, self.trie.max_xor(v))
        return ()

    def finish(self):
        return [(self.best,)]


def _machine(make, inputs, schema):
    return lambda spark, sf_dir: run_by_key(frame(spark, sf_dir, "ev"), ["k"], ["seq"], inputs, make, schema)


QUERIES = {f.__name__: f for f in (fenwick, fenwickrange, sqrtdecomp, mos, sparsetable)} | {
    "segmenttree": _machine(_Minima, ["seq", "kind", "v"], "q long, least long"),
    "lazysegtree": _machine(_Sums, ["seq", "kind", "v"], "q long, total long"),
    "skiplist": _machine(_Listed, ["v"], "n long, keys_in_order string, found boolean"),
    "treap": _machine(_Treed, ["v"], "nodes long, least long, most long, root long, height long, holds boolean"),
    "xortrie": _machine(_Differing, ["v"], "best long"),
}
_PLAIN = _EV + f", u AS ({_ADDS}), s AS ({_SPANS}), q AS ({_ASKS}), p AS ({_PLACES}) ".replace("{ev}", "ev")
_PLAIN = _PLAIN.replace("{ev}", "ev")
_SPAN_SUM = "SELECT q.k, q.q, CAST(coalesce(sum(s.delta * greatest(0, least(s.hi, q.hi) - greatest(s.lo, q.lo) + 1)), 0) AS BIGINT) AS total FROM q LEFT JOIN s ON s.k = q.k AND s.seq < q.seq GROUP BY q.k, q.q"
_LATEST = "(SELECT q.k, q.q, u.index, arg_max(u.value, u.seq) AS value FROM q JOIN u ON u.k = q.k AND u.seq < q.seq AND u.index {} GROUP BY q.k, q.q, u.index) x"
ORACLES = {
    "fenwick": _PLAIN + "SELECT q.k, q.q, CAST(coalesce(sum(u.delta), 0) AS BIGINT) AS total, CAST(any_value(bit_count(q.hi) + bit_count(q.lo - 1)) AS BIGINT) AS touches FROM q LEFT JOIN u ON u.k = q.k AND u.seq < q.seq AND u.index BETWEEN q.lo AND q.hi GROUP BY q.k, q.q",
    "fenwickrange": _PLAIN + _SPAN_SUM,
    "lazysegtree": _PLAIN + _SPAN_SUM,
    "sqrtdecomp": _PLAIN + "SELECT q.k, q.q, CAST(coalesce(t.total, 0) AS BIGINT) AS total FROM q LEFT JOIN (SELECT k, q, sum(value) AS total FROM " + _LATEST.format("BETWEEN q.lo AND q.hi") + " GROUP BY k, q) t ON t.k = q.k AND t.q = q.q",
    "segmenttree": _PLAIN + "SELECT q.k, q.q, CAST(coalesce(t.least, 1152921504606846976) AS BIGINT) AS least FROM q LEFT JOIN (SELECT k, q, min(value) AS least FROM " + _LATEST.format(">= q.lo AND u.index < q.hi") + " GROUP BY k, q) t ON t.k = q.k AND t.q = q.q",
    "mos": _PLAIN + "SELECT a.k, a.pos AS q, count(DISTINCT b.v % 12) AS n FROM p a JOIN p b ON a.k = b.k AND b.pos BETWEEN a.pos AND least(a.n, a.pos + a.seq % 20) GROUP BY a.k, a.pos",
    "sparsetable": _PLAIN + "SELECT a.k, a.pos AS q, min(b.v) AS least FROM p a LEFT JOIN p b ON a.k = b.k AND b.pos >= a.pos AND b.pos < least(a.n + 1, a.pos + a.seq % 16) GROUP BY a.k, a.pos",
    "skiplist": _EV + " SELECT k, count(*) AS n, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS keys_in_order, TRUE AS found FROM (SELECT DISTINCT k, v FROM ev) x GROUP BY k",
    # A key lies above another if none between them has a lesser priority.
    "treap": _EV + """, d AS (SELECT DISTINCT k, v, CAST(CAST(concat('0x', substr(sha256(CAST(v AS VARCHAR)), 1, 8)) AS UBIGINT) AS BIGINT) AS p FROM ev),
        above AS (SELECT x.k, x.v, y.v AS a FROM d x JOIN d y ON x.k = y.k JOIN d z ON z.k = x.k AND z.v BETWEEN least(x.v, y.v) AND greatest(x.v, y.v) GROUP BY x.k, x.v, y.v, y.p HAVING min(z.p) = y.p)
        SELECT d.k, count(*) AS nodes, min(v) AS least, max(v) AS most, arg_min(v, p) AS root, any_value(h.height) AS height, TRUE AS holds FROM d JOIN (SELECT k, max(n) AS height FROM (SELECT k, v, count(*) AS n FROM above GROUP BY k, v) g GROUP BY k) h ON h.k = d.k GROUP BY d.k""",
    "xortrie": _EV + " SELECT a.k, max(xor(a.v, b.v)) AS best FROM ev a JOIN ev b ON a.k = b.k GROUP BY a.k",
}
