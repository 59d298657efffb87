"""Graph plans and per-graph algorithms against independent brute force."""

import itertools
import random

import pytest

from loomery.errors import Stopped
from loomery.operators import small_graphs as g
from loomery.plans import graphs
from loomery.plans.components import connected_components


def random_edges(rng, n, most, low=1):
    return [(a, b, rng.randrange(low, 11)) for a in range(n) for b in range(n) if a != b and rng.random() < most]


def test_max_flow_equals_the_least_cut():
    rng = random.Random(97)
    for _ in range(200):
        n = rng.randrange(2, 7)
        edges = random_edges(rng, n, 0.5, 0)
        cut = min(sum(c for a, b, c in edges if a in side and b not in side) for r in range(n - 1) for extra in itertools.combinations(range(1, n - 1), r) for side in [{0, *extra}])
        assert g.max_flow(edges, 0, n - 1) == cut


def pieces(nodes, edges):
    left, count = set(nodes), 0
    while left:
        stack, count = [left.pop()], count + 1
        while stack:
            x = stack.pop()
            for a, b, *_ in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and q in left:
                        left.discard(q)
                        stack.append(q)
    return count


def test_bridges_and_cut_points():
    rng = random.Random(3)
    for _ in range(150):
        edges = [(a, b, 1) for a, b, _ in random_edges(rng, rng.randrange(2, 7), 0.25)]
        nodes = {x for a, b, _ in edges for x in (a, b)}
        found = g.cuts(edges)
        base = pieces(nodes, edges)
        assert found["bridges"] == [k for k in range(len(edges)) if pieces(nodes, edges[:k] + edges[k + 1 :]) > base]
        assert found["points"] == [x for x in sorted(nodes) if pieces(nodes - {x}, [e for e in edges if x not in e[:2]]) > base]


def test_assignment_matching_and_trails():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randrange(1, 6)
        cost = [[rng.randrange(-5, 20) for _ in range(n)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        total, columns = g.assignment(cost)
        assert total == best and sorted(columns) == list(range(n))
        pairs = [(a, b) for a in range(n) for b in range(n) if rng.random() < 0.4]
        most = max(sum((i, p[i]) in pairs for i in range(n)) for p in itertools.permutations(range(n)))
        assert g.greedy_matching(pairs) <= g.matching(pairs) == most
    trail = g.euler_trail([(0, 1), (1, 2), (2, 0), (0, 3)])
    assert trail and sorted(zip(trail, trail[1:], strict=False)) == [(0, 1), (0, 3), (1, 2), (2, 0)]
    assert g.euler_trail([(0, 1), (2, 3)]) is None


def test_spanning_weight_stable_pairs_and_rollback():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(2, 6)
        edges = random_edges(rng, n, 0.5)
        nodes = {x for a, b, _ in edges for x in (a, b)}
        trees = pieces(nodes, edges)
        need = len(nodes) - trees
        best = min((sum(e[2] for e in some) for some in itertools.combinations(edges, need) if pieces(nodes, some) == trees), default=0) if len(edges) < 14 else None
        weight, found = g.spanning_weight(edges)
        assert found == trees and (best is None or weight == best)
        a = {p: rng.sample(range(n), n) for p in range(n)}
        b = {r: rng.sample(range(n), n) for r in range(n)}
        pairs = g.stable_pairs(a, b)
        back = {r: p for p, r in pairs.items()}
        assert not any(a[p].index(r) < a[p].index(pairs[p]) and b[r].index(p) < b[r].index(back[r]) for p in a for r in b)
    sets = g.RollbackSets()
    sets.union(1, 2)
    sets.union(2, 3)
    sets.rollback(1)
    assert sets.find(1) == sets.find(2) != sets.find(3)


def test_closures_and_components(spark):
    rng = random.Random(7)
    rows = [(k, a, b, w) for k in range(5) for a, b, w in random_edges(rng, 7, 0.2)]
    edges = spark.createDataFrame(rows, "group long, src long, dst long, w long")
    paths = {(r["group"], r["src"], r["dst"]): r["w"] for r in graphs.shortest_paths(edges).collect()}
    for k in range(5):
        d = {(a, b): w for g_, a, b, w in rows if g_ == k}
        for m in range(7):
            for a in range(7):
                for b in range(7):
                    if (a, m) in d and (m, b) in d:
                        d[a, b] = min(d.get((a, b), 10**9), d[a, m] + d[m, b])
        assert {(a, b): w for (g_, a, b), w in paths.items() if g_ == k} == d
    strong = {(r["group"], r["node"]): r["component"] for r in graphs.strong_components(edges).collect()}
    for (k, x), c in strong.items():
        assert c == min([x] + [y for y in range(7) if (k, x, y) in paths and (k, y, x) in paths])
    with pytest.raises(Stopped):
        graphs.longest_paths(spark.createDataFrame([(0, 1, 2, 1), (0, 2, 1, 1)], "group long, src long, dst long, w long"), 6)


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(8)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(500, 500 + k) for k in range(1, 40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, None), (9, 9)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert out == {x: find(x) for x in list(parent)}


def test_components_of_a_chain_whose_ids_rise_and_fall(spark):
    ids = [*range(0, 500, 2), *range(499, 0, -2)]
    out = connected_components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")).collect()
    assert {(r["node"], r["component"]) for r in out} == {(k, 0) for k in range(500)} and len(out) == 500


def test_hull_and_alias_table():
    rng = random.Random(9)
    for _ in range(200):
        points = [(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(1, 12))]
        corners = g.hull(points)

        def outside(p, a, b):
            return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

        if len(corners) > 2:
            sides = list(zip(corners, corners[1:] + corners[:1], strict=True))
            assert all(outside(p, a, b) >= 0 for p in points for a, b in sides)
            assert all(outside(c, a, b) > 0 for a, b in sides for c in corners if c not in (a, b))
        weights = [rng.randrange(0, 9) for _ in range(rng.randrange(1, 7))]
        if sum(weights):
            shares = [0.0] * len(weights)
            for i, (keep, other) in enumerate(g.alias_table(weights)):
                shares[i] += keep / len(weights)
                shares[other] += (1 - keep) / len(weights)
            assert all(abs(s_ - w / sum(weights)) < 1e-9 for s_, w in zip(shares, weights, strict=True))
