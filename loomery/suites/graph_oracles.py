"""SQL of the whole-graph queries by enumeration: cuts, permutations, removals, on six nodes a graph.

Edges of one graph are directed and distinct; ``u`` takes them both ways.
"""

from __future__ import annotations

_UNDIRECTED = ", u AS (SELECT grp, src AS a, dst AS b FROM edges UNION SELECT grp, dst, src FROM edges), nodes AS (SELECT DISTINCT grp, a AS node FROM u)"
_MASKS = ", masks AS (SELECT unnest(generate_series(0, 63)) AS m)"
_PERMUTED = """, perms(n, taken) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL SELECT n + 1, list_append(taken, x) FROM perms JOIN (SELECT unnest(generate_series(0, 5)) AS x) d ON NOT list_contains(taken, x) WHERE n < 6),
    p AS (SELECT row_number() OVER () AS id, taken FROM perms WHERE n = 6), seats AS (SELECT id, i, CAST(taken[i + 1] AS BIGINT) AS j FROM p CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS i) d), groups AS (SELECT DISTINCT grp FROM edges)"""
# Nodes that are the least they reach are one for each component.
_WITHOUT_NODE = """, gone AS (SELECT grp, node AS x FROM nodes UNION ALL SELECT DISTINCT grp, -1 FROM nodes),
    walk(grp, x, a, b) AS (SELECT n.grp, g.x, n.node, n.node FROM nodes n JOIN gone g ON g.grp = n.grp AND g.x <> n.node UNION SELECT w.grp, w.x, w.a, u.b FROM walk w JOIN u ON u.grp = w.grp AND u.a = w.b AND u.b <> w.x),
    parts AS (SELECT grp, x, count(*) AS n FROM (SELECT grp, x, a FROM walk GROUP BY 1, 2, 3 HAVING min(b) = a) l GROUP BY 1, 2)"""
_WITHOUT_EDGE = """, numbered AS (SELECT grp, src, dst, row_number() OVER (PARTITION BY grp ORDER BY src, dst) AS e FROM edges), both_ways AS (SELECT grp, e, src AS a, dst AS b FROM numbered UNION ALL SELECT grp, e, dst, src FROM numbered),
    gone AS (SELECT grp, e AS x FROM numbered UNION ALL SELECT DISTINCT grp, 0 FROM numbered),
    walk(grp, x, a, b) AS (SELECT n.grp, g.x, n.node, n.node FROM nodes n JOIN gone g ON g.grp = n.grp UNION SELECT w.grp, w.x, w.a, u.b FROM walk w JOIN both_ways u ON u.grp = w.grp AND u.a = w.b AND u.e <> w.x),
    parts AS (SELECT grp, x, count(*) AS n FROM (SELECT grp, x, a FROM walk GROUP BY 1, 2, 3 HAVING min(b) = a) l GROUP BY 1, 2)"""
# Ends that lighter edges join already; of equal weights the one first by its ends is lighter.
_LIGHTER = """, numbered AS (SELECT grp, src, dst, w, row_number() OVER (PARTITION BY grp ORDER BY {order}) AS e FROM edges), both_ways AS (SELECT grp, e, src AS a, dst AS b FROM numbered UNION ALL SELECT grp, e, dst, src FROM numbered),
    walk(grp, e, b) AS (SELECT grp, e, src FROM numbered UNION SELECT w.grp, w.e, u.b FROM walk w JOIN both_ways u ON u.grp = w.grp AND u.a = w.b AND u.e < w.e),
    tree AS (SELECT n.* FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.grp = n.grp AND w.e = n.e AND w.b = n.dst))"""
_STABLE = """, rated AS (SELECT g.grp, s.a, s.b, coalesce(e.w, 999) AS far, coalesce(e.w, 0) AS near FROM groups g CROSS JOIN (SELECT i AS a, j AS b FROM seats GROUP BY 1, 2) s LEFT JOIN edges e ON e.grp = g.grp AND e.src = s.a AND e.dst = s.b),
    ranked AS (SELECT grp, a, b, row_number() OVER (PARTITION BY grp, a ORDER BY far, b) AS likes, row_number() OVER (PARTITION BY grp, b ORDER BY near DESC, a) AS liked FROM rated),
    chosen AS (SELECT r.grp, s.id, r.a, r.b, r.likes, r.liked FROM seats s JOIN ranked r ON r.a = s.i AND r.b = s.j),
    broken AS (SELECT DISTINCT x.grp, x.id FROM chosen x JOIN chosen y ON x.grp = y.grp AND x.id = y.id AND x.a <> y.a JOIN ranked z ON z.grp = x.grp AND z.a = x.a AND z.b = y.b WHERE z.likes < x.likes AND z.liked < y.liked),
    stable AS (SELECT c.grp, c.id, sum(c.likes) AS cost, string_agg(concat(c.a, '-', c.b), ',' ORDER BY c.a) AS pairs FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.grp = c.grp AND b.id = c.id) GROUP BY 1, 2)"""


def _least_cut(source: int, sink: int) -> str:
    return f"""{_MASKS} SELECT grp, min(c) AS flow FROM (SELECT grp, m, CAST(coalesce(sum(w) FILTER ((m >> src) & 1 = 1 AND (m >> dst) & 1 = 0), 0) AS BIGINT) AS c FROM edges CROSS JOIN masks WHERE (m >> {source}) & 1 = 1 AND (m >> {sink}) & 1 = 0 GROUP BY 1, 2) x GROUP BY grp"""


def oracles(head: str, events: str) -> dict[str, str]:
    """``head`` opens a recursive statement up to the frame ``edges``; ``events`` is the view of events."""
    graph = head + _UNDIRECTED
    return {
        "dinic": head + _least_cut(0, 5),
        "maxflow": head + _least_cut(1, 2),
        "articulation": graph + _WITHOUT_NODE + " SELECT w.grp, count(*) FILTER (p.n > w.n) AS points FROM parts w LEFT JOIN parts p ON p.grp = w.grp AND p.x >= 0 WHERE w.x = -1 GROUP BY w.grp",
        "bridges": graph + _WITHOUT_EDGE + " SELECT w.grp, count(*) FILTER (p.n > w.n) AS bridges FROM parts w LEFT JOIN parts p ON p.grp = w.grp AND p.x > 0 WHERE w.x = 0 GROUP BY w.grp",
        # The most pairs: what the worst set of left nodes lacks in neighbours stays alone.
        "bipartite": head
        + _MASKS
        + """, l AS (SELECT grp, list(DISTINCT src) AS lefts FROM edges GROUP BY grp), s AS (SELECT l.grp, m, len(lefts) AS n, len(list_filter(lefts, lambda x: (m >> x) & 1 = 1)) AS chosen FROM l CROSS JOIN masks),
            d AS (SELECT s.grp, s.m, any_value(s.n) - any_value(s.chosen) + count(DISTINCT e.dst) AS cover FROM s LEFT JOIN edges e ON e.grp = s.grp AND (s.m >> e.src) & 1 = 1 GROUP BY 1, 2), most AS (SELECT grp, min(cover) AS most FROM d GROUP BY grp),
            taken AS (SELECT grp, list_reduce(list({'a': src, 'b': dst} ORDER BY src, dst), lambda s, x: CASE WHEN list_contains(s.a, x.a) OR list_contains(s.b, x.b) THEN s ELSE {'a': list_append(s.a, x.a), 'b': list_append(s.b, x.b)} END, {'a': CAST([] AS BIGINT[]), 'b': CAST([] AS BIGINT[])}) AS s FROM edges GROUP BY grp)
            SELECT grp, CAST(most AS BIGINT) AS most, CAST(len(s.a) AS BIGINT) AS greedy FROM most JOIN taken USING (grp)""",
        "hungarian": head + _PERMUTED + " SELECT grp, min(cost) AS cost FROM (SELECT g.grp, s.id, CAST(sum(coalesce(e.w, 1000)) AS DOUBLE) AS cost FROM groups g CROSS JOIN seats s LEFT JOIN edges e ON e.grp = g.grp AND e.src = s.i AND e.dst = s.j GROUP BY 1, 2) x GROUP BY grp",
        # Both ways of every edge in one trail, if the edges hang together.
        "hierholzer": graph + ", walk(grp, a, b) AS (SELECT grp, node, node FROM nodes UNION SELECT w.grp, w.a, u.b FROM walk w JOIN u ON u.grp = w.grp AND u.a = w.b) SELECT n.grp, CASE WHEN n.parts = 1 THEN 2 * e.n + 1 ELSE -1 END AS trail_length FROM (SELECT grp, count(*) AS parts FROM (SELECT grp, a FROM walk GROUP BY 1, 2 HAVING min(b) = a) l GROUP BY grp) n JOIN (SELECT grp, count(*) AS n FROM edges GROUP BY grp) e USING (grp)",
        "mst": graph + _LIGHTER.format(order="w, src, dst") + " SELECT n.grp, CAST(coalesce(any_value(t.w), 0) AS BIGINT) AS weight, count(*) - coalesce(any_value(t.n), 0) AS trees FROM nodes n LEFT JOIN (SELECT grp, sum(w) AS w, count(*) AS n FROM tree GROUP BY grp) t ON t.grp = n.grp GROUP BY n.grp",
        # Of all stable pairings the one the proposers like best.
        "stablematching": head + _PERMUTED + _STABLE + " SELECT grp, arg_min(pairs, cost) AS pairs FROM stable GROUP BY grp",
        # Joins that succeed, and the sets left of six nodes when only the first half of the edges counts.
        "dsurollback": head + _LIGHTER.format(order="src, dst") + " SELECT n.grp, count(t.e) AS joined, 6 - count(t.e) FILTER (t.e <= n.half) AS after_rollback FROM (SELECT grp, count(*) // 2 AS half FROM edges GROUP BY grp) n LEFT JOIN tree t ON t.grp = n.grp GROUP BY n.grp",
        # A side of the hull has all points on its left, and of those on its line none beyond its end.
        "convexhull": f"""WITH RECURSIVE {events}, pts AS (SELECT DISTINCT k AS grp, v AS x, seq % 101 AS y FROM ev),
            sides AS (SELECT p.grp, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pts p JOIN pts q ON p.grp = q.grp AND (p.x <> q.x OR p.y <> q.y) JOIN pts r ON r.grp = p.grp GROUP BY 1, 2, 3, 4, 5
                HAVING min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) >= 0 AND count(*) FILTER ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND ((r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y)) > 0) = 0),
            walk(grp, n, x, y, said) AS (SELECT grp, 1, min(x), arg_min(y, x * 1000 + y), concat('(', min(x), ', ', arg_min(y, x * 1000 + y), ')') FROM pts GROUP BY grp
                UNION ALL SELECT w.grp, n + 1, s.qx, s.qy, concat(said, ', (', s.qx, ', ', s.qy, ')') FROM walk w JOIN sides s ON s.grp = w.grp AND s.px = w.x AND s.py = w.y WHERE n < 4),
            c AS (SELECT grp, count(*) AS corners FROM sides GROUP BY grp)
            SELECT c.grp, c.corners, concat('[', w.said, ']') AS outline FROM c JOIN walk w ON w.grp = c.grp AND w.n = least(c.corners, 4)""",
    }
