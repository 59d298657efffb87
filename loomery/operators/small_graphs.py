"""Algorithms whose state is one whole graph, run once per group on an Arrow batch.

Each takes the edges of one graph as arrays and gives one row.  Use them on
many small graphs (one per user, order or component), which run in parallel.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame


def per_graph(edges: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(list of (src, dst, w)) -> dict`` for each group."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "dst", "w"])
        found = solve(list(zip(rows["src"].tolist(), rows["dst"].tolist(), rows["w"].tolist(), strict=True)))
        return pd.DataFrame([[key[0], *(found[n] for n in names)]], columns=["group", *names])

    return edges.groupBy("group").applyInPandas(run, "group long, " + schema)


def max_flow(edges: list[tuple], source: int, sink: int) -> int:
    """Largest flow: shortest augmenting paths, level graph by level graph."""
    room: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for a, b, c in edges:
        room[a][b] += c
        room[b][a] += 0
    if source == sink:
        return 0
    total = 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, c in room[a].items():
                if c > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return total
        hope = {a: list(room[a]) for a in level}

        def push(a: int, most: int) -> int:
            if a == sink:
                return most
            while hope[a]:
                b = hope[a][-1]
                if room[a][b] > 0 and level.get(b) == level[a] + 1 and (sent := push(b, min(most, room[a][b]))):
                    room[a][b] -= sent
                    room[b][a] += sent
                    return sent
                hope[a].pop()
            return 0

        while sent := push(source, 1 << 60):
            total += sent


def _links(edges: list[tuple]) -> tuple[list[int], dict[int, list[tuple[int, int]]]]:
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, (a, b, _) in enumerate(edges):
        near[a].append((b, k))
        near[b].append((a, k))
    return sorted(near), near


def cuts(edges: list[tuple]) -> dict:
    """Bridges (edge numbers) and articulation points of the undirected graph."""
    nodes, near = _links(edges)
    seen, low, bridges, points = {}, {}, [], set()
    for root in nodes:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            a, via, rest = stack[-1]
            for b, k in rest:
                if k == via:
                    continue
                if b in seen:
                    low[a] = min(low[a], seen[b])
                else:
                    seen[b] = low[b] = len(seen)
                    stack.append((b, k, iter(near[b])))
                    break
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[a])
                    if low[a] > seen[p]:
                        bridges.append(via)
                    if p == root:
                        children += 1
                    elif low[a] >= seen[p]:
                        points.add(p)
        if children > 1:
            points.add(root)
    return {"bridges": sorted(bridges), "points": sorted(points)}


def matching(pairs: list[tuple]) -> int:
    """Most pairs of left and right that share no end, by alternating paths."""
    wants: dict[int, list[int]] = defaultdict(list)
    for a, b, *_ in pairs:
        wants[a].append(b)
    taken: dict[int, int] = {}

    def place(a: int, tried: set[int]) -> bool:
        for b in wants[a]:
            if b not in tried:
                tried.add(b)
                if b not in taken or place(taken[b], tried):
                    taken[b] = a
                    return True
        return False

    return sum(place(a, set()) for a in list(wants))


def greedy_matching(pairs: list[tuple]) -> int:
    left, right = set(), set()
    for a, b, *_ in pairs:
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
    return len(left)


def assignment(cost: list[list[float]]) -> tuple[float, list[int]]:
    """Cheapest assignment of rows to columns: shortest augmenting paths with potentials."""
    n = len(cost)
    owner, down, right = [-1] * n, [0.0] * n, [0.0] * n
    for start in range(n):
        dist, back, done, row, col = [float("inf")] * n, [-1] * n, [False] * n, start, -1
        base = 0.0
        while True:
            for j in range(n):
                if not done[j] and (d := base + cost[row][j] - down[row] - right[j]) < dist[j]:
                    dist[j], back[j] = d, col
            nxt = min((j for j in range(n) if not done[j]), key=lambda j: dist[j])
            done[nxt], base, col = True, dist[nxt], nxt
            if owner[nxt] < 0:
                break
            row = owner[nxt]
        for j in range(n):
            if done[j]:
                right[j] += dist[j] - base
                if j != col:
                    down[owner[j]] += base - dist[j]
        down[start] += base
        while col >= 0:
            before = back[col]
            owner[col] = owner[before] if before >= 0 else start
            col = before
    columns = [0] * n
    for j, i in enumerate(owner):
        columns[i] = j
    return sum(cost[i][j] for i, j in enumerate(columns)), columns


def euler_trail(edges: list[tuple]) -> list[int] | None:
    """A trail over every directed edge once, or None."""
    out, balance = defaultdict(list), defaultdict(int)
    for a, b, *_ in sorted(edges, reverse=True):
        out[a].append(b)
        balance[a] += 1
        balance[b] -= 1
    odd = sorted(n for n, d in balance.items() if d)
    if [balance[n] for n in odd] not in ([], [1, -1], [-1, 1]):
        return None
    start = next((n for n in odd if balance[n] == 1), min(out, default=None))
    if start is None:
        return []
    path, stack = [], [start]
    while stack:
        if out[stack[-1]]:
            stack.append(out[stack[-1]].pop())
        else:
            path.append(stack.pop())
    return path[::-1] if len(path) == len(edges) + 1 else None


def spanning_weight(edges: list[tuple]) -> tuple[int, int]:
    """Weight of the lightest spanning forest and its number of trees, grown from each node by a heap."""
    nodes, near = _links(edges)
    seen, total, trees = set(), 0, 0
    for root in nodes:
        if root in seen:
            continue
        trees += 1
        heap = [(0, root)]
        while heap:
            w, a = heapq.heappop(heap)
            if a in seen:
                continue
            seen.add(a)
            total += w
            for b, k in near[a]:
                if b not in seen:
                    heapq.heappush(heap, (edges[k][2], b))
    return total, trees


def stable_pairs(proposers: dict[int, list[int]], receivers: dict[int, list[int]]) -> dict[int, int]:
    """Proposer-optimal stable matching: proposer -> receiver."""
    rank = {r: {p: k for k, p in enumerate(order)} for r, order in receivers.items()}
    held: dict[int, int] = {}
    free, at = deque(sorted(proposers)), defaultdict(int)
    while free:
        p = free.popleft()
        while at[p] < len(proposers[p]):
            r = proposers[p][at[p]]
            at[p] += 1
            now = held.get(r)
            if now is None or rank[r][p] < rank[r][now]:
                held[r] = p
                if now is not None:
                    free.append(now)
                break
    return {p: r for r, p in held.items()}


class RollbackSets:
    """Disjoint sets with undo: joins are by size and never compress, so one step reverses each."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.log: list[tuple[int, int] | None] = []

    def find(self, x: int) -> int:
        self.parent.setdefault(x, x)
        self.size.setdefault(x, 1)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            self.log.append(None)
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        self.log.append((a, b))
        return True

    def rollback(self, mark: int) -> None:
        """Undo all joins since the log had ``mark`` entries."""
        while len(self.log) > mark:
            if step := self.log.pop():
                a, b = step
                self.parent[b] = b
                self.size[a] -= self.size[b]


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, counter-clockwise from the least point; points on an edge are left out."""

    def chain(run: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    run = sorted(set(points))
    return run if len(run) < 2 else chain(run) + chain(run[::-1])


def alias_table(weights: list[float]) -> list[tuple[float, int]]:
    """For each column the share it keeps and the column that takes the rest: constant-time weighted draws."""
    n, total = len(weights), sum(weights)
    scaled = [w * n / total for w in weights]
    short, long = [i for i, w in enumerate(scaled) if w < 1], [i for i, w in enumerate(scaled) if w >= 1]
    out = [(1.0, i) for i in range(n)]
    while short and long:
        i, j = short.pop(), long[-1]
        out[i] = (scaled[i], j)
        scaled[j] -= 1 - scaled[i]
        if scaled[j] < 1:
            short.append(long.pop())
    return out
