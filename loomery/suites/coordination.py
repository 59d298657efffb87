"""Coordination, schemas, topologies and lineage over the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.errors import Stopped
from loomery.operators import coordination as c
from loomery.operators.keyed import run_by_key
from loomery.operators.sqlop import SqlOperator as Op
from loomery.sources.staging import staged
from loomery.suites.frames import frame, register
from loomery.suites.machines import DUCK_EVENTS

_EV = f"WITH ev AS ({DUCK_EVENTS}) "
KINDS = ["click", "error", "purchase", "signup", "view"]


class _Causal:
    """A user's kinds are senders that see each other's messages at once; the first error never arrives, all else arrives out of order."""

    def __init__(self):
        self.sent, self.stamp = [], [0] * len(KINDS)

    def step(self, seq, kind):
        sender = KINDS.index(kind)
        self.stamp[sender] += 1
        self.sent.append((hashlib.sha256(str(seq).encode()).digest(), sender, list(self.stamp), (seq, kind)))
        return ()

    def finish(self):
        lost = next((m for m in self.sent if m[3][1] == "error"), None)
        inbox, out = c.CausalDelivery(len(KINDS)), []
        for message in sorted(self.sent):
            if message is not lost:
                out += inbox.receive(*message[1:])
        return [(len(out), inbox.pending(), out == sorted(out))]


class _Snapshot:
    """Kinds are channels; an error is a marker on the channel of its value, all else a message."""

    def __init__(self):
        self.process, self.state = c.SnapshotProcess(range(4)), 0

    def step(self, kind, v):
        if kind == "error":
            self.process.marker(v % 4, self.state)
        else:
            self.process.receive(v % 4, v)
            self.state += v
        return ()

    def finish(self):
        p = self.process
        carried = [m for channel in range(4) for m in p.in_flight(channel)]
        return [(p.state, len(carried), sum(carried), p.complete())]


class _Lock:
    """A purchase releases, all else acquires at the priority of its value."""

    def __init__(self):
        self.lock, self.inherited, self.passed = c.PriorityLock(), 0, 0

    def step(self, seq, kind, v):
        lock = self.lock
        if kind != "purchase":
            lock.acquire(seq, v)
        elif lock.holder is not None:
            self.inherited += lock.holder_effective_priority() > lock.holder[1]
            lock.release()
            self.passed += 1
        return ()

    def finish(self):
        lock = self.lock
        return [(self.passed, self.inherited, lock.holder_effective_priority(), len(lock.waiters))]


class _Wiring:
    """Stages in a row, then a wire from the last back to the first, and a stage nobody wires."""

    def __init__(self):
        self.topology, self.names = c.Topology(), []

    def step(self, name, slots):
        self.names.append((name, slots))
        return ()

    def finish(self):
        t, refused = self.topology, []
        for i, (name, slots) in enumerate(self.names):
            t.add_stage(name, slots, i == 0, i == len(self.names) - 2)
        names = [n for n, _ in self.names[:-1]]
        for a, b in [*zip(names, names[1:], strict=False), (names[-1], names[0])]:
            try:
                t.wire(a, b)
            except Stopped as loop:
                refused.append(str(loop))
        return [(len(names) - 1, "; ".join(refused), ",".join(t.unfed()), ",".join(t.unheard()), t.slot_bill())]


def _by_user(make, inputs, schema):
    return lambda spark, sf_dir: run_by_key(frame(spark, sf_dir, "ev"), ["k"], ["seq"], inputs, make, schema)


def topology(spark, sf_dir):
    stages = frame(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("at"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 + 1).cast("long").alias("slots"))
    return run_by_key(stages, ["region"], ["at"], ["name", "slots"], _Wiring, "wires long, loops string, unfed string, unheard string, slots long")


def rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five members join a group one by one, then the second leaves: partitions that pause, by protocol."""
    rows = []
    for protocol in ("eager", "incremental"):
        group = c.ConsumerGroup(protocol, 60)
        for n in range(1, 6):
            rows.append((protocol, n, group.join(f"m{n}"), max(map(len, group.owned.values())), group.pause_bill()))
        rows.append((protocol, 6, group.leave("m2"), max(map(len, group.owned.values())), group.pause_bill()))
    return spark.createDataFrame(rows, "protocol string, step long, paused long, largest long, bill long")


def migrate(states: DataFrame, steps: DataFrame, target: int) -> DataFrame:
    """``(version, state, reached)`` of states ``(version, state)`` taken from step to step ``(from_version, factor, plus)`` up to ``target``.

    A state stops at the first version without a registered step; as many joins as there are registered versions.
    """
    out = states.select("version", "state", F.col("version").alias("reached"))
    table = F.broadcast(steps.select(F.col("from_version").alias("reached"), "factor", "plus"))  # one row a version
    for _ in range(steps.count()):
        moved = out.join(table, "reached", "left")
        go = F.col("factor").isNotNull() & (F.col("reached") < target)
        out = moved.select("version", F.when(go, F.col("state") * F.col("factor") + F.col("plus")).otherwise(F.col("state")).alias("state"), F.when(go, F.col("reached") + 1).otherwise(F.col("reached")).alias("reached"))
    return out


def savepointmigrate(spark, sf_dir):
    states = frame(spark, sf_dir, "ev").select((F.col("v") % 5).alias("version"), F.col("v").alias("state"))
    steps = spark.createDataFrame([(v, 2, v) for v in (1, 2, 3)], "from_version long, factor long, plus long")
    done = migrate(states, steps, 4)
    return done.groupBy("version").agg(F.sum(F.when(F.col("reached") == 4, F.col("state"))).alias("migrated"), F.count(F.when(F.col("reached") < 4, 1)).alias("refused"))


def gossip_rounds(peers: DataFrame, start: int, most: int) -> DataFrame:
    """``(round_no, covered)`` when every covered node tells its ``peers (round_no, node, peer)`` each round, until nothing new is covered or after ``most`` rounds."""
    spark = peers.sparkSession
    covered, sizes = spark.createDataFrame([(start,)], "node long"), []
    for n in range(1, most + 1):
        told = peers.filter(F.col("round_no") == n).join(covered, "node").select(F.col("peer").alias("node"))
        covered = staged(covered.unionByName(told).distinct(), "gossip")
        sizes.append((n, covered.count()))
    return spark.createDataFrame(sizes, "round_no long, covered long")


def gossip(spark, sf_dir):
    nodes, rounds = 200, 9
    picks = spark.range(nodes).select(F.col("id").alias("node")).crossJoin(spark.range(1, rounds + 1).select(F.col("id").alias("round_no")))  # the picks are the input: nodes times rounds
    one, two = (F.col("node") * 7919 + F.col("round_no") * 104729 + 13) % nodes, (F.col("node") * 6101 + F.col("round_no") * 15485863 + 7) % nodes
    return gossip_rounds(picks.select("round_no", "node", F.explode(F.array(one, two)).alias("peer")), 0, rounds)


def chain_cost(sizes: DataFrame) -> DataFrame:
    """``(g, optimal, left_deep)`` of joining relations in a row: ``sizes (g, at, d)`` with n + 1 sizes for n relations.

    Interval by interval, shortest first: the cheapest split of each stretch, one
    self-join a length.  Stretches are the square of the relations in one plan.
    """
    d = sizes.select("g", F.col("at").cast("long").alias("at"), F.col("d").cast("long").alias("d"))
    longest = (d.groupBy("g").count().agg(F.max("count")).first()[0] or 1) - 1
    a, b = d.select("g", F.col("at").alias("i"), F.col("d").alias("first")), d.select("g", F.col("at").alias("j"), F.col("d").alias("last"))
    best = a.join(b, "g").filter("j = i + 1").select("g", "i", "j", F.lit(0).cast("long").alias("cost"))
    mid = d.select("g", F.col("at").alias("m"), F.col("d").alias("middle"))
    for length in range(2, longest + 1):
        left, right = best.select("g", "i", F.col("j").alias("m"), F.col("cost").alias("x")), best.select("g", F.col("i").alias("m"), "j", F.col("cost").alias("y"))
        split = left.join(right, ["g", "m"]).filter(F.col("j") - F.col("i") == length).join(mid, ["g", "m"]).join(a, ["g", "i"]).join(b, ["g", "j"])
        made = split.groupBy("g", "i", "j").agg(F.min(F.col("x") + F.col("y") + F.col("first") * F.col("middle") * F.col("last")).alias("cost"))
        best = staged(best.unionByName(made), "chain")
    ends = d.groupBy("g").agg(F.min("at").alias("i"), F.max("at").alias("j"), F.min_by("d", "at").alias("d0"))
    deep = d.join(ends, "g").join(mid, "g").filter("m = at + 1 and at > i").groupBy("g").agg(F.sum(F.col("d0") * F.col("d") * F.col("middle")).alias("left_deep"))
    return best.join(ends, ["g", "i", "j"]).join(deep, "g", "left").select("g", F.col("cost").alias("optimal"), F.coalesce("left_deep", F.lit(0)).cast("long").alias("left_deep"))


def joinorder(spark, sf_dir):
    """Four relations for each region, sized by its nations."""
    nations = spark.sql("SELECT n_regionkey AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS at, (n_nationkey * 7 + 3) % 11 + 1 AS d FROM {nation}", nation=frame(spark, sf_dir, "nation"))
    return chain_cost(nations)


def eventgraph(spark, sf_dir):
    """Lineage: an output comes from the event at half its place in its user's log; contributors are all before it, the blast radius all after."""
    from loomery.plans.graphs import ancestors

    rows = spark.sql("SELECT seq, k, row_number() OVER (PARTITION BY k ORDER BY seq) AS at FROM {ev}", ev=frame(spark, sf_dir, "ev"))
    rows = staged(rows, "lineage")
    source = rows.select("k", F.col("at").alias("half"), F.col("seq").alias("parent"))
    edges = rows.withColumn("half", F.floor(F.col("at") / 2).cast("int")).join(source, ["k", "half"], "left").select(F.col("seq").alias("node"), "parent")
    line = staged(ancestors(edges), "lineage-closure")
    up, down = line.groupBy(F.col("node").alias("seq")).agg(F.count("*").alias("contributors")), line.groupBy(F.col("ancestor").alias("seq")).agg(F.count("*").alias("blast_radius"))
    none = F.lit(0).cast("long")
    return rows.select("seq").join(up, "seq", "left").join(down, "seq", "left").select("seq", F.coalesce("contributors", none).alias("contributors"), F.coalesce("blast_radius", none).alias("blast_radius"))


_SCHEMAS = "SELECT n_regionkey AS version, concat('f', CAST(n_nationkey % 9 AS {text})) AS field, n_nationkey % 2 = 0 AS optional FROM {{nation}}"
_S, _D = _SCHEMAS.format(text="STRING"), _SCHEMAS.format(text="VARCHAR")
_RAFT = "SELECT k % 20 AS g, kind, INT(seq / 500e0) AS term, CAST(row_number() OVER (PARTITION BY k % 20 ORDER BY seq) AS BIGINT) AS pos, v FROM {ev}"
_ANSWERS = "SELECT k, kind AS replica, INT(max(seq) / 2000e0) AS version, max_by(v, seq) AS v, min(seq) AS since FROM {ev} GROUP BY k, kind"
_CARDS = [
    # Symptoms and the part each points to.
    ("answers-changed", "trigger labels"), ("balances-negative", "order auditor"), ("duplicate-rows", "epoch sink"), ("lag-rising", "lag tracker"),
    ("missing-windows", "gap filler"), ("one-partition-hot", "partitioner"), ("state-growing", "keyed state ttl"), ("watermark-stuck", "multisource clock"),
]
_CARD_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in _CARDS)
_SYMPTOMS = "SELECT k, CASE v % 10 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(_CARDS)) + " WHEN 8 THEN 'its-slow' ELSE 'unheard-of' END AS symptom FROM {ev}"

SQL = {
    # Replicas answer with versions: the newest wins (of ties the one first heard), the older are repaired.
    "readrepair": Op(
        f"""SELECT k, top.version AS version, top.v AS v, JOINED(array_sort(transform(filter(all, a -> a.version < top.version), a -> a.replica)), ',') AS repairs, exists(all, a -> a.version < top.version) AS diverged
            FROM (SELECT k, max_by(named_struct('version', version, 'v', v), named_struct('version', version, 'back', -since)) AS top, collect_list(named_struct('replica', replica, 'version', version)) AS all FROM ({_ANSWERS}) a GROUP BY k) x""",
        {},
        """SELECT a.k AS k, a.version AS version, a.v AS v, coalesce(string_agg(b.replica, ',' ORDER BY b.replica), '') AS repairs, count(b.replica) > 0 AS diverged
           FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, since) AS r FROM (SELECT k, kind, CAST(max(seq) // 2000 AS BIGINT) AS version, arg_max(v, seq) AS v, min(seq) AS since FROM {ev} GROUP BY k, kind) q) p WHERE r = 1) a
           LEFT JOIN (SELECT k, kind AS replica, max(seq) // 2000 AS version FROM {ev} GROUP BY k, kind) b ON a.k = b.k AND b.version < a.version GROUP BY a.k, a.version, a.v""",
    ),
    # The largest place a majority holds whose entry is of the current term.
    "raftcommit": Op(
        f"""SELECT l.g AS g, coalesce(max(CASE WHEN l.pos <= m.held AND l.term = m.now THEN l.pos END), CAST(0 AS BIGINT)) AS commit_index, any_value(m.held) AS majority_index
            FROM ({_RAFT}) l JOIN (SELECT g, element_at(reverse(array_sort(collect_list(pos))), CAST(floor(count(*) / 2) + 1 AS INT)) AS held, max(term) AS now FROM (SELECT g, kind, max(pos) AS pos, max(term) AS term FROM ({_RAFT}) r GROUP BY g, kind) s GROUP BY g) m ON l.g = m.g GROUP BY l.g""",
        {},
        f"""WITH log AS ({_RAFT}), held AS (SELECT g, kind, max(pos) AS pos FROM log GROUP BY g, kind),
            major AS (SELECT a.g, max(a.pos) AS pos FROM log a WHERE (SELECT count(*) FROM held h WHERE h.g = a.g AND h.pos >= a.pos) * 2 > (SELECT count(*) FROM held h WHERE h.g = a.g) GROUP BY a.g)
            SELECT major.g AS g, coalesce(max(log.pos), 0) AS commit_index, any_value(major.pos) AS majority_index FROM major LEFT JOIN log ON log.g = major.g AND log.pos <= major.pos AND log.term = (SELECT max(term) FROM log t WHERE t.g = major.g) GROUP BY major.g""",
    ),
    # Steps run until one fails; those done are compensated in reverse.
    "saga": Op(
        """SELECT k, CASE WHEN failed = 0 THEN 'completed' ELSE 'compensated' END AS status, failed AS failed_at, CASE WHEN failed = 0 THEN size(steps) ELSE failed - 1 END AS done,
           CASE WHEN failed > 1 THEN JOINED(transform(reverse(slice(steps, 1, CAST(failed - 1 AS INT))), s -> TEXT(s.seq)), ',') ELSE '' END AS undone FROM (SELECT k, steps, CAST(array_position(transform(steps, s -> s.ok), FALSE) AS BIGINT) AS failed FROM
           (SELECT k, array_sort(collect_list(named_struct('seq', seq, 'ok', ok))) AS steps FROM {ev} GROUP BY k) x) y""",
        {},
        """SELECT k, CASE WHEN f IS NULL THEN 'completed' ELSE 'compensated' END AS status, coalesce(f, 0) AS failed_at, CAST(coalesce(f - 1, n) AS BIGINT) AS done, coalesce(undone, '') AS undone FROM
           (SELECT k, min(i) FILTER (NOT ok) AS f, count(*) AS n FROM (SELECT k, ok, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM {ev}) a GROUP BY k) x
           LEFT JOIN (SELECT k, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq DESC) AS undone FROM {ev} e WHERE seq < (SELECT min(seq) FROM {ev} b WHERE b.k = e.k AND NOT b.ok) GROUP BY k) u USING (k)""",
    ),
    # The last probe counts as direct; the three probes before it went through others.
    "swim": Op(
        """SELECT k, CASE WHEN element_at(probes, 1).ok THEN 'alive' WHEN exists(slice(probes, 2, {indirect}), p -> p.ok) THEN 'alive by others' ELSE 'suspect' END AS verdict, CASE WHEN element_at(probes, 1).ok THEN 'alive' ELSE 'dead' END AS direct_only
           FROM (SELECT k, reverse(array_sort(collect_list(named_struct('seq', seq, 'ok', ok)))) AS probes FROM {ev} GROUP BY k) x""",
        {"indirect": 3},
        """SELECT k, CASE WHEN max(CASE WHEN r = 1 AND ok THEN 1 ELSE 0 END) = 1 THEN 'alive' WHEN max(CASE WHEN r BETWEEN 2 AND {indirect} + 1 AND ok THEN 1 ELSE 0 END) = 1 THEN 'alive by others' ELSE 'suspect' END AS verdict,
           CASE WHEN max(CASE WHEN r = 1 AND ok THEN 1 ELSE 0 END) = 1 THEN 'alive' ELSE 'dead' END AS direct_only FROM (SELECT k, ok, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {ev}) x GROUP BY k""",
    ),
    # Frames from the lost one on are sent again, or that one alone.
    "arq": Op(
        """SELECT w AS send_window, lost, count(CASE WHEN f >= lost THEN 1 END) AS go_back_n, count(CASE WHEN f = lost THEN 1 END) AS selective_repeat FROM (SELECT w, lost, SERIES(CAST(0 AS BIGINT), w - 1) AS f FROM (SELECT w, SERIES(CAST(0 AS BIGINT), w - 1) AS lost FROM (SELECT SERIES(CAST(1 AS BIGINT), CAST({widest} AS BIGINT)) AS w) a) b) c GROUP BY w, lost""",
        {"widest": 16},
        "SELECT w AS send_window, lost, w - lost AS go_back_n, CAST(1 AS BIGINT) AS selective_repeat FROM (SELECT w, unnest(generate_series(0, w - 1)) AS lost FROM (SELECT unnest(generate_series(1, {widest})) AS w) a) b",
    ),
    # Three stations must purge what a user's first sign-up asks to forget; the raw log ages out after the retention.
    "forgetme": Op(
        """SELECT k, opened, JOINED(array_sort(array_except(array('compacted-log', 'live-state', 'read-models'), done)), ',') AS unfinished, size(array_intersect(array('compacted-log', 'live-state', 'read-models'), done)) = 3 AS certified, CASE WHEN size(done) = 3 THEN opened + {retention} END AS raw_until
           FROM (SELECT k, min(opened) AS opened, collect_set(CASE kind WHEN 'click' THEN 'live-state' WHEN 'view' THEN 'read-models' WHEN 'purchase' THEN 'compacted-log' END) AS done
           FROM (SELECT k, t, seq, kind, min(CASE WHEN kind = 'signup' THEN seq END) OVER (PARTITION BY k) AS asked, min(CASE WHEN kind = 'signup' THEN t END) OVER (PARTITION BY k) AS opened FROM {ev}) x WHERE seq > asked GROUP BY k) y""",
        {"retention": 2592000},
        """SELECT o.k AS k, o.opened AS opened, coalesce(string_agg(s.station, ',' ORDER BY s.station) FILTER (d.kind IS NULL), '') AS unfinished, count(d.kind) = 3 AS certified, CASE WHEN count(d.kind) = 3 THEN o.opened + {retention} END AS raw_until
           FROM (SELECT k, min(t) AS opened, min(seq) AS asked, (SELECT max(seq) FROM {ev} z WHERE z.k = e.k) AS latest FROM {ev} e WHERE kind = 'signup' GROUP BY k) o CROSS JOIN (VALUES ('live-state', 'click'), ('read-models', 'view'), ('compacted-log', 'purchase')) s(station, kind)
           LEFT JOIN (SELECT DISTINCT e.k, e.kind FROM {ev} e JOIN (SELECT k, min(seq) AS asked FROM {ev} WHERE kind = 'signup' GROUP BY k) a ON a.k = e.k AND e.seq > a.asked) d ON d.k = o.k AND d.kind = s.kind WHERE o.latest > o.asked GROUP BY o.k, o.opened""",
    ),
    # A reader can read a writer if every field the writer lacks has a default.
    "schemaevolve": Op(
        f"""WITH s AS ({_S}), v AS (SELECT version, collect_set(field) AS fields, collect_set(CASE WHEN NOT optional THEN field END) AS firm FROM s GROUP BY version)
            SELECT r.version AS reader, w.version AS writer, size(array_except(r.firm, w.fields)) = 0 AS can_read, JOINED(array_sort(array_except(r.firm, w.fields)), ',') AS missing FROM v r CROSS JOIN v w""",
        {},
        f"""WITH s AS ({_D}), v AS (SELECT DISTINCT version FROM s), m AS (SELECT DISTINCT r.version AS reader, w.version AS writer, r.field FROM s r CROSS JOIN v w WHERE NOT r.optional AND NOT EXISTS (SELECT 1 FROM s x WHERE x.version = w.version AND x.field = r.field))
            SELECT r.version AS reader, w.version AS writer, count(m.field) = 0 AS can_read, coalesce(string_agg(m.field, ',' ORDER BY m.field), '') AS missing FROM v r CROSS JOIN v w LEFT JOIN m ON m.reader = r.version AND m.writer = w.version GROUP BY 1, 2""",
    ),
    # New required fields break old data, removed fields break old readers; what is not full needs a window.
    "schemaregistry": Op(
        f"""WITH s AS ({_S}), v AS (SELECT version, collect_set(field) AS fields, collect_set(CASE WHEN NOT optional THEN field END) AS firm FROM s GROUP BY version),
            d AS (SELECT a.version AS old_version, b.version AS new_version, size(array_except(b.firm, a.fields)) AS added, size(array_except(a.fields, b.fields)) AS removed FROM v a CROSS JOIN v b)
            SELECT old_version, new_version, CASE WHEN added = 0 AND removed = 0 THEN 'full' WHEN removed = 0 THEN 'forward only' WHEN added = 0 THEN 'backward only' ELSE 'none' END AS compatibility, added > 0 OR removed > 0 AS needs_window FROM d""",
        {},
        f"""WITH s AS ({_D}), v AS (SELECT DISTINCT version FROM s), p AS (SELECT a.version AS old_version, b.version AS new_version,
            EXISTS (SELECT 1 FROM s n WHERE n.version = b.version AND NOT n.optional AND n.field NOT IN (SELECT field FROM s o WHERE o.version = a.version)) AS added, EXISTS (SELECT 1 FROM s o WHERE o.version = a.version AND o.field NOT IN (SELECT field FROM s n WHERE n.version = b.version)) AS removed FROM v a CROSS JOIN v b)
            SELECT old_version, new_version, CASE WHEN added AND removed THEN 'none' WHEN added THEN 'forward only' WHEN removed THEN 'backward only' ELSE 'full' END AS compatibility, added OR removed AS needs_window FROM p""",
    ),
    # A table of symptoms; "slow" is refused, as it may be any of three parts.
    "triage": Op(
        f"SELECT x.symptom AS symptom, CASE WHEN x.symptom = 'its-slow' THEN 'refused' WHEN c.part IS NULL THEN 'not in the table' ELSE 'known' END AS answer, coalesce(c.part, '') AS part, count(*) AS n FROM ({_SYMPTOMS}) x LEFT JOIN (VALUES {_CARD_ROWS}) AS c(symptom, part) ON x.symptom = c.symptom GROUP BY 1, 2, 3",
        {},
        "SELECT s.symptom AS symptom, CASE WHEN i < 8 THEN 'known' WHEN i = 8 THEN 'refused' ELSE 'not in the table' END AS answer, s.part AS part, count(*) AS n FROM {ev} JOIN (VALUES "
        + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate([*_CARDS, ("its-slow", ""), ("unheard-of", "")])) + ") s(i, symptom, part) ON v % 10 = s.i GROUP BY 1, 2, 3",
    ),
    # What two runs in opposite arrival orders disagree on: sums and latest-by-time do not, first and last do.
    "determinism": Op(
        """SELECT operator, count(*) AS compared, TOTAL(CASE WHEN a = b THEN 0 ELSE 1 END) AS differing, CASE WHEN TOTAL(CASE WHEN a = b THEN 0 ELSE 1 END) = 0 THEN 'deterministic' ELSE 'depends on order' END AS verdict FROM
           (SELECT stack(4, 'total', x.total, y.total, 'first', x.head, y.head, 'last', x.tail, y.tail, 'latest', x.latest, y.latest) AS (operator, a, b) FROM
           (SELECT k, TOTAL(v) AS total, min_by(v, seq) AS head, max_by(v, seq) AS tail, max_by(v, t * 1000000 + seq) AS latest FROM {ev} GROUP BY k) x JOIN
           (SELECT k, TOTAL(v) AS total, min_by(v, -seq) AS head, max_by(v, -seq) AS tail, max_by(v, t * 1000000 + seq) AS latest FROM {ev} GROUP BY k) y ON x.k = y.k) z GROUP BY operator""",
        {},
        """WITH l AS (SELECT k, list(v ORDER BY seq) AS xs FROM {ev} GROUP BY k), n AS (SELECT count(*) AS keys, count(*) FILTER (xs[1] <> xs[-1]) AS moved FROM l)
           SELECT o.operator AS operator, n.keys AS compared, CASE WHEN o.ordered THEN n.moved ELSE 0 END AS differing, CASE WHEN o.ordered AND n.moved > 0 THEN 'depends on order' ELSE 'deterministic' END AS verdict FROM n CROSS JOIN (VALUES ('total', FALSE), ('first', TRUE), ('last', TRUE), ('latest', FALSE)) o(operator, ordered)""",
    ),
}
QUERIES, ORACLES = register(SQL)
QUERIES |= {f.__name__: f for f in (topology, rebalance, savepointmigrate, gossip, joinorder, eventgraph)} | {
    "causaldelivery": _by_user(_Causal, ["seq", "kind"], "delivered long, pending long, in_order boolean"),
    "chandylamport": _by_user(_Snapshot, ["kind", "v"], "local_state long, in_flight long, in_flight_total long, complete boolean"),
    "priorityinherit": _by_user(_Lock, ["seq", "kind", "v"], "passed long, inherited long, effective long, waiting long"),
}
ORACLES |= {
    "causaldelivery": _EV + "SELECT k, count(*) FILTER (e IS NULL OR seq < e) AS delivered, count(*) FILTER (seq > e) AS pending, TRUE AS in_order FROM (SELECT k, seq, min(CASE WHEN kind = 'error' THEN seq END) OVER (PARTITION BY k) AS e FROM ev) x GROUP BY k",
    "chandylamport": _EV.rstrip()
    + """, m AS (SELECT k, v % 4 AS channel, min(seq) AS hit FROM ev WHERE kind = 'error' GROUP BY 1, 2), b AS (SELECT k, min(hit) AS began, count(*) AS markers FROM m GROUP BY k)
        SELECT ev.k, CASE WHEN any_value(b.began) IS NOT NULL THEN CAST(coalesce(sum(ev.v) FILTER (ev.kind <> 'error' AND ev.seq < b.began), 0) AS BIGINT) END AS local_state, count(*) FILTER (ev.kind <> 'error' AND ev.seq > b.began AND ev.seq < coalesce(m.hit, 9e15)) AS in_flight,
        CAST(coalesce(sum(ev.v) FILTER (ev.kind <> 'error' AND ev.seq > b.began AND ev.seq < coalesce(m.hit, 9e15)), 0) AS BIGINT) AS in_flight_total, coalesce(any_value(b.markers), 0) = 4 AS complete
        FROM ev LEFT JOIN m ON m.k = ev.k AND m.channel = ev.v % 4 LEFT JOIN b ON b.k = ev.k GROUP BY ev.k""",
    "topology": """WITH n AS (SELECT n_regionkey AS region, n_name AS name, n_nationkey % 3 + 1 AS slots, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
        SELECT region, CAST(any_value(n) - 2 AS BIGINT) AS wires, concat(max(CASE WHEN i = n - 1 THEN name END), ' -> ', string_agg(name, ' -> ' ORDER BY i) FILTER (i < n)) AS loops, max(CASE WHEN i = n THEN name END) AS unfed, max(CASE WHEN i = n THEN name END) AS unheard, CAST(sum(slots) AS BIGINT) AS slots FROM n GROUP BY region""",
    "rebalance": """WITH s AS (SELECT protocol, step, CASE WHEN step = 1 THEN 0 WHEN protocol = 'eager' THEN 60 WHEN step = 6 THEN 60 // 5 ELSE 60 // step END AS paused, 60 // (CASE WHEN step = 6 THEN 4 ELSE step END) AS largest FROM (VALUES ('eager'), ('incremental')) p(protocol) CROSS JOIN (SELECT unnest(generate_series(1, 6)) AS step) t)
        SELECT protocol, step, CAST(paused AS BIGINT) AS paused, CAST(largest AS BIGINT) AS largest, CAST(sum(paused) OVER (PARTITION BY protocol ORDER BY step) AS BIGINT) AS bill FROM s""",
    "savepointmigrate": _EV + "SELECT v % 5 AS version, CAST(sum(CASE v % 5 WHEN 1 THEN ((v * 2 + 1) * 2 + 2) * 2 + 3 WHEN 2 THEN (v * 2 + 2) * 2 + 3 WHEN 3 THEN v * 2 + 3 WHEN 4 THEN v END) AS BIGINT) AS migrated, count(*) FILTER (v % 5 = 0) AS refused FROM ev GROUP BY 1",
    "gossip": "WITH RECURSIVE r(round_no, node) AS (SELECT 0, 0 UNION SELECT round_no + 1, unnest([node, (node * 7919 + (round_no + 1) * 104729 + 13) % 200, (node * 6101 + (round_no + 1) * 15485863 + 7) % 200]) FROM r WHERE round_no < 9) SELECT CAST(round_no AS BIGINT) AS round_no, count(DISTINCT node) AS covered FROM r WHERE round_no > 0 GROUP BY 1",
    # The five ways to put brackets around four relations.
    "joinorder": """SELECT g, least(a * b * c + a * c * d + a * d * e, a * b * c + c * d * e + a * c * e, b * c * d + a * b * d + a * d * e, b * c * d + b * d * e + a * b * e, c * d * e + b * c * e + a * b * e) AS optimal, a * b * c + a * c * d + a * d * e AS left_deep
        FROM (SELECT n_regionkey AS g, s[1] AS a, s[2] AS b, s[3] AS c, s[4] AS d, s[5] AS e FROM (SELECT n_regionkey, list(CAST((n_nationkey * 7 + 3) % 11 + 1 AS BIGINT) ORDER BY n_nationkey) AS s FROM nation GROUP BY 1) x) y""",
    "eventgraph": f"""WITH RECURSIVE ev AS ({DUCK_EVENTS}), r AS (SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS place FROM ev), line(k, place, up) AS (SELECT k, place, place // 2 FROM r WHERE place > 1 UNION ALL SELECT k, place, up // 2 FROM line WHERE up > 1)
        SELECT r.seq, (SELECT count(*) FROM line l WHERE l.k = r.k AND l.place = r.place) AS contributors, (SELECT count(*) FROM line l WHERE l.k = r.k AND l.up = r.place) AS blast_radius FROM r""",
    # The same queue as a fold of the other engine.
    "priorityinherit": f"""WITH ev AS ({DUCK_EVENTS}), p AS (SELECT k, list({{'seq': seq, 'v': v, 'back': kind = 'purchase'}} ORDER BY seq) AS xs FROM ev GROUP BY k),
        f AS (SELECT k, list_reduce(xs, lambda s, x: CASE WHEN NOT x.back AND s.h IS NULL THEN {{'h': x.v, 'w': s.w, 'n': s.n, 'i': s.i}} WHEN NOT x.back THEN {{'h': s.h, 'w': list_append(s.w, {{'p': x.v, 's': -x.seq}}), 'n': s.n, 'i': s.i}} WHEN s.h IS NULL THEN s
        ELSE {{'h': list_max(s.w).p, 'w': list_filter(s.w, lambda e: e <> list_max(s.w)), 'n': s.n + 1, 'i': s.i + CASE WHEN list_max(s.w).p > s.h THEN 1 ELSE 0 END}} END,
        {{'h': CAST(NULL AS BIGINT), 'w': CAST([] AS STRUCT(p BIGINT, s BIGINT)[]), 'n': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT)}}) AS s FROM p)
        SELECT k, s.n AS passed, s.i AS inherited, CASE WHEN s.h IS NOT NULL THEN greatest(s.h, coalesce(list_max(s.w).p, s.h)) END AS effective, CAST(len(s.w) AS BIGINT) AS waiting FROM f""",
}
