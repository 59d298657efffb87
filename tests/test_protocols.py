"""Delivery, coordination, topologies and row keys on small scripts."""

import itertools
import random

import pytest

from loomery.errors import BadRequest, Stopped
from loomery.operators import coordination as c
from loomery.operators import delivery as d
from loomery.operators import joins
from loomery.operators.row_keys import free_name, keyed
from loomery.plans.components import connected_components
from loomery.suites.algorithms import fair_shares
from loomery.suites.coordination import chain_cost, migrate


def test_epochs_publish_once_and_crashes_drop_what_is_pending():
    sink = d.EpochSink()
    sink.stage(0, "a")
    assert sink.commit(0) and not sink.commit(0)
    sink.stage(0, "late")
    sink.stage(1, "b")
    assert sink.crash_recovery() == 1 and sink.published == ["a"]
    assert sink.audit() == {"published": 1, "pending": 0, "dropped": 1, "replays": 1, "epochs": 1}


def test_files_are_published_by_checkpoints_alone():
    files = d.FileCommitter()
    files.stage("x", 1)
    with pytest.raises(Stopped):
        files.finalize_before_checkpoint("x")
    assert files.commit_checkpoint(["x", "unknown"]) == 1 and files.commit_checkpoint(["x"]) == 0
    files.stage("y", 2)
    assert files.recover() == 1 and files.published == {"x": 1}


def test_crash_drills_lose_or_repeat_one_record_a_crash():
    assert d.crash_drill(10, {4}, "commit_first") == {"records": 9, "lost": 1, "duplicated": 0, "distinct": 9}
    assert d.crash_drill(10, {4, 9}, "process_first") == {"records": 12, "lost": 0, "duplicated": 2, "distinct": 10}
    with pytest.raises(BadRequest):
        d.OffsetConsumer("hope")


def test_transactions_commit_with_their_offset_abort_and_are_fenced():
    s = d.TransactionalSession()
    s.begin()
    s.stage("a")
    with pytest.raises(Stopped):
        s.begin()
    assert s.commit(5, 0) and s.output == ["a"] and s.offset == 5
    s.begin()
    s.stage("b")
    assert s.abort() == 1 and s.offset == 5
    s.begin()
    s.stage("c")
    s.fence(1)
    assert not s.commit(9, 0) and s.output == ["a"] and s.offset == 5 and s.fenced == 1


def test_write_back_sends_each_dirty_key_once_and_a_crash_loses_them():
    back = d.WriteBackCache()
    for i in range(10):
        back.write(i % 3, i)
    assert back.flush() == 3 and back.read(0) == 9
    back.write(0, "new")
    assert back.read(0) == "new" and back.crash() == 1 and back.read(0) == 9 and back.store_writes() == 3


def test_causal_delivery_in_any_order_of_arrival():
    sent = [(0, [1, 0], "a"), (1, [1, 1], "b"), (0, [2, 1], "c"), (1, [2, 2], "d")]
    for order in itertools.permutations(sent):
        inbox, out = c.CausalDelivery(2), []
        for message in order:
            out += inbox.receive(*message)
        assert out == ["a", "b", "c", "d"] and inbox.pending() == 0


def test_snapshot_lock_and_topology():
    p = c.SnapshotProcess(["x", "y"])
    p.receive("x", 1)
    p.marker("x", 10)
    p.receive("x", 2)
    p.receive("y", 3)
    assert p.in_flight("x") == [] and p.in_flight("y") == [3] and not p.complete()
    p.marker("y", 99)
    assert p.complete() and p.state == 10
    lock = c.PriorityLock()
    assert lock.acquire("low", 1) and not lock.acquire("high", 9) and lock.holder_effective_priority() == 9
    assert lock.can_preempt(10) and not lock.can_preempt(9) and lock.release() == ("high", 9)
    t = c.Topology()
    for name, source, sink in (("in", True, False), ("mid", False, False), ("out", False, True), ("spare", False, False)):
        t.add_stage(name, 2, source, sink)
    t.wire("in", "mid")
    t.wire("mid", "out")
    with pytest.raises(Stopped, match="out -> in -> mid -> out"):
        t.wire("out", "in")
    assert t.unfed() == ["spare"] == t.unheard() and t.slot_bill() == 8


def test_incremental_groups_move_only_what_they_must():
    rng = random.Random(1)
    for protocol in ("eager", "incremental"):
        group, members = c.ConsumerGroup(protocol, 37), []
        for n in range(40):
            if members and rng.random() < 0.4:
                gone = members.pop(rng.randrange(len(members)))
                held = len(group.owned[gone])
                assert group.leave(gone) == (held if protocol == "incremental" else 37)
            else:
                members.append(f"m{n}")
                before = {m: set(ps) for m, ps in group.owned.items()}
                paused = group.join(members[-1])
                if protocol == "incremental" and before:
                    assert paused == 37 // len(members) and all(set(group.owned[m]) <= ps for m, ps in before.items())
            if members:
                assert sorted(p for ps in group.owned.values() for p in ps) == list(range(37))


def test_migration_stops_where_no_step_is_registered(spark):
    states = spark.createDataFrame([(v, 10) for v in range(5)], "version long, state long")
    steps = spark.createDataFrame([(1, 2, 1), (2, 3, 0), (3, 1, 5)], "from_version long, factor long, plus long")
    out = {r["version"]: (r["reached"], r["state"]) for r in migrate(states, steps, 4).collect()}
    assert out == {0: (0, 10), 1: (4, 68), 2: (4, 35), 3: (4, 15), 4: (4, 10)}


def test_chain_cost_equals_all_ways_to_put_brackets(spark):
    rng = random.Random(2)
    groups = {g: [rng.randrange(1, 20) for _ in range(rng.randrange(2, 8))] for g in range(6)}

    def best(d):
        return min((best(d[: i + 1]) + best(d[i:]) + d[0] * d[i] * d[-1] for i in range(1, len(d) - 1)), default=0)

    sizes = spark.createDataFrame([(g, i, x) for g, d in groups.items() for i, x in enumerate(d)], "g long, at long, d long")
    out = {r["g"]: (r["optimal"], r["left_deep"]) for r in chain_cost(sizes).collect()}
    assert out == {g: (best(d), sum(d[0] * d[i] * d[i + 1] for i in range(1, len(d) - 1))) for g, d in groups.items()}


def test_fair_shares_spend_the_capacity(spark):
    demands = [5, 80, 10, 80, 40]
    out = {r["k"]: r["share"] for r in fair_shares(spark.createDataFrame(list(enumerate(demands)), "k long, demand long"), 100).collect()}
    assert out == {0: 5, 1: 28, 2: 10, 3: 28, 4: 28}
    assert [r["share"] for r in fair_shares(spark.createDataFrame([(1, 7)], "k long, demand long"), 100).collect()] == [7]


def test_interval_join_of_nulls_and_repeats_against_a_loop(spark):
    rng = random.Random(3)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), rng.choice([None, "x"])) for _ in range(60)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), rng.choice([None, "y"])) for _ in range(60)]
    a, b = spark.createDataFrame(left, "k string, lt long, p string"), spark.createDataFrame(right, "k string, rt long, q string")

    def meet(x, y):
        return x[0] is not None and x[0] == y[0] and None not in (x[1], y[1]) and 0 <= y[1] - x[1] <= 5

    pairs = [(*x, y[1], y[2]) for x in left for y in right if meet(x, y)]
    lone = [(*x, None, None) for x in left if not any(meet(x, y) for y in right)]
    other = [(y[0], None, None, y[1], y[2]) for y in right if not any(meet(x, y) for x in left)]
    for how, want in (("inner", pairs), ("left", pairs + lone), ("full", pairs + lone + other)):
        out = [tuple(r[x] for x in ("k", "lt", "p", "rt", "q")) for r in joins.interval_join(a, b, "k", "lt", "rt", 0, 5, how).collect()]
        assert sorted(out, key=repr) == sorted(want, key=repr)


def test_row_keys_keep_the_order_of_ids(spark):
    clean = spark.createDataFrame([(3, "a"), (1, "b")], "id long, row_key string")
    name = free_name(clean)
    assert name == "row_key_" and {(r["id"], r[name]) for r in keyed(clean, "id", name).collect()} == {(3, 3), (1, 1)}
    rows = spark.createDataFrame([(i % 4 or None, f"t{i}", "x", "y") for i in range(40)], "id long, row_key string, _group string, _row string")
    for nulls_first in (False, True):
        out = sorted(keyed(rows, "id", name, nulls_first).collect(), key=lambda r: r[name])
        assert [r[name] for r in out] == list(range(40)) and len({r["row_key"] for r in out}) == 40
        assert [r["id"] for r in out] == ([None] * 10 if nulls_first else []) + [i for i in (1, 2, 3) for _ in range(10)] + ([] if nulls_first else [None] * 10)


def test_components_of_a_long_chain_with_chords_take_few_rounds(spark, monkeypatch):
    import loomery.plans.components as plan

    rounds, stage = [], plan.staged
    monkeypatch.setattr(plan, "staged", lambda df, label: rounds.append(label) or stage(df, label))
    n = 10_000
    edges = spark.range(n).selectExpr("id AS src", "id + 1 AS dst").union(spark.range(n - 1).selectExpr("id AS src", "id + 2 AS dst"))
    out = connected_components(edges)
    assert out.count() == n + 1 and out.filter("component <> 0").count() == 0
    assert rounds.count("cc-parents") < 20
