"""Streaming operators against their batch twins, over files in several micro-batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomery.streaming import pipelines as p

T0 = datetime.datetime(2024, 1, 1)
ROWS = [
    (1, 1, 10, "view", 3), (2, 1, 12, "click", 5), (3, 2, 14, "view", 1), (4, 1, 30, "purchase", 2), (5, 2, 33, "purchase", 9), (6, 2, 20, "click", 4),
    (7, 1, 200, "view", 7), (8, 2, 210, "view", 8), (9, 1, 5000, "view", 1), (10, 2, 5001, "view", 1), (11, 1, 9000, "purchase", 0),
]


@pytest.fixture
def events(spark, tmp_path):
    """Files of three rows, each a micro-batch; returns (path, batch frame)."""
    rows = [(s, k, T0 + datetime.timedelta(seconds=t), kind, v) for s, k, t, kind, v in ROWS]
    import os
    import time

    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], p.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stamp = time.time() - 1000 + i
        for f in (tmp_path / "in").glob("part-*"):
            if os.path.getmtime(f) > time.time() - 900:
                os.utime(f, (stamp, stamp))
    return str(tmp_path / "in"), spark.createDataFrame(rows, p.EVENT_SCHEMA)


def run(spark, stream, tmp_path):
    p.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_windowed_totals_equal_the_batch_twin_for_closed_windows(spark, events, tmp_path):
    path, batch = events
    out = run(spark, p.windowed_totals(p.read_events(spark, path), "1 minute", "2 minutes"), tmp_path)
    got = {(r["k"], r["window_start"], r["n"], r["total"]) for r in out.collect()}
    twin = batch.groupBy("k", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    want = {(r["k"], r["w"]["start"], r["n"], r["s"]) for r in twin.collect() if r["w"]["end"] <= T0 + datetime.timedelta(seconds=5001)}
    assert {w for w in want if w[1] < T0 + datetime.timedelta(seconds=4000)} <= got
    every = {(r["k"], r["w"]["start"], r["n"], r["s"]) for r in twin.collect()}
    assert got <= every


def test_a_second_run_goes_on_and_repeats_nothing(spark, events, tmp_path):
    path, _ = events
    first = run(spark, p.windowed_totals(p.read_events(spark, path), "1 minute", "2 minutes"), tmp_path).count()
    assert run(spark, p.windowed_totals(p.read_events(spark, path), "1 minute", "2 minutes"), tmp_path).count() == first


def test_deduplication_and_matches(spark, events, tmp_path):
    path, batch = events
    both = p.read_events(spark, path, 2)
    twice = both.unionByName(both)
    assert run(spark, p.deduplicated(twice, ["seq"], "1 hour"), tmp_path).count() == len(ROWS)


def test_interval_join_emits_pairs_and_unmatched(spark, events, tmp_path):
    path, _ = events
    view = p.read_events(spark, path).filter("kind = 'view'")
    bought = p.read_events(spark, path).filter("kind = 'purchase'")
    out = {(r["l_seq"], r["r_seq"]) for r in run(spark, p.matched(view, bought, "25 SECONDS", "30 seconds"), tmp_path).collect()}
    assert {(1, 4), (3, 5)} <= out and (7, None) in out


def test_pattern_matches_over_batches(spark, events, tmp_path):
    path, _ = events
    out = run(spark, p.pattern_matches(p.read_events(spark, path), ("view", "click", "purchase"), 60), tmp_path).collect()
    assert {(r["k"], r["seq"], r["took"]) for r in out} == {(1, 4, 20), (2, 5, 19)}


def test_sessions_and_sliding_windows(spark, events, tmp_path):
    path, _ = events
    out = run(spark, p.session_totals(p.read_events(spark, path), "1 minute", "2 minutes"), tmp_path)
    assert {(r["k"], r["n"]) for r in out.collect()} >= {(1, 3), (2, 3)}
    slid = run(spark, p.sliding_totals(p.read_events(spark, path), "2 minutes", "1 minute", "2 minutes"), tmp_path / "b")
    assert slid.filter("kind = 'view'").agg(F.max("n")).first()[0] == 2
