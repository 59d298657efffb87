"""Edges that engines differ on: window starts, ties, late rows, population variance, stable placement."""

from pyspark.sql import functions as F

from loomery.functions.hashing import jump_hash, stable_bucket, stable_digest
from loomery.operators import aggregates, clocks, logs, machines, sequences, texts
from loomery.operators.ranking import number_rows

SCHEMA = "k long, seq long, t long, v long, kind string, ok boolean"


def ev(spark, rows):
    """Rows of (k, t, v) or longer."""
    full = [(r[0], i, r[1], r[2], r[3] if len(r) > 3 else "view", r[4] if len(r) > 4 else True) for i, r in enumerate(rows)]
    return {"ev": spark.createDataFrame(full, SCHEMA)}


def test_sliding_starts_are_aligned_and_not_negative(spark):
    op = sequences.OPERATORS["windows_sliding"]
    rows = op.apply(spark, ev(spark, [(0, 3, 1)]), size=10, slide=5).collect()
    assert [r["window_start"] for r in rows] == [0]
    rows = op.apply(spark, ev(spark, [(0, 25, 1)]), size=10, slide=5).collect()
    assert sorted(r["window_start"] for r in rows) == [20, 25]


def test_tumbling_edges(spark):
    rows = sequences.OPERATORS["windows"].apply(spark, ev(spark, [(0, 19, 1), (0, 20, 1)]), size=10).collect()
    assert sorted((r["window_start"], r["window_end"], r["n"]) for r in rows) == [(10, 20, 1), (20, 30, 1)]


def test_sessions_take_a_gap_as_long_as_allowed(spark):
    op = sequences.OPERATORS["windows_session"]
    rows = op.apply(spark, ev(spark, [(0, 10, 1), (0, 15, 1), (0, 25, 1)]), gap=5).collect()
    assert sorted((r["session_start"], r["session_end"], r["n"]) for r in rows) == [(10, 20, 2), (25, 30, 1)]
    capped = machines.capped_sessions(5, 100).apply(ev(spark, [(0, 10, 1), (0, 15, 1)])["ev"], ["k"], ["seq"], ["t"]).first()
    assert capped["closed"] == 1  # the capped kind closes at the gap itself


def test_counts_are_counts_and_salted_maxima_maxima(spark):
    rows = ev(spark, [(0, i, 40) for i in range(30)] + [(1, 99, 70)])
    assert aggregates.OPERATORS["localcombine"].apply(spark, rows).first()["n"] == 31
    assert aggregates.OPERATORS["hotpartition"].apply(spark, rows).first()["largest"] == 70


def test_variance_is_of_the_population(spark):
    assert aggregates.OPERATORS["welford"].apply(spark, ev(spark, [(0, i, v) for i, v in enumerate([1, 2, 3, 4, 5])])).first()["variance"] == 2.0


def test_stable_placement(spark):
    row = spark.range(1).select(stable_bucket(F.lit("key-1"), 16).alias("b"), stable_digest(F.lit("key-1")).alias("d")).first()
    assert row["b"] == 4 and len(row["d"]) == 32
    grown = spark.range(2000).select(jump_hash(F.col("id"), 9).alias("a"), jump_hash(F.col("id"), 10).alias("b")).filter("a <> b")
    assert {r["b"] for r in grown.collect()} == {9} and 120 < grown.count() < 290


def test_cutover_and_latest_images(spark):
    tape = ev(spark, [(1, 1, 10, "signup"), (2, 2, 20, "signup"), (1, 3, 11, "view"), (2, 4, 0, "error")])
    assert [(r["k"], r["image"]) for r in logs.OPERATORS["cdc"].apply(spark, tape, position=4).collect()] == [(1, 11)]
    assert logs.OPERATORS["compaction"].apply(spark, tape, grace=50).filter("dead").count() == 1
    merged = logs.OPERATORS["backfillmerge"].apply(spark, tape, cutover=2).agg(F.sum("n")).first()[0]
    assert merged == 4


def test_gap_filling_and_interval_sets(spark):
    day = 86400
    filled = aggregates.OPERATORS["gapfill"].apply(spark, ev(spark, [(0, 0, 1), (0, 3 * day, 1)])).collect()
    assert [r["n"] for r in sorted(filled, key=lambda r: r["day"])] == [1, 0, 0, 1]
    spans = ev(spark, [(0, 0, 0), (0, 600, 0), (0, 5000, 0)])  # [0, 600), [600, 1200), [5000, 5600): touching ones merge
    assert sorted((r["a"], r["b"]) for r in sequences.OPERATORS["mergeintervals"].apply(spark, spans).collect()) == [(0, 1200), (5000, 5600)]
    assert sequences.OPERATORS["intervalset"].apply(spark, spans).first()["covered"] == 1800
    assert sequences.OPERATORS["sweepline"].apply(spark, spans).first()["peak"] == 1  # ends come before starts


def test_published_figures_of_models(spark):
    primes = {n: texts.OPERATORS["sieve"].apply(spark, {}, n=n).count() for n in (100, 1000)}
    assert primes == {100: 25, 1000: 168}
    rows = clocks.OPERATORS["retrystorm"].apply(spark, {}).collect()
    peak = {r["round_no"]: (r["naive"], r["budgeted"]) for r in rows}[10]
    assert peak[0] > 4000 and peak[0] / 1000 >= 4.0 and peak[1] <= 1200


def test_numbering_is_gapless_over_partitions_and_ties(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") % 3).alias("v"))
    whole = number_rows(rows, ["v"]).collect()
    assert sorted(r["place"] for r in whole) == list(range(1000))
    assert [r["v"] for r in sorted(whole, key=lambda r: r["place"])] == sorted(r["v"] for r in whole)
    by = number_rows(rows, ["v"], group="g").collect()
    for g in range(7):
        assert sorted(r["place"] for r in by if r["g"] == g) == list(range(sum(r["g"] == g for r in by)))


def test_lateness_counts_only_rows_behind_the_bound(spark):
    # Row 1 arrives 37,200 ticks after its time, when a row of time 30,000 has been seen.
    rows = spark.createDataFrame([(0, s, t, 1, "a", True) for s, t in ((0, 0), (1, 100), (97, 30000))], SCHEMA)
    op = clocks.OPERATORS["watermark"]
    assert op.apply(spark, {"ev": rows}, bound=3).first()["late"] == 1
    assert op.apply(spark, {"ev": rows}, bound=30000).first()["late"] == 0
