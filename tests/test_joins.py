"""Joins over time and skew-safe joins on literal tapes and against nested loops."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomery.errors import BadRequest
from loomery.operators import joins
from loomery.operators.skew import join_back
from loomery.suites import joins as suite


def frames(spark, left, right):
    return spark.createDataFrame(left, "k string, lt long"), spark.createDataFrame(right, "k string, rt long")


def test_interval_join_bounds_and_unmatched(spark):
    left, right = frames(spark, [("o1", 100), ("o2", 200)], [("o1", 150), ("o2", 180), ("o9", 5)])
    def pairs(lower, how="inner"):
        return {tuple(r[c] for c in ("k", "lt", "rt")) for r in joins.interval_join(left, right, "k", "lt", "rt", lower, 300, how).collect()}

    assert pairs(0) == {("o1", 100, 150)}
    assert pairs(-300) == {("o1", 100, 150), ("o2", 200, 180)}
    assert pairs(0, "left") == {("o1", 100, 150), ("o2", 200, None)}
    assert pairs(0, "full") == {("o1", 100, 150), ("o2", 200, None), ("o2", None, 180), ("o9", None, 5)}
    with pytest.raises(BadRequest):
        joins.interval_join(left, right, "k", "lt", "rt", 1, 0)


def test_interval_and_asof_against_loops(spark):
    rng = random.Random(4)
    left = sorted({(rng.choice("abc"), rng.randrange(-50, 200)) for _ in range(80)})
    right = sorted({(rng.choice("abc"), rng.randrange(-50, 200)) for _ in range(80)})
    l_df, r_df = frames(spark, left, right)
    out = {(r["k"], r["lt"], r["rt"]) for r in joins.interval_join(l_df, r_df, "k", "lt", "rt", -7, 13).collect()}
    assert out == {(k, a, b) for k, a in left for j, b in right if k == j and a - 7 <= b <= a + 13}
    seen = {(r["k"], r["lt"]): r["rt"] for r in joins.asof_join(l_df, r_df, "k", "lt", "rt", ["rt"]).collect()}
    assert seen == {(k, a): max((b for j, b in right if j == k and b <= a), default=None) for k, a in left}


def test_asof_is_inclusive(spark):
    left, right = frames(spark, [("r", 250), ("r", 200), ("r", 999), ("r", 5)], [("r", 100), ("r", 200), ("r", 300)])
    out = {r["lt"]: r["rt"] for r in joins.asof_join(left, right, "k", "lt", "rt", ["rt"]).collect()}
    assert out == {250: 200, 200: 200, 999: 300, 5: None}


@pytest.mark.parametrize("step", [1, -1])
def test_asof_of_tied_rows_does_not_depend_on_their_order(spark, step):
    left, _ = frames(spark, [("r", 5), ("r", 9)], [])
    right = [("r", 4, 1, {"a": 1}), ("r", 4, 2, {"a": 2}), ("r", 4, 10, None), ("r", 4, None, {"a": 0}), ("r", 7, 3, {"a": 3})]
    right = spark.createDataFrame(right[::step], "k string, rt long, seq long, tags map<string, int>").coalesce(1)
    out = {r["lt"]: (r["seq"], r["tags"]) for r in joins.asof_join(left, right, "k", "lt", "rt", ["seq", "tags"]).collect()}
    assert out == {5: (10, None), 9: (3, {"a": 3})}


def test_asof_rows_without_key_or_time_match_nothing(spark):
    left, right = frames(spark, [("r", 250), (None, 250), ("r", None), ("s", 1)], [("r", 100), (None, 100), ("r", None), ("s", None)])
    out = {(r["k"], r["lt"]): (r["rt"], r["x"]) for r in joins.asof_join(left, right.withColumn("x", F.lit(1)), "k", "lt", "rt", ["rt", "x"]).collect()}
    assert out == {("r", 250): (100, 1), (None, 250): (None, None), ("r", None): (None, None), ("s", 1): (None, None)}


def test_asof_query_equals_its_sql_without_keys_or_times_and_gives_the_last_of_tied_rows(spark, tmp_path):
    rng, kinds = random.Random(8), ["purchase", "signup"]
    rows = [(i, rng.choice([None, *range(5)]), rng.choice([None, *range(60)]), rng.choice(kinds)) for i in range(400)]
    table = "SELECT id AS event_id, timestamp_seconds(second) AS ts, u AS user_id, kind AS event_type, 1.5D AS value, '' AS props FROM {rows}"
    spark.sql(table, rows=spark.createDataFrame(rows, "id long, u long, second long, kind string").orderBy(F.rand(3))).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    out = {r["l_seq"]: r for r in suite.asof(spark, str(tmp_path)).collect()}
    sql = duck.execute(f"SELECT k, l_seq, l_t, r_t FROM ({suite.ORACLES['asof']})").fetchall()
    assert sorted(map(repr, sql)) == sorted(repr((r["k"], r["l_seq"], r["l_t"], r["r_t"])) for r in out.values())
    last = {}
    for i, u, second, kind in rows:
        if kind == "signup" and second is not None:
            last[u, second] = i
    assert all(r["r_seq"] == (None if r["r_t"] is None else last[r["k"], r["r_t"]]) for r in out.values())


def test_join_back_with_a_hot_key(spark):
    rows = spark.createDataFrame([("hot" if k % 2 else f"k{k}", k) for k in range(5000)] + [(None, -1)], "key string, v long")
    groups = rows.filter("key is not null").groupBy("key").count().withColumnRenamed("count", "n")
    out = join_back(rows, groups, "key", "n", 5000).collect()
    assert len(out) == 5001 and all(r["n"] == (2500 if r["key"] == "hot" else None if r["key"] is None else 1) for r in out)
