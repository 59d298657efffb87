"""Algorithms over texts, numbers and one user's values; the other engine holds them against plain definitions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators import sequence_machines as m
from loomery.operators import strings
from loomery.operators.keyed import run_by_key
from loomery.operators.sequences import _RANKED
from loomery.operators.sqlop import SqlOperator as Op
from loomery.operators.texts import _AT
from loomery.sources.staging import staged
from loomery.suites.frames import frame, register
from loomery.suites.machines import DUCK_EVENTS

BUDGET, TARGET, CAPACITY = 300, 777, 20000
_EV = f"WITH ev AS ({DUCK_EVENTS}) "


def _by_user(make, schema, column="v"):
    def query(spark, sf_dir):
        return run_by_key(spark.sql(f"SELECT k, seq, {column} AS x FROM {{ev}}", ev=frame(spark, sf_dir, "ev")), ["k"], ["seq"], ["x"], make, schema)

    return query


def manacher(spark, sf_dir):
    items = frame(spark, sf_dir, "benchmark").select("item_id", "text")
    return strings.palindromes(items, "text").select("item_id", F.col("palindrome").alias("longest"))


def suffixarray(spark, sf_dir):
    items = frame(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    found = strings.suffix_arrays(items, "text").select("item_id", F.posexplode("starts").alias("place", "i"))
    return found.select("item_id", (F.col("i") + 1).alias("i"), (F.col("place") + 1).cast("long").alias("place"))


def karatsuba(spark, sf_dir):
    """Products of numbers of some nineteen digits; the operator takes any length."""
    rows = frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_partkey").cast("string"), F.lpad(F.col("l_orderkey").cast("string"), 11, "7")).alias("x"), F.concat(F.col("l_suppkey").cast("string"), F.lpad(F.col("l_partkey").cast("string"), 12, "3")).alias("y"))
    return strings.products(rows, "x", "y").select("l_orderkey", "l_linenumber", "product")


def fair_shares(demands: DataFrame, capacity: int) -> DataFrame:
    """``(k, demand, share)``: those that ask for less than an equal share of what is left get it, the others share the rest.

    The level rises from the equal share until no more demands fit under it: each round is one aggregate of two numbers.
    """
    n, total = demands.agg(F.count("*"), F.coalesce(F.sum("demand"), F.lit(0))).first()
    level, before = (capacity // n if n else 0), -1
    while total > capacity and level != before:
        fit, used = demands.filter(F.col("demand") <= level).agg(F.count("*"), F.coalesce(F.sum("demand"), F.lit(0))).first()
        level, before = (capacity - used) // max(n - fit, 1), level
    share = F.col("demand") if total <= capacity else F.least("demand", F.lit(level))
    return demands.select("k", "demand", share.cast("long").alias("share"))


def maxminfair(spark, sf_dir):
    demands = frame(spark, sf_dir, "ev").groupBy("k").agg(F.sum("v").alias("demand"))
    return fair_shares(staged(demands, "demands"), CAPACITY)


QUERIES = {f.__name__: f for f in (manacher, suffixarray, karatsuba, maxminfair)} | {
    "inversions": _by_user(m.Stretch, "inversions long"),
    "windowspan": _by_user(partial(m.LongestWithin, BUDGET), "longest long"),
    "maxrectangle": _by_user(m.LargestRectangle, "area long"),
    "partitionsum": _by_user(m.Split, "closest long, equal_split boolean", "v % 50"),
    "meetmiddle": _by_user(partial(m.Halves, TARGET), "reachable boolean"),
}
_, ORACLES = register({
    "inversions": Op("SELECT a.k AS k, count(*) AS inversions FROM {ev} a JOIN {ev} b ON a.k = b.k AND a.seq < b.seq AND a.v > b.v GROUP BY a.k"),
    "windowspan": Op("SELECT k, max(n) AS longest FROM (SELECT a.k AS k, a.i AS i, count(*) AS n FROM (SELECT k, i, p - v AS q FROM (SELECT k, i, v, CAST(sum(v) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS p FROM " + _RANKED + " x) y) a JOIN (SELECT k, i, CAST(sum(v) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS p FROM " + _RANKED + " z) b ON a.k = b.k AND b.i >= a.i AND b.p - a.q <= 300 GROUP BY a.k, a.i) c GROUP BY k"),
    "maxrectangle": Op(
        """SELECT k, max(v * (hi - lo - 1)) AS area FROM (SELECT a.k AS k, a.i AS i, min(a.v) AS v, coalesce(max(CASE WHEN b.i < a.i AND b.v < a.v THEN b.i END), 0) AS lo, coalesce(min(CASE WHEN b.i > a.i AND b.v < a.v THEN b.i END), max(n) + 1) AS hi
           FROM """ + _RANKED + " a JOIN " + _RANKED + """ b ON a.k = b.k JOIN (SELECT k, count(*) AS n FROM {ev} GROUP BY k) c ON a.k = c.k GROUP BY a.k, a.i) x GROUP BY k"""
    ),
    "suffixarray": Op("SELECT item_id, i, CAST(row_number() OVER (PARTITION BY item_id ORDER BY suffix) AS BIGINT) AS place FROM (SELECT item_id, i, substring(s, CAST(i AS INT)) AS suffix FROM " + _AT + " a) b"),
    "karatsuba": Op("SELECT l_orderkey, l_linenumber, CAST(CAST(concat(CAST(l_partkey AS VARCHAR), lpad(CAST(l_orderkey AS VARCHAR), 11, '7')) AS HUGEINT) * CAST(concat(CAST(l_suppkey AS VARCHAR), lpad(CAST(l_partkey AS VARCHAR), 12, '3')) AS HUGEINT) AS VARCHAR) AS product FROM {lineitem}"),
})
_SUMS = "list_reduce(list({0} ORDER BY seq), lambda s, x: s | (s >> CAST(x AS INTEGER)), CAST(concat('1', repeat('0', {1})) AS BIT))"
ORACLES |= {
    # Of all stretches of a text those that read the same backwards; the longest, then the earliest.
    "manacher": "SELECT b.item_id, coalesce(p.longest, '') AS longest FROM benchmark b LEFT JOIN (SELECT item_id, arg_max(p, length(p) * 100000 - i) AS longest FROM (SELECT item_id, i, text[i:j] AS p FROM (SELECT item_id, text, i, unnest(generate_series(i, length(text))) AS j FROM (SELECT item_id, text, unnest(generate_series(1, length(text))) AS i FROM benchmark) x) y WHERE text[i] = text[j]) z WHERE p = reverse(p) GROUP BY item_id) p ON p.item_id = b.item_id",
    # Reachable sums as the set bits of a bit string.
    "partitionsum": _EV + "SELECT k, CAST(min(abs(total - 2 * i)) AS BIGINT) AS closest, min(abs(total - 2 * i)) = 0 AS equal_split FROM (SELECT k, total, bits, unnest(generate_series(0, total)) AS i FROM (SELECT k, CAST(sum(v % 50) AS BIGINT) AS total, " + _SUMS.format("v % 50", "CAST(sum(v % 50) AS BIGINT)") + " AS bits FROM ev GROUP BY k) x) y WHERE get_bit(bits, CAST(i AS INTEGER)) = 1 GROUP BY k",
    "meetmiddle": _EV + f"SELECT k, get_bit(" + _SUMS.format("least(v, {t} + 1)".format(t=TARGET), str(TARGET + 1)) + f", {TARGET}) = 1 AS reachable FROM ev GROUP BY k",
    # One demand after the other, least first, against an equal share of what is left.
    "maxminfair": _EV.rstrip() + f""", d AS (SELECT k, CAST(sum(v) AS BIGINT) AS demand FROM ev GROUP BY k), o AS (SELECT k, demand, row_number() OVER (ORDER BY demand, k) AS r, count(*) OVER () AS n, coalesce(sum(demand) OVER (ORDER BY demand, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
        f AS (SELECT *, CAST(({CAPACITY} - before) // (n - r + 1) AS BIGINT) AS fair FROM o) SELECT k, demand, CASE WHEN r < (SELECT min(r) FROM f x WHERE x.demand > x.fair) THEN demand ELSE coalesce((SELECT arg_min(fair, r) FROM f x WHERE x.demand > x.fair), demand) END AS share FROM f""",
}

