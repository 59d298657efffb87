"""Joins over time, on purchases, views and signups of one user."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import joins
from loomery.suites.frames import VIEWS, frame, register
from loomery.operators.sqlop import SqlOperator as Op

_EV = "WITH ev AS (" + VIEWS["ev"] + ") "
DAY = 86400


def _side(spark, sf_dir, kind, t):
    return frame(spark, sf_dir, "ev").filter(F.col("kind") == kind).select("k", F.col("seq").alias(f"{t}_seq"), F.col("t").alias(f"{t}_t"))


def intervaljoin(spark, sf_dir):
    left, right = _side(spark, sf_dir, "view", "l"), _side(spark, sf_dir, "purchase", "r")
    return joins.interval_join(left, right, "k", "l_t", "r_t", -DAY, 2 * DAY)


def symmetric_join(spark, sf_dir):
    left, right = _side(spark, sf_dir, "click", "l"), _side(spark, sf_dir, "purchase", "r")
    return joins.interval_join(left, right, "k", "l_t", "r_t", -DAY // 2, DAY // 2, "full")


def asof(spark, sf_dir):
    left, right = _side(spark, sf_dir, "purchase", "l"), _side(spark, sf_dir, "signup", "r")
    return joins.asof_join(left, right, "k", "l_t", "r_t", ["r_seq", "r_t"])


def windowjoin(spark, sf_dir):
    left = _side(spark, sf_dir, "signup", "l").select("l_seq", "l_t")
    right = _side(spark, sf_dir, "error", "r").select("r_seq", "r_t")
    return joins.window_join(left, right, "l_t", "r_t", DAY).groupBy("window_start").agg(F.count("*").alias("pairs"), F.max(F.abs(F.col("l_t") - F.col("r_t"))).alias("widest"))


def sideinput(spark, sf_dir):
    customer = frame(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment")
    return joins.lookup(frame(spark, sf_dir, "ev"), customer, "k").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count(F.when(F.col("c_nationkey").isNull(), 1)).alias("misses"))


SQL = {
    "broadcaststate": Op("SELECT n_name, r_name, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name, r_name"),
}
QUERIES, ORACLES = register(SQL)
QUERIES |= {"intervaljoin": intervaljoin, "joins": symmetric_join, "asof": asof, "windowjoin": windowjoin, "sideinput": sideinput}
ORACLES |= {
    "intervaljoin": _EV + f"SELECT l.k, l.seq AS l_seq, l.t AS l_t, r.seq AS r_seq, r.t AS r_t FROM ev l JOIN ev r ON l.k = r.k AND r.t BETWEEN l.t - {DAY} AND l.t + {2 * DAY} WHERE l.kind = 'view' AND r.kind = 'purchase'",
    "joins": _EV + f"SELECT coalesce(l.k, r.k) AS k, l.seq AS l_seq, l.t AS l_t, r.seq AS r_seq, r.t AS r_t FROM (SELECT * FROM ev WHERE kind = 'click') l FULL JOIN (SELECT * FROM ev WHERE kind = 'purchase') r ON l.k = r.k AND abs(r.t - l.t) <= {DAY // 2}",
    "asof": _EV + "SELECT l.k, l.seq AS l_seq, l.t AS l_t, r.seq AS r_seq, r.t AS r_t FROM (SELECT * FROM ev WHERE kind = 'purchase') l ASOF LEFT JOIN (SELECT * FROM ev WHERE kind = 'signup') r ON l.k = r.k AND l.t >= r.t",
    "windowjoin": _EV + f"SELECT CAST(l.t // {DAY} * {DAY} AS BIGINT) AS window_start, count(*) AS pairs, max(abs(l.t - r.t)) AS widest FROM ev l JOIN ev r ON l.t // {DAY} = r.t // {DAY} WHERE l.kind = 'signup' AND r.kind = 'error' GROUP BY 1",
    "sideinput": _EV + "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS misses FROM ev LEFT JOIN customer ON k = c_custkey GROUP BY 1",
}
