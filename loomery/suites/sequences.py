"""Windows, frames, ordering and interval sets; and folds over sorted intervals."""

from pyspark.sql import functions as F

from loomery.functions.hashing import stable_bucket
from loomery.operators import machines as m
from loomery.operators.ranking import number_rows
from loomery.operators.sequences import OPERATORS
from loomery.suites.frames import frame, register
from loomery.suites.machines import DUCK_EVENTS

QUERIES, ORACLES = register(OPERATORS)
_SPARK = "SELECT k, t + (v + 1) * 3000 AS b, t AS a, seq FROM {ev}"
_DUCK = f"SELECT k, t + (v + 1) * 3000 AS b, t AS a, seq FROM ({DUCK_EVENTS})"


def _over_spans(fold):
    return lambda spark, sf_dir: fold.apply(spark.sql(_SPARK, ev=frame(spark, sf_dir, "ev")), ["k"], ["b", "seq"], ["a"])


def _by_size(fold):
    return lambda spark, sf_dir: fold.apply(spark.sql("SELECT k, -v AS down, v, seq FROM {ev}", ev=frame(spark, sf_dir, "ev")), ["k"], ["down", "seq"], ["v"])


for _name, _fold in {"intervalschedule": m.earliest_finish(), "intervalstab": m.stabbing()}.items():
    QUERIES[_name] = _over_spans(_fold)
    ORACLES[_name] = _fold.duck_sql(_DUCK, ["k"], ["b", "seq"], ["a"])
for _name, _fold in {"lpt": m.longest_processing(), "binpacking_decreasing": m.first_fit(), "jobsequencing": m.job_slots()}.items():
    QUERIES[_name] = _by_size(_fold)
    ORACLES[_name] = _fold.duck_sql(f"SELECT k, -v AS down, v, seq FROM ({DUCK_EVENTS})", ["k"], ["down", "seq"], ["v"])

# Total orders over the whole table: range partitions and offsets, no window without a partition.
_ORDERS = {
    "mergesort": (lambda: ["v", "seq"], None, "v, seq"),
    "radixsort": (lambda: [F.col("v") % 10, F.floor(F.col("v") / 10), "seq"], None, "v % 10, v // 10, seq"),
    "dutchflag": (lambda: [F.when(F.col("v") < 50, 0).when(F.col("v") == 50, 1).otherwise(2), "seq"], None, "CASE WHEN v < 50 THEN 0 WHEN v = 50 THEN 1 ELSE 2 END, seq"),
    "eventtimesort": (lambda: [F.col("t") + (F.col("seq") * 7919 % 97) * 60, "seq"], None, "t + (seq * 7919 % 97) * 60, seq"),
    "fisheryates": (lambda: [stable_bucket(F.col("seq"), 1 << 32), "seq"], None, "CAST(CAST(concat('0x', substr(sha256(CAST(seq AS VARCHAR)), 1, 8)) AS UBIGINT) AS BIGINT), seq"),
    "kwaymerge": (lambda: ["t", "seq"], "kind IN ('click', 'view')", "t, seq"),
}


def _ordered(order, keep):
    def query(spark, sf_dir):
        ev = frame(spark, sf_dir, "ev")
        return number_rows(ev.filter(keep) if keep else ev, order()).select("seq", "place")

    return query


for _name, (_order, _keep, _sql) in _ORDERS.items():
    QUERIES[_name] = _ordered(_order, _keep)
    ORACLES[_name] = f"WITH ev AS ({DUCK_EVENTS}) SELECT seq, row_number() OVER (ORDER BY {_sql}) - 1 AS place FROM ev" + (f" WHERE {_keep}" if _keep else "")


def stockspan(spark, sf_dir):
    folded = m.spans().apply(frame(spark, sf_dir, "ev"), ["k"], ["seq"], ["v"])
    return folded.select("k", F.posexplode("spans").alias("i", "span"))


def nextgreater(spark, sf_dir):
    folded = m.spans(following=True).apply(frame(spark, sf_dir, "ev").withColumn("back", -F.col("seq")), ["k"], ["back"], ["v"])
    return folded.select("k", F.posexplode(F.reverse("spans")).alias("i", "distance"))


_RANKED = f"WITH r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq) - 1 AS i FROM ({DUCK_EVENTS}) e) "
QUERIES |= {"stockspan": stockspan, "nextgreater": nextgreater}
ORACLES |= {
    "stockspan": _RANKED + "SELECT a.k, CAST(a.i AS INTEGER) AS i, min(a.i) - coalesce(max(b.i), -1) AS span FROM r a LEFT JOIN r b ON a.k = b.k AND b.i < a.i AND b.v > a.v GROUP BY a.k, a.i",
    "nextgreater": _RANKED + "SELECT a.k, CAST(a.i AS INTEGER) AS i, coalesce(min(b.i) - min(a.i), -1) AS distance FROM r a LEFT JOIN r b ON a.k = b.k AND b.i > a.i AND b.v > a.v GROUP BY a.k, a.i",
}
