"""Summaries over each kind's or user's events, held against exact counts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from loomery.operators.keyed import run_by_key, summarise
from loomery.operators.sketches import CuckooFilter, Dgim, MisraGries, QuantileSummary, SpaceSaving
from loomery.operators.small_graphs import alias_table
from loomery.suites.frames import frame
from loomery.suites.machines import DUCK_EVENTS

_EV = f"WITH ev AS ({DUCK_EVENTS}) "
K_OF, TOP, WINDOW, BUDGET, NEAR = 8, 5, 16, 128, 0.05


def _items(spark, sf_dir, item):
    return spark.sql(f"SELECT kind, {item} AS item FROM {{ev}}", ev=frame(spark, sf_dir, "ev"))


def misragries(spark, sf_dir):
    """Items with more than a ``K_OF``-th of their kind: candidates of a bounded summary, counted exactly in a second pass."""
    rows = _items(spark, sf_dir, "CAST(floor(v / 10) AS BIGINT)")
    found = summarise(rows, "kind", "item", partial(MisraGries, K_OF), lambda s: [(i, s.seen) for i in s.candidates()], "item long, total long")
    counted = rows.join(F.broadcast(found), ["kind", "item"]).groupBy("kind", "item", "total").agg(F.count("*").alias("n"))  # K_OF - 1 candidates a kind
    return counted.filter(F.col("n") * K_OF > F.col("total")).select("kind", "item", "n")


def _hitters(by_age):
    def query(spark, sf_dir):
        rows = _items(spark, sf_dir, "v % 40")
        return summarise(rows, "kind", "item", partial(SpaceSaving, 64, by_age), lambda s: s.hitters(TOP), "item long, n long, overcount long")

    return query


def quantile(spark, sf_dir):
    """Quartiles by a budgeted summary, and whether their exact ranks are near."""
    rows = _items(spark, sf_dir, "v")
    made = summarise(rows, "kind", "item", partial(QuantileSummary, BUDGET), lambda s: [(s.quantile(0.25), s.quantile(0.75))], "q25 long, q75 long")

    def near(q, rank):
        below, upto = F.avg((F.col("item") < F.col(q)).cast("int")), F.avg((F.col("item") <= F.col(q)).cast("int"))
        return ((below <= rank + NEAR) & (upto >= rank - NEAR)).alias(f"{q}_near")

    return rows.join(F.broadcast(made), "kind").groupBy("kind").agg(F.count("*").alias("n"), near("q25", 0.25), near("q75", 0.75))


class _Ones:
    def __init__(self):
        self.sketch = Dgim(WINDOW)

    def step(self, ok):
        self.sketch.observe(ok)
        return ()

    def finish(self):
        return [(self.sketch.estimate(), self.sketch.bucket_count())]


def dgim(spark, sf_dir):
    """Ones among each user's last bits: exact, and whether the estimate is within a half."""
    ev = frame(spark, sf_dir, "ev")
    made = run_by_key(ev, ["k"], ["seq"], ["ok"], _Ones, "estimate long, buckets long")
    exact = spark.sql(f"SELECT k, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM (SELECT k, ok, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS back FROM {{ev}}) x WHERE back <= {WINDOW} GROUP BY k", ev=ev)
    return made.join(exact, "k").select("k", "ones", (F.abs(F.col("estimate") - F.col("ones")) * 2 <= F.col("ones")).alias("close"), (F.col("buckets") <= 2 * (WINDOW.bit_length() + 1)).alias("small"))


class _Members:
    """Adds all, asks for all, deletes the even ones, asks for the odd ones."""

    def __init__(self, buckets):
        self.filter, self.items = CuckooFilter(buckets), []

    def step(self, item):
        if self.filter.add(item):
            self.items.append(item)
        return ()

    def finish(self):
        missing = sum(not self.filter.contains(i) for i in self.items)
        deleted = sum(self.filter.delete(i) for i in self.items if i % 2 == 0)
        lost = sum(not self.filter.contains(i) for i in self.items if i % 2)
        return [(len(self.items), missing, deleted, lost, round(self.filter.load() * self.filter.SLOTS * len(self.filter.rows)))]


def cuckoofilter(spark, sf_dir):
    """Each kind's users in a filter sized for them: no false negatives, before and after deletions."""
    users = frame(spark, sf_dir, "ev").select("kind", "k").distinct()
    most = users.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    buckets = 1 << (most // 2 + 1).bit_length()
    return run_by_key(users, ["kind"], ["k"], ["k"], partial(_Members, buckets), "added long, missing long, deleted long, lost long, held long")


class _Alias:
    """The shares that an alias table gives its columns."""

    def __init__(self):
        self.names, self.weights = [], []

    def step(self, name, weight):
        self.names.append(name)
        self.weights.append(weight)
        return ()

    def finish(self):
        table, n = alias_table(self.weights), len(self.names)
        share = [keep / n for keep, _ in table]
        for keep, other in table:
            share[other] += (1 - keep) / n
        return [(name, round(p, 9)) for name, p in zip(self.names, share, strict=True)]


def aliasmethod(spark, sf_dir):
    weights = frame(spark, sf_dir, "ev").groupBy("k", "kind").agg(F.count("*").alias("n"))
    return run_by_key(weights, ["k"], ["kind"], ["kind", "n"], _Alias, "item string, p double")


def hyperloglog(spark, sf_dir):
    """64 registers for each half of the users, merged by their maxima; linear counting where the raw estimate is small."""
    return spark.sql(
        """WITH h AS (SELECT kind, k % 2 AS shard, CAST(conv(substring(sha2(CAST(k AS STRING), 256), 1, 8), 16, 10) AS BIGINT) AS h FROM {ev}),
           r AS (SELECT kind, shard, h % 64 AS reg, max(CASE WHEN h < 64 THEN 32 ELSE CAST(round(log2((h DIV 64) & -(h DIV 64))) AS BIGINT) + 1 END) AS rank FROM h GROUP BY 1, 2, 3),
           m AS (SELECT kind, reg, max(rank) AS rank FROM r GROUP BY 1, 2),
           e AS (SELECT kind, count(*) AS registers, 0.7e0 * 64 * 64 / (sum(power(2e0, -rank)) + 64 - count(*)) AS raw FROM m GROUP BY kind)
           SELECT kind, registers, round(CASE WHEN raw <= 160 AND registers < 64 THEN 64 * ln(64e0 / (64 - registers)) ELSE raw END, 4) AS estimate FROM e""",
        ev=frame(spark, sf_dir, "ev"),
    )


QUERIES = {"misragries": misragries, "topk": _hitters(False), "topn": _hitters(True), "quantile": quantile, "dgim": dgim, "cuckoofilter": cuckoofilter, "aliasmethod": aliasmethod, "hyperloglog": hyperloglog}
_TOP = _EV + f"SELECT kind, item, n, CAST(0 AS BIGINT) AS overcount FROM (SELECT kind, v % 40 AS item, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, v % 40) AS r FROM ev GROUP BY 1, 2) x WHERE r <= {TOP}"
ORACLES = {
    "misragries": _EV + f"SELECT kind, v // 10 AS item, count(*) AS n FROM ev x GROUP BY 1, 2 HAVING count(*) * {K_OF} > (SELECT count(*) FROM ev y WHERE y.kind = x.kind)",
    "topk": _TOP,
    "topn": _TOP,
    "quantile": _EV + "SELECT kind, count(*) AS n, TRUE AS q25_near, TRUE AS q75_near FROM ev GROUP BY kind",
    "dgim": _EV + f"SELECT k, CAST(list_sum(list_transform(list(ok ORDER BY seq DESC)[:{WINDOW}], lambda b: CAST(b AS INT))) AS BIGINT) AS ones, TRUE AS close, TRUE AS small FROM ev GROUP BY k",
    "cuckoofilter": _EV + "SELECT kind, count(DISTINCT k) AS added, CAST(0 AS BIGINT) AS missing, count(DISTINCT k) FILTER (k % 2 = 0) AS deleted, CAST(0 AS BIGINT) AS lost, count(DISTINCT k) FILTER (k % 2 = 1) AS held FROM ev GROUP BY kind",
    "aliasmethod": _EV + "SELECT k, kind AS item, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY k) AS DOUBLE), 9) AS p FROM ev GROUP BY k, kind",
    "hyperloglog": _EV.rstrip() + """, b AS (SELECT kind, h % 64 AS reg, bin(h // 64) AS bits FROM (SELECT DISTINCT kind, CAST(CAST(concat('0x', substr(sha256(CAST(k AS VARCHAR)), 1, 8)) AS UBIGINT) AS BIGINT) AS h FROM ev) x),
        m AS (SELECT kind, reg, max(CASE WHEN bits = '0' THEN 32 ELSE length(bits) - length(rtrim(bits, '0')) + 1 END) AS rank FROM b GROUP BY 1, 2),
        e AS (SELECT kind, count(*) AS registers, 0.7e0 * 4096 / (sum(pow(2e0, -rank)) + 64 - count(*)) AS raw FROM m GROUP BY kind)
        SELECT kind, registers, round(CASE WHEN raw <= 160 AND registers < 64 THEN 64 * ln(64e0 / (64 - registers)) ELSE raw END, 4) AS estimate FROM e""",
}
