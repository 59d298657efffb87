"""Aggregations, sketches by exact composition, and ordered statistics, as SQL over ``(k, seq, t, v, kind, ok)``."""

from loomery.operators.sqlop import SqlOperator as Op

AGGREGATES = {
    "aggregate": Op("SELECT kind AS key, INT(t / {size}e0) * {size} AS window_start, TOTAL(v) AS total, count(*) AS n FROM {ev} GROUP BY 1, 2", {"size": 21600}),
    "backfilltag": Op("SELECT k, period, min_by(v, seq) AS original, max_by(v, seq) AS latest, count(*) - 1 AS restatements FROM (SELECT k, INT(t / 604800e0) AS period, v, seq FROM {ev}) x GROUP BY k, period"),
    "decay": Op("SELECT e.k AS k, round(sum(v * power(5e-1, (top - t) / {half}e0)), 4) AS value FROM {ev} e JOIN (SELECT k, max(t) AS top FROM {ev} GROUP BY k) m ON e.k = m.k GROUP BY e.k", {"half": 86400}),
    "gapfill": Op(
        """SELECT d.k AS k, d.day AS day, coalesce(x.n, 0) AS n, x.n IS NULL AS filled FROM (SELECT k, SERIES(lo, hi) AS day FROM (SELECT k, min(INT(t / 86400e0)) AS lo, max(INT(t / 86400e0)) AS hi FROM {ev} GROUP BY k) r) d
           LEFT JOIN (SELECT k, INT(t / 86400e0) AS day, count(*) AS n FROM {ev} GROUP BY 1, 2) x ON d.k = x.k AND d.day = x.day"""
    ),
    "gaugestream": Op("SELECT kind, CASE WHEN kind IN ('click', 'view') THEN TOTAL(v) ELSE max_by(v, seq) END AS reading FROM {ev} GROUP BY kind"),
    # Two-stage aggregation of a skewed key; the maximum is the true one.
    "hotpartition": Op(
        "SELECT kind, TOTAL(s) AS total, max(m) AS largest, TOTAL(n) AS n FROM (SELECT kind, seq % {fanout} AS salt, TOTAL(v) AS s, max(v) AS m, count(*) AS n FROM {ev} GROUP BY 1, 2) x GROUP BY kind",
        {"fanout": 8},
        "SELECT kind, TOTAL(v) AS total, max(v) AS largest, count(*) AS n FROM {ev} GROUP BY kind",
    ),
    "keychurn": Op("SELECT w, count(*) AS users, TOTAL(CASE WHEN f = w THEN 1 ELSE 0 END) AS novel FROM (SELECT DISTINCT INT(t / 86400e0) AS w, k, min(INT(t / 86400e0)) OVER (PARTITION BY k) AS f FROM {ev}) x GROUP BY w"),
    "localagg": Op("SELECT kind, TOTAL(n) AS n, TOTAL(s) AS total, max(m) AS largest, count(*) AS shipped, TOTAL(n) - count(*) AS saved FROM (SELECT kind, INT(seq / {batch}e0) AS b, count(*) AS n, TOTAL(v) AS s, max(v) AS m FROM {ev} GROUP BY 1, 2) x GROUP BY kind", {"batch": 100}),
    # A true count, whatever the values.
    "localcombine": Op("SELECT kind, TOTAL(n) AS n, min(lo) AS least, max(hi) AS most FROM (SELECT kind, k, count(*) AS n, min(v) AS lo, max(v) AS hi FROM {ev} GROUP BY 1, 2) x GROUP BY kind", {}, "SELECT kind, count(*) AS n, min(v) AS least, max(v) AS most FROM {ev} GROUP BY kind"),
    # The size of value, if any, that more than half of a user's events have.
    "majority": Op(
        "SELECT k, size FROM (SELECT k, size, count(*) AS c, CAST(sum(count(*)) OVER (PARTITION BY k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN v < 40 THEN 'small' WHEN v < 80 THEN 'middle' ELSE 'large' END AS size FROM {ev}) w GROUP BY k, size) x WHERE 2 * c > n",
        {},
        "SELECT k, CASE WHEN s THEN 'small' WHEN m THEN 'middle' ELSE 'large' END AS size FROM (SELECT k, avg(CASE WHEN v < 40 THEN 1e0 ELSE 0e0 END) > 0.5 AS s, avg(CASE WHEN v >= 40 AND v < 80 THEN 1e0 ELSE 0e0 END) > 0.5 AS m, avg(CASE WHEN v >= 80 THEN 1e0 ELSE 0e0 END) > 0.5 AS l FROM {ev} GROUP BY k) x WHERE s OR m OR l",
    ),
    "onlineregression": Op("SELECT k, round(regr_slope(v, seq), 8) AS slope, round(regr_intercept(v, seq), 6) AS intercept FROM {ev} GROUP BY k HAVING count(*) > 1"),
    "outlier": Op(
        """SELECT e.k AS k, e.seq AS seq, e.v AS v FROM {ev} e JOIN (SELECT f.k AS k, med, median(abs(f.v - med)) AS mad FROM {ev} f JOIN (SELECT k, median(v) AS med FROM {ev} GROUP BY k) m ON f.k = m.k GROUP BY f.k, med) d ON e.k = d.k
           WHERE mad > 0 AND 0.6745e0 * abs(e.v - med) / mad > {threshold}""",
        {"threshold": 1.2},
    ),
    "readmodel": Op("SELECT k, TOTAL(v) AS balance, max(seq) AS applied, (SELECT max(seq) FROM {ev}) - max(seq) AS staleness, TOTAL(CASE WHEN seq - p > 100 THEN 1 ELSE 0 END) AS gaps FROM (SELECT k, v, seq, lag(seq) OVER (PARTITION BY k ORDER BY seq) AS p FROM {ev}) x GROUP BY k"),
    "retraction": Op("SELECT k, TOTAL(w * v) AS total, max(CASE WHEN net > 0 THEN v END) AS largest FROM (SELECT k, v, w, CAST(sum(w) OVER (PARTITION BY k, v) AS BIGINT) AS net FROM (SELECT k, v, CASE WHEN ok THEN 1 ELSE -1 END AS w FROM {ev}) a) b GROUP BY k"),
    "subarraysum": Op(
        """SELECT a.k AS k, count(*) AS runs FROM (SELECT k, seq, CAST(sum(v) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS p, CAST(sum(v) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) - v AS q FROM {ev}) a
           JOIN (SELECT k, seq, CAST(sum(v) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS p FROM {ev}) b ON a.k = b.k AND b.seq >= a.seq AND b.p = a.q + {target} GROUP BY a.k""",
        {"target": 100},
    ),
    "weightedmedian": Op("SELECT k, min(v) AS median FROM (SELECT k, v, CAST(sum(seq) OVER (PARTITION BY k ORDER BY v) AS BIGINT) AS c, CAST(sum(seq) OVER (PARTITION BY k) AS BIGINT) AS total FROM {ev}) x WHERE 2 * c >= total GROUP BY k"),
    "welford": Op("SELECT k, round(avg(v), 6) AS mean, round(var_pop(v), 5) AS variance, count(*) AS n FROM {ev} GROUP BY k"),
    "windoweddistinct": Op(
        "SELECT k, seq, CAST(size(collect_set(item) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS BIGINT) AS distinct_items FROM (SELECT k, seq, v % 6 AS item FROM {ev}) x",
        {},
        "SELECT k, seq, count(DISTINCT v % 6) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS distinct_items FROM {ev}",
    ),
}

SKETCHES = {
    "cardinality": Op("SELECT kind, round({m} * ln({m}e0 / ({m} - used)), 4) AS estimate FROM (SELECT kind, count(DISTINCT BUCKET(k, {m})) AS used FROM {ev} GROUP BY kind) x WHERE used < {m}", {"m": 1024}),
    "bloomsizing": Op(
        """SELECT n, bits, hashes, round(power(1 - exp(-hashes * n / CAST(bits AS DOUBLE)), hashes), 8) AS rate FROM (SELECT n, bits, greatest(CAST(1 AS BIGINT), CAST(round(bits / n * ln(2e0)) AS BIGINT)) AS hashes FROM (SELECT n, CAST(ceil(-n * ln({rate}) / power(ln(2e0), 2)) AS BIGINT) AS bits FROM
           (SELECT kind, CAST(count(*) AS DOUBLE) AS n FROM {ev} GROUP BY kind) a) b) c""",
        {"rate": "1e-2"},
    ),
    # 512 bits, three hashes: how many of a kind's users a filter of the kind's first half admits as new.
    "bloomdedupe": Op(
        """SELECT kind, count(*) AS offered, TOTAL(CASE WHEN hits < 3 THEN 1 ELSE 0 END) AS admitted FROM (SELECT p.kind AS kind, p.k AS k, count(DISTINCT b.h) AS hits FROM (SELECT DISTINCT kind, k, h, BUCKET(concat(TEXT(h), ':', TEXT(k)), 512) AS bit FROM {ev} CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 AS h UNION ALL SELECT 2 AS h) i) p
           LEFT JOIN (SELECT DISTINCT kind, h, BUCKET(concat(TEXT(h), ':', TEXT(k)), 512) AS bit FROM {ev} CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 AS h UNION ALL SELECT 2 AS h) i WHERE k % 2 = 0) b ON p.kind = b.kind AND p.h = b.h AND p.bit = b.bit GROUP BY p.kind, p.k) x GROUP BY kind"""
    ),
    "sketch": Op(
        """WITH cells AS (SELECT row_no, BUCKET(concat('row', TEXT(row_no), '|', TEXT(k)), {width}) AS cell, count(*) AS n FROM {ev} CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST({depth} - 1 AS BIGINT)) AS row_no) r GROUP BY 1, 2)
           SELECT q.k AS k, min(c.n) AS estimate, min(q.n) AS truth FROM (SELECT k, row_no, BUCKET(concat('row', TEXT(row_no), '|', TEXT(k)), {width}) AS cell, count(*) AS n FROM {ev} CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST({depth} - 1 AS BIGINT)) AS row_no) r GROUP BY 1, 2, 3) q
           JOIN cells c ON q.row_no = c.row_no AND q.cell = c.cell GROUP BY q.k""",
        {"width": 64, "depth": 4},
    ),
    "countsketch": Op(
        """WITH cells AS (SELECT row_no, BUCKET(concat('c', TEXT(row_no), '|', TEXT(k)), {width}) AS cell, TOTAL(1 - 2 * BUCKET(concat('s', TEXT(row_no), '|', TEXT(k)), 2)) AS n FROM {ev} CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST(4 AS BIGINT)) AS row_no) r GROUP BY 1, 2)
           SELECT q.k AS k, INT(median(c.n * q.sign)) AS estimate FROM (SELECT DISTINCT k, row_no, BUCKET(concat('c', TEXT(row_no), '|', TEXT(k)), {width}) AS cell, 1 - 2 * BUCKET(concat('s', TEXT(row_no), '|', TEXT(k)), 2) AS sign FROM {ev} CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST(4 AS BIGINT)) AS row_no) r) q
           JOIN cells c ON q.row_no = c.row_no AND q.cell = c.cell GROUP BY q.k""",
        {"width": 64},
    ),
    "latencyhistogram": Op("SELECT kind, bucket, count(*) AS n FROM (SELECT kind, CASE WHEN v <= 1 THEN 1 WHEN v <= 10 THEN 10 WHEN v <= 100 THEN 100 WHEN v <= 1000 THEN 1000 ELSE 100000 END AS bucket FROM {ev}) x GROUP BY kind, bucket"),
    "metricstream": Op("SELECT k, max(CASE WHEN r = greatest(1, CAST(ceil(n * 0.9e0) AS BIGINT)) THEN v END) AS p90, max(v) AS worst FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v, seq) AS r, count(*) OVER (PARTITION BY k) AS n FROM (SELECT k, v, seq, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS back FROM {ev}) a WHERE back <= {last}) b GROUP BY k", {"last": 20}),
    "minhash": Op(
        """WITH sig AS (SELECT kind, i, min(HASH(concat(TEXT(i), ':', TEXT(k)))) AS h FROM {ev} CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST({hashes} - 1 AS BIGINT)) AS i) s GROUP BY 1, 2)
           SELECT a.kind AS left_kind, b.kind AS right_kind, TOTAL(CASE WHEN a.h = b.h THEN 1 ELSE 0 END) AS agreeing FROM sig a JOIN sig b ON a.i = b.i AND a.kind < b.kind GROUP BY 1, 2""",
        {"hashes": 32},
    ),
    "simhash": Op(
        """SELECT kind, TOTAL(CASE WHEN votes > 0 THEN CAST(power(2, bit) AS BIGINT) ELSE 0 END) AS fingerprint FROM (SELECT kind, bit, sum(CASE WHEN INT(h / power(2e0, bit)) % 2 = 1 THEN w ELSE -w END) AS votes FROM (SELECT kind, HASH(k) AS h, count(*) AS w FROM {ev} GROUP BY 1, 2) f CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST(31 AS BIGINT)) AS bit) b GROUP BY 1, 2) x GROUP BY kind"""
    ),
    "reservoir": Op("SELECT kind, seq FROM (SELECT kind, seq, row_number() OVER (PARTITION BY kind ORDER BY HASH(seq), seq) AS r FROM {ev}) x WHERE r <= {size}", {"size": 20}),
    "weightedreservoir": Op("SELECT kind, seq FROM (SELECT kind, seq, row_number() OVER (PARTITION BY kind ORDER BY round(ln((HASH(seq) + 1) / 4294967297e0) / (v + 1), 12) DESC, seq) AS r FROM {ev}) x WHERE r <= {size}", {"size": 20}),
}
OPERATORS = AGGREGATES | SKETCHES
