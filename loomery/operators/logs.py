"""Sources, sinks, logs, delivery and routing, as SQL over event rows ``(k, seq, t, v, kind, ok)``."""

from loomery.operators.sqlop import SqlOperator as Op

OPERATORS = {
    # Backfill up to a cutover position, live from it on; a position on both sides would count twice.
    "backfillmerge": Op(
        """SELECT k, count(*) AS n, TOTAL(CASE WHEN src = 'backfill' THEN 1 ELSE 0 END) AS backfilled, TOTAL(v) AS total
           FROM (SELECT k, v, 'backfill' AS src FROM {ev} WHERE seq < {cutover} UNION ALL SELECT k, v, 'live' AS src FROM {ev} WHERE seq >= {cutover}) u GROUP BY k""",
        {"cutover": "(SELECT CAST(floor(max(seq) * 4e-1) AS BIGINT) FROM {ev})"},
    ),
    # Latest image per key at a position; deleted keys are gone.
    "cdc": Op(
        """SELECT k, v AS image, seq AS position FROM (SELECT k, v, seq, kind, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {ev} WHERE seq <= {position}) x
           WHERE r = 1 AND kind <> 'error'""",
        {"position": "(SELECT CAST(floor(max(seq) * 8e-1) AS BIGINT) FROM {ev})"},
        """SELECT k, v AS image, seq AS position FROM (SELECT k, arg_max(v, seq) AS v, max(seq) AS seq, arg_max(kind, seq) AS kind FROM {ev} WHERE seq <= {position} GROUP BY k) x WHERE kind <> 'error'""",
    ),
    # Newest snapshot plus the changes after it.
    "changelog": Op(
        """SELECT k, max_by(v, seq) AS v FROM (SELECT k, v, seq, kind FROM (SELECT k, v, seq, kind, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {ev} WHERE seq <= {snapshot}) a WHERE r = 1
           UNION ALL SELECT k, v, seq, kind FROM {ev} WHERE seq > {snapshot}) b GROUP BY k HAVING max_by(kind, seq) <> 'error'""",
        {"snapshot": "(SELECT CAST(floor(max(seq) * 5e-1) AS BIGINT) FROM {ev})"},
        "SELECT k, arg_max(v, seq) AS v FROM {ev} GROUP BY k HAVING arg_max(kind, seq) <> 'error'",
    ),
    # Last record per key; tombstones stay until they are older than the grace.
    "compaction": Op(
        """SELECT k, v, seq, dead FROM (SELECT k, max_by(v, seq) AS v, max(seq) AS seq, max_by(kind, seq) = 'error' AS dead FROM {ev} GROUP BY k) x
           WHERE NOT (dead AND (SELECT max(seq) FROM {ev}) - seq > {grace})""",
        {"grace": 50},
    ),
    # What each start position replays.
    "coldstart": Op(
        """SELECT k, count(*) AS earliest, TOTAL(CASE WHEN seq > {snapshot} THEN 1 ELSE 0 END) AS snapshot_replay, CAST(0 AS BIGINT) AS latest FROM {ev} GROUP BY k""",
        {"snapshot": "(SELECT CAST(floor(max(seq) * 6e-1) AS BIGINT) FROM {ev})"},
    ),
    "compressbatch": Op(
        """SELECT n, 40 + TOTAL(greatest(22, 100 - 7 * least(i, 10))) AS bytes, round(100e0 * n / (40 + sum(greatest(22, 100 - 7 * least(i, 10)))), 6) AS ratio
           FROM (SELECT n, SERIES(CAST(0 AS BIGINT), n - 1) AS i FROM (SELECT DISTINCT l_linenumber * {step} AS n FROM (SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber FROM {lineitem}) l) s) x GROUP BY n""",
        {"step": 16},
    ),
    "connectorhealth": Op(
        """SELECT k, CASE WHEN now - beat > 2 * {poll} THEN 'dead' WHEN lag_rising THEN 'lagging' WHEN now - coalesce(data, 0) > 3 * {poll} THEN 'idle' ELSE 'flowing' END AS status
           FROM (SELECT k, max(t) AS beat, max(CASE WHEN kind <> 'view' THEN t END) AS data, max_by(v, seq) > 90 AS lag_rising FROM {ev} GROUP BY k) x CROSS JOIN (SELECT max(t) AS now FROM {ev}) n""",
        {"poll": 43200},
    ),
    "dlq": Op(
        """SELECT k, kind, count(*) AS attempts, count(*) > {retries} AS dead_letter, min(seq) AS first_seq FROM {ev} WHERE NOT ok OR v < 20 GROUP BY k, kind""",
        {"retries": 2},
    ),
    # Disorder: adjacent descents of event time in arrival order; skew: the longest delay.
    "events": Op(
        """SELECT k, TOTAL(CASE WHEN e < p THEN 1 ELSE 0 END) AS disorder, max(a - e) AS max_skew, count(*) AS n
           FROM (SELECT k, e, a, lag(e) OVER (PARTITION BY k ORDER BY a, seq) AS p FROM (SELECT k, seq, t AS e, t + (seq * 7919 % 97) * {unit} AS a FROM {ev}) x) y GROUP BY k""",
        {"unit": 3600},
    ),
    "heartbeat": Op(
        """SELECT k, CASE WHEN pulse IS NULL THEN 'never heard' WHEN now - pulse > 2 * {every} THEN 'dead' WHEN coalesce(event, 0) < pulse THEN 'quiet' ELSE 'live' END AS reading
           FROM (SELECT k, max(CASE WHEN kind = 'view' THEN t END) AS pulse, max(CASE WHEN kind <> 'view' THEN t END) AS event FROM {ev} GROUP BY k) x CROSS JOIN (SELECT max(t) AS now FROM {ev}) n""",
        {"every": 86400},
    ),
    "outbox": Op(
        """SELECT o.k, count(*) AS orders, TOTAL(CASE WHEN b.seq IS NULL THEN 1 ELSE 0 END) AS unpublished FROM (SELECT k, seq FROM {ev} WHERE kind = 'purchase') o
           LEFT JOIN (SELECT k, seq FROM {ev} WHERE kind = 'purchase' AND v % 4 <> 0) b ON o.k = b.k AND o.seq = b.seq GROUP BY o.k""",
        {},
        "SELECT k, count(*) AS orders, count(*) FILTER (v % 4 = 0) AS unpublished FROM {ev} WHERE kind = 'purchase' GROUP BY k",
    ),
    "replay": Op("SELECT k, INT(t / {window}e0) * {window} AS window_start, TOTAL(v) AS total, 'reprocessed' AS provenance FROM {ev} GROUP BY 1, 2", {"window": 86400}),
    "replayspeed": Op(
        """SELECT k, max(t) - min(t) AS naive, CAST(ceil(count(*) / {rate}e0) AS BIGINT) AS accelerated, round((max(t) - min(t)) / ceil(count(*) / {rate}e0), 4) AS speedup FROM {ev} GROUP BY k""",
        {"rate": 5},
    ),
    "retention": Op(
        """SELECT k, margin, CASE WHEN margin <= 0 THEN 'gap' WHEN margin * 10 <= {span} THEN 'critical' WHEN margin * 3 <= {span} THEN 'tightening' ELSE 'comfortable' END AS state
           FROM (SELECT k, {span} - ((SELECT max(t) FROM {ev}) - max(t)) AS margin FROM {ev} GROUP BY k) x""",
        {"span": 172800},
    ),
    "sinkcontract": Op(
        "SELECT k, item, min_by(v, seq) AS v, count(*) AS writes FROM (SELECT k, v % {ids} AS item, v, seq FROM {ev}) x GROUP BY k, item",
        {"ids": 5},
        "SELECT k, item, v, writes FROM (SELECT k, v % {ids} AS item, v, count(*) OVER (PARTITION BY k, v % {ids}) AS writes, row_number() OVER (PARTITION BY k, v % {ids} ORDER BY seq) AS r FROM {ev}) x WHERE r = 1",
    ),
    "tieredlog": Op(
        """SELECT k, TOTAL(CASE WHEN seq >= b THEN 1 ELSE 0 END) AS hot_reads, TOTAL(CASE WHEN seq >= b THEN 1 ELSE 5 END) AS ticks FROM {ev}
           CROSS JOIN (SELECT least(max(seq) - {age}, min(p)) AS b FROM (SELECT k, max(seq) AS p, max(seq) AS seq FROM {ev} GROUP BY k) x) y GROUP BY k""",
        {"age": 300},
    ),
    # ---- filters, routing, sampling
    "adaptivesample": Op("SELECT kind, n, least(1e0, {target} / CAST(n AS DOUBLE)) AS p, least(1e0, {target} / CAST(n AS DOUBLE)) * n AS expected FROM (SELECT kind, count(*) AS n FROM {ev} GROUP BY kind) x", {"target": 100}),
    "branch": Op("SELECT branch, count(*) AS n, TOTAL(CASE WHEN overlap > 1 THEN 1 ELSE 0 END) AS overlapping FROM (SELECT CASE WHEN v >= 80 THEN 'large' WHEN kind = 'purchase' THEN 'paid' ELSE 'default' END AS branch, CAST(v >= 80 AS INT) + CAST(kind = 'purchase' AS INT) AS overlap FROM {ev}) x GROUP BY branch"),
    "canaryflow": Op(
        """SELECT kind, count(*) AS compared, round(avg(CASE WHEN o = n THEN 1e0 ELSE 0e0 END), 6) AS agreement, count(*) >= 10 AND avg(CASE WHEN o = n THEN 1e0 ELSE 0e0 END) >= 0.95 AS promote
           FROM (SELECT kind, v AS o, CASE WHEN v % 50 = 0 THEN v + 1 ELSE v END AS n FROM {ev} WHERE BUCKET(k, 100) < {percent}) x GROUP BY kind""",
        {"percent": 30},
    ),
    "dropshed": Op(
        """SELECT tick, tier, n, greatest(CAST(0 AS BIGINT), least(n, {capacity} - before)) AS kept FROM (SELECT tick, tier, n, CAST(coalesce(sum(n) OVER (PARTITION BY tick ORDER BY tier DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
           FROM (SELECT INT(t / 86400e0) AS tick, CASE WHEN kind = 'purchase' THEN 2 WHEN kind = 'signup' THEN 1 ELSE 0 END AS tier, count(*) AS n FROM {ev} GROUP BY 1, 2) x) y""",
        {"capacity": 20},
        """SELECT tick, tier, n, greatest(CAST(0 AS BIGINT), least(n, {capacity} - before)) AS kept FROM (SELECT tick, tier, n, CAST(coalesce(sum(n) OVER (PARTITION BY tick ORDER BY tier DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
           FROM (SELECT INT(t / 86400e0) AS tick, CASE WHEN kind = 'purchase' THEN 2 WHEN kind = 'signup' THEN 1 ELSE 0 END AS tier, count(*) AS n FROM {ev} GROUP BY 1, 2) x) y""",
    ),
    "eventlint": Op("SELECT event_type, count(*) AS n, TOTAL(CASE WHEN props IS NULL OR NOT props LIKE '%\"k\"%' THEN 1 ELSE 0 END) AS missing_key, TOTAL(CASE WHEN length(props) > 1024 THEN 1 ELSE 0 END) AS too_large, TOTAL(CASE WHEN props LIKE '%@%' OR props LIKE '%ssn:%' OR props LIKE '%card:%' THEN 1 ELSE 0 END) AS personal FROM {events} GROUP BY event_type"),
    "invariants": Op("SELECT day, quarantined, quarantined >= 3 AS escalate FROM (SELECT INT(t / 86400e0) AS day, TOTAL(CASE WHEN v BETWEEN 0 AND {most} THEN 0 ELSE 1 END) AS quarantined FROM {ev} GROUP BY 1) x", {"most": 95}),
    "loadshed": Op("SELECT kind, count(*) AS offered, TOTAL(CASE WHEN kind = 'purchase' OR BUCKET(seq, 100) < {keep} THEN 1 ELSE 0 END) AS admitted FROM {ev} GROUP BY kind", {"keep": 40}),
    "operators": Op("SELECT route, count(*) AS n, TOTAL(v2) AS total FROM (SELECT concat(kind, '-', TEXT(k % 4)) AS route, v * 2 AS v2 FROM {ev} WHERE v > 0) x GROUP BY route"),
    "sampler": Op("SELECT k, count(*) AS spans, max(CASE WHEN ok THEN 0 ELSE 1 END) = 1 AS kept_by_tail, BUCKET(k, 100) < {percent} AS kept_by_head FROM {ev} GROUP BY k", {"percent": 25}),
    "sampling": Op("SELECT k, kind, v FROM {ev} WHERE BUCKET(seq, 1000) < {permille}", {"permille": 100}),
    "shadowpipe": Op(
        """SELECT coalesce(a.w, b.w) AS w, CASE WHEN a.w IS NULL THEN 'new only' WHEN b.w IS NULL THEN 'old only' WHEN a.s = b.s THEN 'equal' ELSE 'differs' END AS verdict
           FROM (SELECT INT(t / 21600e0) AS w, TOTAL(v) AS s FROM {ev} WHERE v > 2 GROUP BY 1) a FULL OUTER JOIN (SELECT INT(t / 21600e0) AS w, TOTAL(v) AS s FROM {ev} WHERE k % 10 > 0 GROUP BY 1) b ON a.w = b.w"""
    ),
    "splitstream": Op("SELECT output, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, CASE kind WHEN 'purchase' THEN 'sales' WHEN 'signup' THEN 'growth' WHEN 'error' THEN 'alerts' ELSE 'rest' END AS output FROM {ev}) x GROUP BY output"),
}
