"""Clocks, partitioning, flow control, coordination and capacity models, as SQL over ``(k, seq, t, v, kind, ok)``."""

from loomery.operators.sqlop import SqlOperator as Op

_LATE = "(SELECT k, kind, seq, v, t AS e, t + (seq * 7919 % 97) * 600 AS a FROM {ev})"
_N = "(SELECT SERIES(CAST(1 AS BIGINT), CAST({n} AS BIGINT)) AS n)"
_NODES = "(SELECT SERIES(CAST(0 AS BIGINT), CAST({nodes} - 1 AS BIGINT)) AS node)"

CLOCKS = {
    "watermark": Op("SELECT k, TOTAL(CASE WHEN e <= mark - {bound} THEN 1 ELSE 0 END) AS late, max(e) - {bound} AS watermark FROM (SELECT k, e, max(e) OVER (PARTITION BY k ORDER BY a, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM " + _LATE + " x) y GROUP BY k", {"bound": 3600}),
    "multisource": Op("SELECT kind, top, top = low AS holds_back, low AS combined FROM (SELECT kind, top, min(top) OVER () AS low FROM (SELECT kind, max(t) AS top FROM {ev} GROUP BY kind) a) b"),
    "idletimeout": Op("SELECT TOTAL(CASE WHEN now - seen >= {idle} THEN 1 ELSE 0 END) AS idle_sources, min(CASE WHEN now - seen < {idle} THEN seen END) AS combined FROM (SELECT k, max(t) AS seen FROM {ev} GROUP BY k) a CROSS JOIN (SELECT max(t) AS now FROM {ev}) b", {"idle": 86400}),
    "punctuate": Op("SELECT kind, TOTAL(CASE WHEN e <= said THEN 1 ELSE 0 END) AS broken, count(*) AS n FROM (SELECT kind, e, max(CASE WHEN v > 90 THEN e END) OVER (PARTITION BY kind ORDER BY a, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM " + _LATE + " x) y GROUP BY kind"),
    "watermarkalign": Op("SELECT k, top - low AS drift, top - low > {most} AS paused FROM (SELECT k, max(t) AS top FROM {ev} GROUP BY k) a CROSS JOIN (SELECT min(top) AS low FROM (SELECT max(t) AS top FROM {ev} GROUP BY k) b) c", {"most": 172800}),
    "watermarkgen": Op("SELECT kind, min(d) AS least, max(CASE WHEN r = least(n, INT(n * {share}) + 1) THEN d END) AS margin FROM (SELECT kind, d, row_number() OVER (PARTITION BY kind ORDER BY d, seq) AS r, count(*) OVER (PARTITION BY kind) AS n FROM (SELECT kind, seq, a - e AS d FROM " + _LATE + " x) y) z GROUP BY kind", {"share": "9e-1"}),
    "watermarklag": Op("SELECT k, lag, CASE WHEN lag <= {sla} THEN 'fresh' WHEN lag - {bound} <= {sla} THEN 'bound' ELSE 'source' END AS blame FROM (SELECT k, (SELECT max(t) FROM {ev}) - max(t) + {bound} AS lag FROM {ev} GROUP BY k) x", {"sla": 86400, "bound": 3600}),
    "watermarkstall": Op("SELECT k, count(*) >= 3 AND max(e) - min(e) = 0 AS stalled, count(*) AS recent FROM (SELECT k, e, row_number() OVER (PARTITION BY k ORDER BY a DESC, seq) AS back FROM " + _LATE + " x) y WHERE back <= 3 GROUP BY k"),
    "clockdrift": Op("SELECT e.k AS k, min(drift) AS drift, min(t - drift) AS first_corrected, max(t - drift) AS last_corrected FROM {ev} e JOIN (SELECT k, max_by(v, seq) - 50 AS drift FROM {ev} WHERE kind = 'signup' GROUP BY k) d ON e.k = d.k GROUP BY e.k"),
    "freshness": Op("SELECT kind, spent, allowed, spent > allowed AS over_spent FROM (SELECT kind, round(avg(v), 6) AS spent, CAST({slo} * 0.9e0 / 5 AS DOUBLE) AS allowed FROM {ev} GROUP BY kind) x", {"slo": 280}),
    "catchup": Op("SELECT share, CAST(ceil({backlog} / (share * {capacity} / 100e0)) AS BIGINT) AS ticks, greatest(0e0, {rate} - (100 - share) * {capacity} / 100e0) AS live_lag_growth FROM (SELECT n * 25 AS share FROM " + _N + " x) y", {"n": 3, "backlog": 12000, "capacity": 200, "rate": 120}),
    "lagscale": Op("SELECT k, n * {move} AS lag_added, drained, drained > n * {move} AS scale_up FROM (SELECT k, count(*) AS n, TOTAL(CASE WHEN ok THEN 1 ELSE 0 END) * {horizon} AS drained FROM {ev} GROUP BY k) x", {"move": 10, "horizon": 12}),
    # Timers fire at the exact delay: slot and full revolutions of a wheel.
    "timingwheel": Op("SELECT k, seq, (v + seq) % {slots} AS slot, INT((v - 1) / {slots}e0) AS revolutions, seq + v AS fires FROM {ev} WHERE v > 0", {"slots": 16}),
    "virtualtime": Op("SELECT instant, LIST(seq) AS callbacks FROM (SELECT INT(t / 3600e0) * 3600 AS instant, seq FROM {ev}) x GROUP BY instant"),
    "asyncorder": Op("SELECT k, max(held) AS peak FROM (SELECT k, count(*) OVER (PARTITION BY k ORDER BY a, seq) - max(rank_in) OVER (PARTITION BY k ORDER BY a, seq) AS behind, max(rank_in) OVER (PARTITION BY k ORDER BY a, seq) - count(*) OVER (PARTITION BY k ORDER BY a, seq) AS held FROM (SELECT k, a, seq, row_number() OVER (PARTITION BY k ORDER BY e, seq) AS rank_in FROM " + _LATE + " x) y) z GROUP BY k"),
    "barrieralign": Op("SELECT k, max(e) - min(e) AS delay, TOTAL(CASE WHEN e < top THEN v ELSE 0 END) AS absorbed FROM (SELECT k, e, v, max(e) OVER (PARTITION BY k) AS top FROM (SELECT k, kind, max(t) AS e, TOTAL(v) AS v FROM {ev} GROUP BY k, kind) a) b GROUP BY k"),
    # The state at each barrier: running sums within blocks of barriers, after the sums of the blocks before.
    "checkpoint": Op(
        """WITH b AS (SELECT INT(seq / {every}e0) AS barrier, count(*) AS n, TOTAL(v) AS total FROM {ev} GROUP BY 1), c AS (SELECT INT(barrier / 1000e0) AS part, TOTAL(total) AS total FROM b GROUP BY 1),
           d AS (SELECT part, coalesce(sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c)
           SELECT b.barrier AS barrier, b.n AS n, CAST(d.base + sum(b.total) OVER (PARTITION BY d.part ORDER BY b.barrier) AS BIGINT) AS state FROM b JOIN d ON INT(b.barrier / 1000e0) = d.part""",
        {"every": 100},
        "SELECT barrier, count(*) AS n, CAST(sum(TOTAL(v)) OVER (ORDER BY barrier) AS BIGINT) AS state FROM (SELECT INT(seq / {every}e0) AS barrier, v FROM {ev}) x GROUP BY barrier",
    ),
    "checkpointinterval": Op("SELECT n, round({cost} / CAST(n AS DOUBLE) + n / (2e0 * {mtbf}), 8) AS waste, round(sqrt(2e0 * {cost} * {mtbf}), 6) AS optimum FROM " + _N + " x", {"n": 40, "cost": 5, "mtbf": 1000}),
    "idempotencykey": Op("SELECT kind, k, min_by(v, seq) AS result, count(*) - 1 AS retries FROM {ev} GROUP BY kind, k"),
    # Versions migrate one step at a time; each step doubles and adds its number.
    "savepoint": Op("SELECT version, count(*) AS states, TOTAL(CASE WHEN version = {expects} THEN v WHEN version = {expects} - 1 THEN v * 2 + version END) AS resumed, TOTAL(CASE WHEN version < {expects} - 1 THEN 1 ELSE 0 END) AS refused FROM (SELECT v % 3 + 1 AS version, v FROM {ev}) x GROUP BY version", {"expects": 3}),
    "speculative": Op("SELECT kind, TOTAL(CASE WHEN v > typical + {slack} THEN 1 ELSE 0 END) AS backups FROM (SELECT e.kind AS kind, v, typical FROM {ev} e JOIN (SELECT kind, median(v) AS typical FROM {ev} GROUP BY kind) m ON e.kind = m.kind) x GROUP BY kind", {"slack": 20}),
    "statebackend": Op("SELECT kind, keys * 64 AS bytes, CASE WHEN keys * 64 <= {budget} THEN 'memory' ELSE 'disk' END AS backend FROM (SELECT kind, count(DISTINCT k) AS keys FROM {ev} GROUP BY kind) x", {"budget": 6400}),
}

PARTITIONS = {
    "partitions": Op("SELECT part, n, round(n * {n} / total, 6) AS balance, n * {n} > 1.5e0 * total AS skewed FROM (SELECT part, n, CAST(sum(n) OVER () AS DOUBLE) AS total FROM (SELECT BUCKET(k, {n}) AS part, count(*) AS n FROM {ev} GROUP BY 1) a) b", {"n": 8}),
    "content_hash": Op("SELECT k, substring(SHA(k), 1, 32) AS digest, BUCKET(k, 16) AS bucket FROM (SELECT DISTINCT k FROM {ev}) x"),
    "hashring": Op(
        """WITH ring AS (SELECT node, HASH(concat(TEXT(node), '#', TEXT(v))) AS pt FROM """ + _NODES + """ n CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST({vnodes} - 1 AS BIGINT)) AS v) r), ks AS (SELECT DISTINCT k, HASH(k) AS pt FROM {ev})
           SELECT ks.k AS k, coalesce(min_by(ring.node, ring.pt), (SELECT min_by(node, pt) FROM ring)) AS owner FROM ks LEFT JOIN ring ON ring.pt >= ks.pt GROUP BY ks.k""",
        {"nodes": 5, "vnodes": 20},
    ),
    "rendezvous": Op("SELECT k, node AS owner FROM (SELECT k, node, row_number() OVER (PARTITION BY k ORDER BY HASH(concat(TEXT(node), '|', TEXT(k))) DESC, node) AS r FROM (SELECT DISTINCT k FROM {ev}) a CROSS JOIN " + _NODES + " b) x WHERE r = 1", {"nodes": 5}),
    "weightedrendezvous": Op("SELECT k, node AS owner FROM (SELECT k, node, row_number() OVER (PARTITION BY k ORDER BY round((node + 1) / -ln((HASH(concat(TEXT(node), '|', TEXT(k))) + 1) / 4294967297e0), 9) DESC, node) AS r FROM (SELECT DISTINCT k FROM {ev}) a CROSS JOIN " + _NODES + " b) x WHERE r = 1", {"nodes": 5}),
    "keygroups": Op("SELECT g, least({after} - 1, INT(g * {after} / {groups}e0)) AS owner, least({before} - 1, INT(g * {before} / {groups}e0)) <> least({after} - 1, INT(g * {after} / {groups}e0)) AS moved FROM (SELECT n - 1 AS g FROM (SELECT SERIES(CAST(1 AS BIGINT), CAST({groups} AS BIGINT)) AS n) x) y", {"groups": 128, "before": 4, "after": 5}),
    "rescale": Op(
        """SELECT count(*) AS keys, TOTAL(CASE WHEN BUCKET(concat('user-', TEXT(n)), {before}) <> BUCKET(concat('user-', TEXT(n)), {after}) THEN 1 ELSE 0 END) AS modulo_moved,
           TOTAL(CASE WHEN INT(BUCKET(concat('user-', TEXT(n)), 128) * {before} / 128e0) <> INT(BUCKET(concat('user-', TEXT(n)), 128) * {after} / 128e0) THEN 1 ELSE 0 END) AS range_moved FROM (SELECT n - 1 AS n FROM """ + _N + " x) y",
        {"n": 500, "before": 4, "after": 5},
    ),
    "saltedpartition": Op("SELECT part, count(*) AS n FROM (SELECT CASE WHEN kind = 'view' THEN BUCKET(concat(kind, '#', TEXT(seq % {salt})), 16) ELSE BUCKET(kind, 16) END AS part FROM {ev}) x GROUP BY part", {"salt": 6}),
    "shuffle": Op("SELECT owner, TOTAL(CASE WHEN owner <> producer THEN 1 ELSE 0 END) AS crossing, TOTAL(CASE WHEN owner = producer THEN 1 ELSE 0 END) AS local FROM (SELECT BUCKET(k, {nodes}) AS owner, seq % {nodes} AS producer FROM {ev}) x GROUP BY owner", {"nodes": 4}),
    "fanout": Op("SELECT kind, top - p AS behind, p = low AS pins FROM (SELECT kind, p, max(p) OVER () AS top, min(p) OVER () AS low FROM (SELECT kind, max(seq) AS p FROM {ev} GROUP BY kind) a) b"),
    "fusion": Op("SELECT k, count(*) AS groups, TOTAL(n) - count(*) AS hops_removed FROM (SELECT k, g, count(*) AS n FROM (SELECT k, CAST(sum(CASE WHEN fuse AND before THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS g FROM (SELECT k, seq, kind IN ('view', 'click') AS fuse, coalesce(lag(kind IN ('view', 'click')) OVER (PARTITION BY k ORDER BY seq), FALSE) AS before FROM {ev}) a) b GROUP BY k, g) c GROUP BY k"),
    "pauseresume": Op("SELECT k, max(gap) AS longest_pause, TOTAL(CASE WHEN gap > {window} THEN 1 ELSE 0 END) AS overdue FROM (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY seq) AS gap FROM {ev}) x GROUP BY k", {"window": 86400}),
    "rollback": Op("SELECT k, max(CASE WHEN seq < {deploy} THEN seq END) AS savepoint, TOTAL(CASE WHEN seq BETWEEN {deploy} AND {detected} THEN 1 ELSE 0 END) AS poisoned, TOTAL(CASE WHEN seq >= {deploy} THEN 1 ELSE 0 END) AS replayed FROM {ev} GROUP BY k", {"deploy": "(SELECT CAST(floor(max(seq) * 4e-1) AS BIGINT) FROM {ev})", "detected": "(SELECT CAST(floor(max(seq) * 7e-1) AS BIGINT) FROM {ev})"}),
}

FLOW = {
    "backoff": Op("SELECT n, least({cap}, CAST({base} * power({factor}, n) AS BIGINT)) AS delay, INT(least({cap}, {base} * power({factor}, n)) * BUCKET(n, 1000) / 1000e0) AS full_jitter, INT(least({cap}, {base} * power({factor}, n)) / 2e0 * (1 + BUCKET(n, 1000) / 1000e0)) AS equal_jitter FROM " + _N + " x", {"n": 12, "cap": 5000, "base": 10, "factor": 2}),
    "hedged": Op("SELECT kind, max(least(v, CASE WHEN v > {delay} THEN {delay} + {backup} ELSE v END)) AS worst, max(CASE WHEN r = n99 THEN s END) AS p99 FROM (SELECT kind, v, s, row_number() OVER (PARTITION BY kind ORDER BY s, seq) AS r, INT(99 * count(*) OVER (PARTITION BY kind) / 100e0) AS n99 FROM (SELECT kind, seq, v, least(v, CASE WHEN v > {delay} THEN {delay} + {backup} ELSE v END) AS s FROM {ev}) a) b GROUP BY kind", {"delay": 70, "backup": 15}),
    "jitterbuffer": Op("SELECT k, TOTAL(CASE WHEN arrive <= i * {interval} + {delay} THEN 1 ELSE 0 END) AS played, count(*) AS n FROM (SELECT k, i, i * {interval} + v * 3 AS arrive FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM {ev}) a) b GROUP BY k", {"interval": 20, "delay": 150}),
    "ratebreaker": Op("SELECT k, max(CASE WHEN n >= 5 AND share > {limit} THEN 1 ELSE 0 END) = 1 AS tripped, round(max(share), 6) AS worst FROM (SELECT k, count(*) OVER w AS n, avg(CASE WHEN ok THEN 0e0 ELSE 1e0 END) OVER w AS share FROM {ev} WINDOW w AS (PARTITION BY k ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) x GROUP BY k", {"limit": "3e-1"}),
    "ringbuffer": Op("SELECT k, LIST(seq) AS kept FROM (SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS back FROM {ev}) x WHERE back <= {capacity} GROUP BY k", {"capacity": 4}),
    "slidingwindowrate": Op("SELECT k, TOTAL(CASE WHEN r <= {limit} THEN 1 ELSE 0 END) AS admitted, TOTAL(CASE WHEN r > {limit} THEN 1 ELSE 0 END) AS refused FROM (SELECT k, row_number() OVER (PARTITION BY k, INT(t / {window}e0) ORDER BY seq) AS r FROM {ev}) x GROUP BY k", {"limit": 2, "window": 86400}),
    "tenantquota": Op("SELECT k, TOTAL(v) AS used, min(CASE WHEN p * 100 >= {budget} * 50 THEN seq END) AS warned_at_50, min(CASE WHEN p * 100 >= {budget} * 95 THEN seq END) AS warned_at_95, greatest(CAST(0 AS BIGINT), TOTAL(v) - {budget}) AS overage FROM (SELECT k, v, seq, CAST(sum(v) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS p FROM {ev}) x GROUP BY k", {"budget": 2000}),
    # Load of a retry storm after each round, without and with a retry budget.
    "retrystorm": Op(
        """SELECT n AS round_no, aggregate(sequence(CAST(1 AS BIGINT), n), CAST({base} AS BIGINT), (s, i) -> {base} + CAST(floor(s * {fail}) AS BIGINT)) AS naive,
           aggregate(sequence(CAST(1 AS BIGINT), n), CAST({base} AS BIGINT), (s, i) -> {base} + least(CAST(floor(s * {fail}) AS BIGINT), CAST(floor({base} * {share}) AS BIGINT))) AS budgeted FROM """ + _N + " x",
        {"n": 10, "base": 1000, "fail": "8e-1", "share": "1e-1"},
        """SELECT n AS round_no, list_reduce(generate_series(1, n), lambda s, i: {base} + CAST(floor(s * {fail}) AS BIGINT), CAST({base} AS BIGINT)) AS naive,
           list_reduce(generate_series(1, n), lambda s, i: {base} + least(CAST(floor(s * {fail}) AS BIGINT), CAST(floor({base} * {share}) AS BIGINT)), CAST({base} AS BIGINT)) AS budgeted FROM """ + _N + " x",
    ),
    # Smooth weighted round robin over three servers: the pick of each turn.
    "smoothwrr": Op(
        """SELECT n AS turn, (aggregate(sequence(CAST(1 AS BIGINT), n), named_struct('a', CAST(0 AS BIGINT), 'b', CAST(0 AS BIGINT), 'c', CAST(0 AS BIGINT), 'p', 'x'), (s, i) -> CASE WHEN s.a + {wa} >= s.b + {wb} AND s.a + {wa} >= s.c + {wc} THEN named_struct('a', s.a - {wb} - {wc}, 'b', s.b + {wb}, 'c', s.c + {wc}, 'p', 'a') WHEN s.b + {wb} >= s.c + {wc} THEN named_struct('a', s.a + {wa}, 'b', s.b - {wa} - {wc}, 'c', s.c + {wc}, 'p', 'b') ELSE named_struct('a', s.a + {wa}, 'b', s.b + {wb}, 'c', s.c - {wa} - {wb}, 'p', 'c') END)).p AS picked FROM """ + _N + " x",
        {"n": 24, "wa": 5, "wb": 2, "wc": 1},
        """SELECT n AS turn, (list_reduce(generate_series(1, n), lambda s, i: CASE WHEN s.a + {wa} >= s.b + {wb} AND s.a + {wa} >= s.c + {wc} THEN {'a': s.a - {wb} - {wc}, 'b': s.b + {wb}, 'c': s.c + {wc}, 'p': 'a'} WHEN s.b + {wb} >= s.c + {wc} THEN {'a': s.a + {wa}, 'b': s.b - {wa} - {wc}, 'c': s.c + {wc}, 'p': 'b'} ELSE {'a': s.a + {wa}, 'b': s.b + {wb}, 'c': s.c - {wa} - {wb}, 'p': 'c'} END, {'a': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT), 'p': 'x'})).p AS picked FROM """ + _N + " x",
    ),

}

COORDINATION = {
    "boundedstaleness": Op("SELECT k, top - own AS behind, top - own <= {lag} AS served FROM (SELECT k, max(seq) AS own, (SELECT max(seq) FROM {ev}) AS top FROM {ev} GROUP BY k) x", {"lag": 200}),
    "bully": Op("SELECT kind, max(CASE WHEN alive THEN k END) AS leader, count(*) AS nodes FROM (SELECT kind, k, max_by(ok, seq) AND max(v) > 30 AS alive FROM {ev} GROUP BY kind, k) x GROUP BY kind"),
    "mvcc": Op("SELECT k, max_by(CASE WHEN seq <= {snapshot} THEN v END, CASE WHEN seq <= {snapshot} THEN seq ELSE -1 END) AS seen, greatest(CAST(0 AS BIGINT), TOTAL(CASE WHEN seq <= {horizon} THEN 1 ELSE 0 END) - 1) AS collectable FROM {ev} GROUP BY k HAVING min(seq) <= {snapshot}", {"snapshot": "(SELECT CAST(floor(max(seq) * 6e-1) AS BIGINT) FROM {ev})", "horizon": "(SELECT CAST(floor(max(seq) * 3e-1) AS BIGINT) FROM {ev})"}),
    # Tail of the normal distribution by a rational approximation (absolute error below 2e-7), at least 1e-12.
    "phiaccrual": Op(
        """SELECT k, round(z, 6) AS z, round(-log10(greatest(1e-12, CASE WHEN z >= 0 THEN q ELSE 1 - q END)), 5) AS phi, -log10(greatest(1e-12, CASE WHEN z >= 0 THEN q ELSE 1 - q END)) > {threshold} AS suspect FROM (SELECT k, z, 5e-1 * w * (0.254829592e0 + w * (-0.284496736e0 + w * (1.421413741e0 + w * (-1.453152027e0 + w * 1.061405429e0)))) * exp(-z * z / 2) AS q FROM
           (SELECT k, z, 1 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0)) AS w FROM (SELECT k, ((SELECT max(t) FROM {ev}) - max(t) - avg(gap)) / greatest(stddev_pop(gap), 1e0) AS z FROM (SELECT k, t, t - lag(t) OVER (PARTITION BY k ORDER BY seq) AS gap FROM {ev}) x GROUP BY k HAVING count(gap) > 1) y) v) u""",
        {"threshold": 3},
    ),
    "quorumwrite": Op("SELECT k, max(CASE WHEN r = {w} THEN v END) AS latency, {r} + {w} > {n} AS overlaps FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v, seq) AS r FROM (SELECT k, v, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM {ev}) a WHERE i <= {n}) b GROUP BY k", {"n": 5, "w": 3, "r": 3}),
    "replicaselect": Op("SELECT kind, round(e, 5) AS estimate, e = min(e) OVER () AS picked FROM (SELECT x.kind AS kind, sum({a} * v * power(1 - {a}, n - i)) / (1 - power(1 - {a}, max(n))) AS e FROM (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY seq) AS i FROM {ev}) x JOIN (SELECT kind, count(*) AS n FROM {ev} GROUP BY kind) c ON x.kind = c.kind GROUP BY x.kind) y", {"a": "2e-1"}),
    "sessionguarantees": Op("SELECT k, TOTAL(CASE WHEN v < top THEN 1 ELSE 0 END) AS refused FROM (SELECT k, v, max(v) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {ev}) x GROUP BY k"),
    "twophase": Op("SELECT day, count(*) AS voters, min(CASE WHEN ok THEN 1 ELSE 0 END) = 1 AS commits FROM (SELECT INT(t / 86400e0) AS day, k, max_by(ok, seq) AS ok FROM {ev} GROUP BY 1, 2) x GROUP BY day"),
    "vectorclock": Op("SELECT a.k AS a, b.k AS b, CASE WHEN max(a.n - b.n) <= 0 AND min(a.n - b.n) = 0 AND max(a.n - b.n) = 0 THEN 'equal' WHEN max(a.n - b.n) <= 0 THEN 'before' WHEN min(a.n - b.n) >= 0 THEN 'after' ELSE 'concurrent' END AS verdict FROM (SELECT u.k AS k, w.kind AS kind, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT k FROM {ev}) u CROSS JOIN (SELECT DISTINCT kind FROM {ev}) w LEFT JOIN (SELECT k, kind, count(*) AS n FROM {ev} GROUP BY k, kind) c ON u.k = c.k AND w.kind = c.kind) a JOIN (SELECT u.k AS k, w.kind AS kind, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT k FROM {ev}) u CROSS JOIN (SELECT DISTINCT kind FROM {ev}) w LEFT JOIN (SELECT k, kind, count(*) AS n FROM {ev} GROUP BY k, kind) c ON u.k = c.k AND w.kind = c.kind) b ON a.kind = b.kind AND b.k = a.k + 1 GROUP BY a.k, b.k"),
}

MODELS = {
    "amdahl": Op("SELECT n AS cores, round(1 / ((1 - {p}) + {p} / n), 8) AS amdahl, round(1 / (1 - {p}), 8) AS ceiling, round((1 - {p}) + {p} * n, 8) AS gustafson FROM " + _N + " x", {"n": 64, "p": "9e-1"}),
    "littleslaw": Op("SELECT kind, rate, round(rate * {w}, 6) AS occupancy, round(n / rate, 6) AS delay FROM (SELECT kind, count(*) AS n, count(*) / 2592000e0 AS rate FROM {ev} GROUP BY kind) x", {"w": 600}),
    "pipelinethroughput": Op("SELECT min(n) AS throughput, min_by(kind, n) AS bottleneck, max(n) - min(n) AS slack FROM (SELECT kind, count(*) AS n FROM {ev} GROUP BY kind) x"),
    "queueing": Op("SELECT n AS percent, round((n / 100e0) / (1 - n / 100e0), 8) AS queue_length, round((n / 100e0) / (1 - n / 100e0) * {service}, 8) AS wait FROM " + _N + " x WHERE n < 100", {"n": 99, "service": 1}),
    "schedulability": Op("SELECT k, round(u, 6) AS utilisation, u <= 1 + 1e-9 AS edf, u <= n * (power(2e0, 1e0 / n) - 1) + 1e-9 AS rate_monotonic FROM (SELECT k, sum(v) / 5000e0 AS u, CAST(count(*) AS DOUBLE) AS n FROM {ev} GROUP BY k) x"),
    "usl": Op("SELECT n AS workers, round(n / (1 + {a} * (n - 1) + {b} * n * (n - 1)), 8) AS throughput, round(sqrt((1 - {a}) / {b}), 6) AS peak FROM " + _N + " x", {"n": 64, "a": "5e-2", "b": "1e-3"}),
}

GOVERNANCE = {
}

OPERATORS = CLOCKS | PARTITIONS | FLOW | COORDINATION | MODELS | GOVERNANCE
