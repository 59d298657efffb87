"""Plain definitions, for the second engine, of operators whose own statement would run on both.

Each is written another way than the operator: lists and correlated look-ups for
windows, enumeration for running sums, date functions for arithmetic on ticks.
"""

from __future__ import annotations

from loomery.suites.machines import DUCK_EVENTS

_EV = f"WITH ev AS ({DUCK_EVENTS}) "
_L = f"WITH ev AS ({DUCK_EVENTS}), l AS (SELECT k, list(v ORDER BY seq) AS xs, list(seq ORDER BY seq) AS qs FROM ev GROUP BY k) "
_R = f"WITH ev AS ({DUCK_EVENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM ev) "
_SPANS = f"WITH ev AS ({DUCK_EVENTS}), s AS (SELECT k, t AS a, t + (v + 1) * 600 AS b, seq FROM ev) "

PLAIN = {
    # ---- aggregates
    "aggregate": "SELECT event_type AS key, CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS window_start, CAST(sum(floor(value)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1, 2",
    "backfilltag": _EV + "SELECT k, period, xs[1] AS original, xs[-1] AS latest, CAST(len(xs) - 1 AS BIGINT) AS restatements FROM (SELECT k, t // 604800 AS period, list(v ORDER BY seq) AS xs FROM ev GROUP BY 1, 2) x",
    "decay": _EV + "SELECT k, round(sum(v * exp(-ln(2e0) * (top - t) / 86400e0)), 4) AS value FROM (SELECT k, v, t, max(t) OVER (PARTITION BY k) AS top FROM ev) x GROUP BY k",
    "gapfill": _EV + ", d AS (SELECT k, list(t // 86400) AS days FROM ev GROUP BY k) SELECT k, day, CAST(len(list_filter(days, lambda x: x = day)) AS BIGINT) AS n, NOT list_contains(days, day) AS filled FROM (SELECT k, days, unnest(generate_series(list_min(days), list_max(days))) AS day FROM d) y",
    "gaugestream": _EV + "SELECT kind, CASE WHEN kind IN ('click', 'view') THEN CAST(list_sum(xs) AS BIGINT) ELSE xs[-1] END AS reading FROM (SELECT kind, list(v ORDER BY seq) AS xs FROM ev GROUP BY kind) x",
    "keychurn": _EV + "SELECT t // 86400 AS w, count(DISTINCT k) AS users, count(DISTINCT k) FILTER (NOT EXISTS (SELECT 1 FROM ev p WHERE p.k = e.k AND p.t // 86400 < e.t // 86400)) AS novel FROM ev e GROUP BY 1",
    "localagg": _EV + "SELECT kind, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS largest, count(DISTINCT seq // 100) AS shipped, count(*) - count(DISTINCT seq // 100) AS saved FROM ev GROUP BY kind",
    "onlineregression": _EV + "SELECT k, round(b, 8) AS slope, round(my - b * mx, 6) AS intercept FROM (SELECT k, covar_pop(v, seq) / var_pop(seq) AS b, avg(v) AS my, avg(seq) AS mx FROM ev GROUP BY k HAVING count(*) > 1) x",
    "outlier": _EV + "SELECT k, seq, v FROM (SELECT e.k, e.seq, e.v, d.m, quantile_cont(abs(f.v - d.m), 0.5) AS mad FROM ev e JOIN (SELECT k, quantile_cont(v, 0.5) AS m FROM ev GROUP BY k) d ON d.k = e.k JOIN ev f ON f.k = e.k GROUP BY ALL) x WHERE mad > 0 AND 0.6745e0 * abs(v - m) / mad > 1.2",
    "readmodel": _L + ", m AS (SELECT max(seq) AS top FROM ev) SELECT k, CAST(list_sum(xs) AS BIGINT) AS balance, qs[-1] AS applied, top - qs[-1] AS staleness, CAST(len(list_filter(generate_series(2, len(qs)), lambda i: qs[i] - qs[i - 1] > 100)) AS BIGINT) AS gaps FROM l CROSS JOIN m",
    "retraction": _EV + "SELECT e.k, CAST(sum(CASE WHEN ok THEN v ELSE -v END) AS BIGINT) AS total, any_value(b.largest) AS largest FROM ev e LEFT JOIN (SELECT k, max(v) AS largest FROM (SELECT k, v FROM ev GROUP BY k, v HAVING count(*) FILTER (ok) > count(*) FILTER (NOT ok)) x GROUP BY k) b ON b.k = e.k GROUP BY e.k",
    "subarraysum": _R + "SELECT k, count(*) AS runs FROM (SELECT a.k, a.i, b.i AS j, sum(c.v) AS total FROM r a JOIN r b ON a.k = b.k AND b.i >= a.i JOIN r c ON c.k = a.k AND c.i BETWEEN a.i AND b.i GROUP BY 1, 2, 3) x WHERE total = 100 GROUP BY k",
    "weightedmedian": _EV + "SELECT a.k, min(a.v) AS median FROM (SELECT DISTINCT k, v FROM ev) a WHERE 2 * (SELECT sum(seq) FROM ev b WHERE b.k = a.k AND b.v <= a.v) >= (SELECT sum(seq) FROM ev b WHERE b.k = a.k) GROUP BY a.k",
    "welford": _EV + "SELECT k, round(sum(v) / CAST(count(*) AS DOUBLE), 6) AS mean, round(sum(v * v) / CAST(count(*) AS DOUBLE) - power(sum(v) / CAST(count(*) AS DOUBLE), 2), 5) AS variance, count(*) AS n FROM ev GROUP BY k",
    "latencyhistogram": _EV + "SELECT e.kind, b.top AS bucket, count(*) AS n FROM ev e JOIN (VALUES (-1, 1), (1, 10), (10, 100), (100, 1000), (1000, 100000)) b(low, top) ON (e.v > b.low OR b.low = -1) AND (e.v <= b.top OR b.top = 100000) GROUP BY 1, 2",
    "metricstream": _EV + "SELECT k, s[CAST(greatest(1, ceil(len(s) * 0.9e0)) AS INT)] AS p90, s[-1] AS worst FROM (SELECT k, list_sort(list(v ORDER BY seq DESC)[:20]) AS s FROM ev GROUP BY k) x",
    "reservoir": _EV + "SELECT kind, unnest(list(seq ORDER BY sha256(CAST(seq AS VARCHAR))[1:8], seq)[:20]) AS seq FROM ev GROUP BY kind",
    "windows": "SELECT user_id AS k, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) AS window_start, CAST(epoch(CAST(ts AS DATE) + INTERVAL 1 DAY) AS BIGINT) AS window_end, count(*) AS n FROM events GROUP BY ALL",
    "windows_sliding": _EV + ", w AS (SELECT unnest(generate_series((SELECT min(t) // 21600 - 4 FROM ev), (SELECT max(t) // 21600 FROM ev))) * 21600 AS window_start) SELECT window_start, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM w JOIN ev ON t >= window_start AND t < window_start + 86400 GROUP BY 1",
    "hoppingwindow": _EV + ", w AS (SELECT unnest(generate_series((SELECT min(t) // 43200 - 4 FROM ev), (SELECT max(t) // 43200 FROM ev))) * 43200 AS window_start) SELECT kind, window_start, count(*) AS n, CAST(3 AS BIGINT) AS overlap FROM w JOIN ev ON t >= window_start AND t < window_start + 100000 GROUP BY 1, 2",
    # A session starts where no event of the user lies within the gap before, and lasts to the next start.
    "windows_session": _EV + """, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, seq) AS i FROM ev), h AS (SELECT a.k, a.i, lead(a.i) OVER (PARTITION BY a.k ORDER BY a.i) AS upto FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.k = a.k AND b.i < a.i AND a.t - b.t <= 43200))
        SELECT o.k, min(t) AS session_start, max(t) + 43200 AS session_end, count(*) AS n FROM h JOIN o ON o.k = h.k AND o.i >= h.i AND (h.upto IS NULL OR o.i < h.upto) GROUP BY o.k, h.i""",
    "diffarray": _EV + ", u AS (SELECT k, min(t // 86400) AS lo, max(t // 86400) AS hi FROM ev GROUP BY k), d AS (SELECT lo AS day FROM u UNION SELECT hi + 1 FROM u) SELECT day, (SELECT count(*) FROM u WHERE day BETWEEN lo AND hi) AS active FROM d",
    "emitpolicy": _L + "SELECT k, CAST(1 + len(list_filter(generate_series(2, len(xs)), lambda i: xs[i] <> xs[i - 1])) AS BIGINT) AS on_change, CAST(len(list_filter(generate_series(2, len(xs)), lambda i: (xs[i] >= 50) <> (xs[i - 1] >= 50))) AS BIGINT) AS on_crossing FROM l",
    "kadane": _L + "SELECT k, list_reduce(xs, lambda s, x: {'run': greatest(s.run, 0) + x - 50, 'best': greatest(s.best, greatest(s.run, 0) + x - 50)}, {'run': CAST(0 AS BIGINT), 'best': CAST(-1000000 AS BIGINT)}).best AS best FROM l",
    "longestunique": _L + "SELECT k, CAST(list_reduce(xs, lambda s, x: {'run': list_append(s.run[coalesce(list_position(s.run, x), 0) + 1:], x), 'best': greatest(s.best, len(s.run) - coalesce(list_position(s.run, x), 0) + 1)}, {'run': CAST([] AS BIGINT[]), 'best': CAST(0 AS BIGINT)}).best AS BIGINT) AS longest FROM l",
    "prefixsum": _L + "SELECT k, CAST(list_sum(xs[6:15]) AS BIGINT) AS range_sum, CAST(list_sum(xs) AS BIGINT) AS total FROM l",
    "prefixsum2d": _EV + "SELECT a.r, b.c, CAST(sum(v) AS BIGINT) AS p FROM (SELECT DISTINCT k % 8 AS r FROM ev) a CROSS JOIN (SELECT DISTINCT seq % 8 AS c FROM ev) b JOIN ev ON k % 8 <= r AND seq % 8 <= c GROUP BY 1, 2",
    "rainwater": _L + "SELECT k, CAST(list_sum(list_transform(generate_series(1, len(xs)), lambda i: least(list_max(xs[:i]), list_max(xs[i:])) - xs[i])) AS BIGINT) AS water FROM l",
    "slidingcount": _R + "SELECT a.k, a.seq, CAST(sum(b.v) AS BIGINT) AS total, count(*) AS n, round(sum(b.v) / CAST(count(*) AS DOUBLE), 6) AS mean FROM r a JOIN r b ON a.k = b.k AND b.i BETWEEN a.i - 9 AND a.i GROUP BY 1, 2",
    "slidingmax": _R + "SELECT a.k, a.seq, max(b.v) AS top FROM r a JOIN r b ON a.k = b.k AND b.i BETWEEN a.i - 9 AND a.i GROUP BY 1, 2",
    "coordcompress": _EV + "SELECT a.k, a.seq, count(DISTINCT b.v) AS rank FROM ev a LEFT JOIN ev b ON a.k = b.k AND b.v < a.v GROUP BY 1, 2",
    "countingsort": _EV + "SELECT a.v, any_value(a.n) AS n, (SELECT count(*) FROM ev b WHERE b.v <= a.v) AS ends FROM (SELECT v, count(*) AS n FROM ev GROUP BY v) a GROUP BY a.v",
    "heapsort": _EV + "SELECT a.k, a.seq, count(*) AS place FROM ev a JOIN ev b ON a.k = b.k AND (b.v < a.v OR (b.v = a.v AND b.seq <= a.seq)) GROUP BY 1, 2",
    "ordering": _EV + ", d AS (SELECT k, seq, t + (seq * 7919 % 97) * 3600 AS a FROM ev) SELECT x.k, count(*) FILTER (EXISTS (SELECT 1 FROM d y WHERE y.k = x.k AND (y.a < x.a OR (y.a = x.a AND y.seq < x.seq)) AND y.seq >= x.seq)) AS violations FROM d x GROUP BY x.k",
    "orderstat": _EV + "SELECT k, CAST(len(list_filter(s, lambda x: x <= 40)) AS BIGINT) AS rank, s[7] AS selected FROM (SELECT k, list_sort(list(v)) AS s FROM ev GROUP BY k) x",
    "quickselect": _EV + "SELECT kind, list_sort(list(v))[13] AS v FROM ev GROUP BY kind",
    "resequencer": _EV + "SELECT k, CAST(coalesce((SELECT min(g) - 1 FROM (SELECT unnest(generate_series(1, 31)) AS g) y WHERE NOT list_contains(s, g)), 30) AS BIGINT) AS contiguous, CAST(len(s) AS BIGINT) AS offered FROM (SELECT k, list(DISTINCT v % 30 + 1) AS s FROM ev GROUP BY k) x",
    "skewmeter": _EV + "SELECT k, s[CAST(ceil(len(s) * 0.9e0) AS INT)] AS p90, round(100 * len(list_filter(s, lambda d: d > 3000)) / CAST(len(s) AS DOUBLE), 4) AS refused_share FROM (SELECT k, list_sort(list((seq * 7919 % 97) * 60)) AS s FROM ev GROUP BY k) x",
    # Covered stretches between neighbouring ends; stretches that touch are one interval.
    "mergeintervals": _SPANS + "SELECT x.k, x.a, min(y.b) AS b FROM (SELECT DISTINCT k, a FROM s p WHERE NOT EXISTS (SELECT 1 FROM s q WHERE q.k = p.k AND q.a < p.a AND q.b >= p.a)) x JOIN (SELECT DISTINCT k, b FROM s p WHERE NOT EXISTS (SELECT 1 FROM s q WHERE q.k = p.k AND q.a <= p.b AND q.b > p.b)) y ON x.k = y.k AND y.b >= x.a GROUP BY 1, 2",
    "intervalset": _SPANS + ", e AS (SELECT k, a AS p FROM s UNION SELECT k, b FROM s), n AS (SELECT k, p, lead(p) OVER (PARTITION BY k ORDER BY p) AS q FROM e) SELECT k, CAST(sum(q - p) FILTER (EXISTS (SELECT 1 FROM s WHERE s.k = n.k AND s.a <= n.p AND s.b >= n.q)) AS BIGINT) AS covered FROM n GROUP BY k",
    "sweepline": _SPANS + "SELECT k, max(n) AS peak FROM (SELECT x.k, x.seq, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND y.a <= x.a AND y.b > x.a GROUP BY 1, 2) z GROUP BY k",
    "lwwregister": _L + "SELECT k, xs[-1] AS v, qs[-1] AS stamp, CAST(len(xs) - 1 AS BIGINT) AS discarded FROM l",
    "lwwset": _EV + "SELECT DISTINCT k, v % 10 AS item FROM ev a WHERE ok AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.k = a.k AND b.v % 10 = a.v % 10 AND NOT b.ok AND b.seq > (SELECT max(seq) FROM ev c WHERE c.k = a.k AND c.v % 10 = a.v % 10 AND c.ok))",
    "crdtset": _EV + "SELECT k FROM ev GROUP BY k HAVING bool_or(kind = 'signup') AND NOT bool_or(kind = 'error' AND v > 90)",
    # ---- logs and routing
    "backfillmerge": _EV + "SELECT k, count(*) AS n, count(*) FILTER (seq < (SELECT floor(max(seq) * 0.4) FROM ev)) AS backfilled, CAST(sum(v) AS BIGINT) AS total FROM ev GROUP BY k",
    "compaction": _EV + "SELECT k, v, seq, NOT ok AS dead FROM ev a WHERE seq = (SELECT max(seq) FROM ev b WHERE b.k = a.k) AND (ok OR (SELECT max(seq) FROM ev) - seq <= 50)",
    "coldstart": _EV + "SELECT k, count(*) AS earliest, count(*) FILTER (seq > (SELECT floor(max(seq) * 0.6) FROM ev)) AS snapshot_replay, CAST(0 AS BIGINT) AS latest FROM ev GROUP BY k",
    "events": _EV + ", d AS (SELECT k, list({'e': t, 'a': t + (seq * 7919 % 97) * 3600} ORDER BY t + (seq * 7919 % 97) * 3600, seq) AS x FROM ev GROUP BY k) SELECT k, CAST(len(list_filter(generate_series(2, len(x)), lambda i: x[i].e < x[i - 1].e)) AS BIGINT) AS disorder, list_max(list_transform(x, lambda y: y.a - y.e)) AS max_skew, CAST(len(x) AS BIGINT) AS n FROM d",
    "replay": "SELECT user_id AS k, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) AS window_start, CAST(sum(floor(value)) AS BIGINT) AS total, 'reprocessed' AS provenance FROM events GROUP BY ALL",
    "retention": _EV + ", m AS (SELECT k, 172800 - ((SELECT max(t) FROM ev) - max(t)) AS margin FROM ev GROUP BY k) SELECT k, margin, CASE WHEN margin <= 0 THEN 'gap' WHEN margin <= 17280 THEN 'critical' WHEN margin <= 57600 THEN 'tightening' ELSE 'comfortable' END AS state FROM m",
    # ---- clocks, flow and coordination
    "boundedstaleness": _EV + ", m AS (SELECT k, (SELECT count(*) FROM ev) AS n, max(seq) AS own FROM ev GROUP BY k) SELECT k, (SELECT max(own) FROM m) - own AS behind, (SELECT max(own) FROM m) - own <= 200 AS served FROM m",
    "ringbuffer": _EV + "SELECT k, list_sort(list(seq ORDER BY seq DESC)[:4]) AS kept FROM ev GROUP BY k",
    "slidingwindowrate": _EV + "SELECT k, CAST(sum(least(n, 2)) AS BIGINT) AS admitted, CAST(sum(greatest(n - 2, 0)) AS BIGINT) AS refused FROM (SELECT k, t // 86400 AS d, count(*) AS n FROM ev GROUP BY 1, 2) x GROUP BY k",
    "pauseresume": _EV + ", g AS (SELECT k, list(t ORDER BY seq) AS ts FROM ev GROUP BY k) SELECT k, list_max(list_transform(generate_series(2, len(ts)), lambda i: ts[i] - ts[i - 1])) AS longest_pause, CAST(len(list_filter(generate_series(2, len(ts)), lambda i: ts[i] - ts[i - 1] > 86400)) AS BIGINT) AS overdue FROM g",
    "sessionguarantees": _L + "SELECT k, CAST(len(list_filter(generate_series(2, len(xs)), lambda i: xs[i] < list_max(xs[:i - 1]))) AS BIGINT) AS refused FROM l",
    "idempotencykey": _EV + "SELECT kind, k, list(v ORDER BY seq)[1] AS result, count(*) - 1 AS retries FROM ev GROUP BY kind, k",
    "statebackend": _EV + "SELECT kind, count(*) * 64 AS bytes, CASE WHEN count(*) <= 100 THEN 'memory' ELSE 'disk' END AS backend FROM (SELECT DISTINCT kind, k FROM ev) x GROUP BY kind",
    "twophase": _EV + "SELECT day, count(*) AS voters, bool_and(vote) AS commits FROM (SELECT t // 86400 AS day, k, list(ok ORDER BY seq)[-1] AS vote FROM ev GROUP BY 1, 2) x GROUP BY day",
    "snowflake": _EV + "SELECT seq, ((t - 1704067200) * 1000 << 22) + (k % 1024 << 12) + (SELECT count(*) FROM ev b WHERE b.k % 1024 = a.k % 1024 AND b.t = a.t AND b.seq < a.seq) AS id FROM ev a",
    "bitmapindex": _EV + ", n AS (SELECT count(*) AS n FROM ev) SELECT kind, count(*) AS equals, count(*) FILTER (v & 1 = 0) AS both, any_value(n.n) - count(*) AS complement FROM ev CROSS JOIN n GROUP BY kind",
    "minqueue": _R + "SELECT a.k, a.seq, min(b.v) AS minimum FROM r a JOIN r b ON a.k = b.k AND b.i BETWEEN a.i - 6 AND a.i GROUP BY 1, 2",
    "dlq": _EV + "SELECT k, kind, CAST(len(q) AS BIGINT) AS attempts, len(q) > 2 AS dead_letter, q[1] AS first_seq FROM (SELECT k, kind, list(seq ORDER BY seq) AS q FROM ev WHERE kind = 'error' OR v < 20 GROUP BY 1, 2) x",
    "heartbeat": _EV + """, p AS (SELECT k, list_max(list_filter(list(CASE WHEN kind = 'view' THEN t END), lambda x: x IS NOT NULL)) AS pulse, list_max(list_filter(list(CASE WHEN kind <> 'view' THEN t END), lambda x: x IS NOT NULL)) AS other FROM ev GROUP BY k)
        SELECT k, CASE WHEN pulse IS NULL THEN 'never heard' WHEN pulse < (SELECT max(t) FROM ev) - 172800 THEN 'dead' WHEN other IS NULL OR other < pulse THEN 'quiet' ELSE 'live' END AS reading FROM p""",
    "replayspeed": _L + ", d AS (SELECT k, list_max(ts) - list_min(ts) AS naive, (len(ts) + 4) // 5 AS fast FROM (SELECT k, list(t) AS ts FROM ev GROUP BY k) x) SELECT k, naive, CAST(fast AS BIGINT) AS accelerated, round(naive / CAST(fast AS DOUBLE), 4) AS speedup FROM d",
    "tieredlog": _EV + ", b AS (SELECT least(max(last) - 300, min(last)) AS edge FROM (SELECT max(seq) AS last FROM ev GROUP BY k) x) SELECT k, count(*) FILTER (seq >= edge) AS hot_reads, count(*) FILTER (seq >= edge) + 5 * count(*) FILTER (seq < edge) AS ticks FROM ev CROSS JOIN b GROUP BY k",
    "adaptivesample": _EV + "SELECT kind, n, CASE WHEN n <= 100 THEN 1e0 ELSE 100 / CAST(n AS DOUBLE) END AS p, CASE WHEN n <= 100 THEN CAST(n AS DOUBLE) ELSE 100 / CAST(n AS DOUBLE) * n END AS expected FROM (SELECT kind, count(*) AS n FROM ev GROUP BY kind) x",
    "branch": _EV + "SELECT 'large' AS branch, count(*) AS n, count(*) FILTER (kind = 'purchase') AS overlapping FROM ev WHERE v >= 80 UNION ALL SELECT 'paid', count(*), 0 FROM ev WHERE v < 80 AND kind = 'purchase' UNION ALL SELECT 'default', count(*), 0 FROM ev WHERE v < 80 AND kind <> 'purchase'",
    "invariants": _EV + "SELECT d.day, (SELECT count(*) FROM ev WHERE t // 86400 = d.day AND (v < 0 OR v > 95)) AS quarantined, (SELECT count(*) FROM ev WHERE t // 86400 = d.day AND (v < 0 OR v > 95)) >= 3 AS escalate FROM (SELECT DISTINCT t // 86400 AS day FROM ev) d",
    "operators": _EV + "SELECT printf('%s-%d', kind, k % 4) AS route, count(*) AS n, CAST(2 * sum(v) AS BIGINT) AS total FROM ev WHERE NOT v = 0 GROUP BY kind, k % 4",
    "splitstream": _EV + "SELECT m.output, CAST(len(list(seq)) AS BIGINT) AS n, list_min(list(seq)) AS first_seq FROM ev JOIN (VALUES ('purchase', 'sales'), ('signup', 'growth'), ('error', 'alerts'), ('view', 'rest'), ('click', 'rest')) m(kind, output) ON m.kind = ev.kind GROUP BY 1",
    "shadowpipe": _EV + """SELECT w, CASE WHEN NOT bool_or(o) THEN 'new only' WHEN NOT bool_or(n) THEN 'old only' WHEN sum(CASE WHEN o THEN v ELSE 0 END) = sum(CASE WHEN n THEN u ELSE 0 END) THEN 'equal' ELSE 'differs' END AS verdict FROM (SELECT t // 21600 AS w, v, v AS u, v > 2 AS o, k % 10 > 0 AS n FROM ev) x WHERE o OR n GROUP BY w""",
    "multisource": _EV + ", m AS (SELECT kind, max(t) AS top FROM ev GROUP BY kind) SELECT a.kind, a.top, bool_and(a.top <= b.top) AS holds_back, min(b.top) AS combined FROM m a CROSS JOIN m b GROUP BY 1, 2",
    "idletimeout": _EV + "SELECT count(*) FILTER (top - seen >= 86400) AS idle_sources, min(seen) FILTER (top - seen < 86400) AS combined FROM (SELECT k, max(t) AS seen, (SELECT max(t) FROM ev) AS top FROM ev GROUP BY k) x",
    "watermarkalign": _EV + ", m AS (SELECT k, max(t) AS top FROM ev GROUP BY k) SELECT k, top - (SELECT min(top) FROM m) AS drift, top > (SELECT min(top) FROM m) + 172800 AS paused FROM m",
    "watermarklag": _EV + "SELECT k, d + 3600 AS lag, CASE WHEN d + 3600 <= 86400 THEN 'fresh' WHEN d <= 86400 THEN 'bound' ELSE 'source' END AS blame FROM (SELECT a.k, max(b.t) - max(a.t) AS d FROM (SELECT k, max(t) AS t FROM ev GROUP BY k) a CROSS JOIN (SELECT max(t) AS t FROM ev) b GROUP BY a.k) x",
    "clockdrift": _EV + ", d AS (SELECT k, list(v ORDER BY seq)[-1] - 50 AS drift FROM ev WHERE kind = 'signup' GROUP BY k) SELECT k, any_value(drift) AS drift, min(t) - any_value(drift) AS first_corrected, max(t) - any_value(drift) AS last_corrected FROM ev JOIN d USING (k) GROUP BY k",
    "lagscale": _EV + "SELECT k, 10 * count(*) AS lag_added, 12 * count(*) FILTER (ok) AS drained, 12 * count(*) FILTER (ok) > 10 * count(*) AS scale_up FROM ev GROUP BY k",
    "timingwheel": _EV + "SELECT k, seq, (seq + v) - (seq + v) // 16 * 16 AS slot, (v - 1) // 16 AS revolutions, seq + v AS fires FROM ev WHERE v <> 0",
    "virtualtime": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS instant, list(event_id ORDER BY event_id) AS callbacks FROM events GROUP BY 1",
    "barrieralign": _EV + ", p AS (SELECT k, kind, max(t) AS e, sum(v) AS v FROM ev GROUP BY 1, 2) SELECT a.k, max(a.e) - min(a.e) AS delay, CAST(coalesce(sum(a.v) FILTER (EXISTS (SELECT 1 FROM p b WHERE b.k = a.k AND b.e > a.e)), 0) AS BIGINT) AS absorbed FROM p a GROUP BY a.k",
    "speculative": _EV + ", m AS (SELECT kind, quantile_cont(v, 0.5) AS typical FROM ev GROUP BY kind) SELECT kind, count(*) FILTER (v - typical > 20) AS backups FROM ev JOIN m USING (kind) GROUP BY kind",
    "savepoint": _EV + "SELECT v % 3 + 1 AS version, count(*) AS states, CAST(sum(CASE v % 3 WHEN 2 THEN v WHEN 1 THEN 2 * v + 2 END) AS BIGINT) AS resumed, count(*) FILTER (v % 3 = 0) AS refused FROM ev GROUP BY 1",
    "fanout": _EV + ", m AS (SELECT kind, max(seq) AS p FROM ev GROUP BY kind) SELECT a.kind, max(b.p) - a.p AS behind, a.p = min(b.p) AS pins FROM m a CROSS JOIN m b GROUP BY a.kind, a.p",
    "fusion": _EV + ", l AS (SELECT k, list(kind IN ('view', 'click') ORDER BY seq) AS f FROM ev GROUP BY k) SELECT k, CAST(len(f) - len(list_filter(generate_series(2, len(f)), lambda i: f[i] AND f[i - 1])) AS BIGINT) AS groups, CAST(len(list_filter(generate_series(2, len(f)), lambda i: f[i] AND f[i - 1])) AS BIGINT) AS hops_removed FROM l",
    "jitterbuffer": _L + "SELECT k, CAST(len(list_filter(generate_series(1, len(xs)), lambda i: xs[i] * 3 <= 150)) AS BIGINT) AS played, CAST(len(xs) AS BIGINT) AS n FROM l",
    "tenantquota": _R + ", p AS (SELECT a.k, a.seq, sum(b.v) AS p FROM r a JOIN r b ON a.k = b.k AND b.i <= a.i GROUP BY 1, 2) SELECT k, CAST(max(p) AS BIGINT) AS used, min(seq) FILTER (p >= 1000) AS warned_at_50, min(seq) FILTER (p >= 1900) AS warned_at_95, CAST(greatest(0, max(p) - 2000) AS BIGINT) AS overage FROM p GROUP BY k",
    "ratebreaker": _R + ", w AS (SELECT a.k, a.i, count(*) AS n, count(*) FILTER (NOT b.ok) / CAST(count(*) AS DOUBLE) AS share FROM r a JOIN r b ON a.k = b.k AND b.i BETWEEN a.i - 9 AND a.i GROUP BY 1, 2) SELECT k, bool_or(n >= 5 AND share > 0.3e0) AS tripped, round(max(share), 6) AS worst FROM w GROUP BY k",
    "bully": _EV + ", a AS (SELECT kind, k, list(ok ORDER BY seq)[-1] AND list_max(list(v)) > 30 AS alive FROM ev GROUP BY 1, 2) SELECT kind, max(k) FILTER (alive) AS leader, count(*) AS nodes FROM a GROUP BY kind",
    "quorumwrite": _L + "SELECT k, list_sort(xs[:5])[3] AS latency, 3 + 3 > 5 AS overlaps FROM l",
    "replicaselect": _EV + ", l AS (SELECT kind, list(CAST(v AS DOUBLE) ORDER BY seq) AS xs FROM ev GROUP BY kind), e AS (SELECT kind, list_reduce(xs, lambda s, x: 0.8e0 * s + 0.2e0 * x, 0e0) / (1 - pow(0.8e0, len(xs))) AS e FROM l) SELECT kind, round(e, 5) AS estimate, e = (SELECT min(e) FROM e) AS picked FROM e",
    "ewma": _EV + ", l AS (SELECT k, list(CAST(v AS DOUBLE) ORDER BY seq) AS xs FROM ev GROUP BY k), e AS (SELECT k, len(xs) AS n, list_reduce(xs, lambda s, x: 0.7e0 * s + 0.3e0 * x, 0e0) AS raw FROM l) SELECT k, round(raw, 5) AS raw, round(raw / (1 - pow(0.7e0, n)), 5) AS corrected FROM e",
    "pipelinethroughput": _EV + ", m AS (SELECT kind, count(*) AS n FROM ev GROUP BY kind) SELECT n AS throughput, kind AS bottleneck, (SELECT max(n) FROM m) - n AS slack FROM m ORDER BY n, kind LIMIT 1",
    "amdahl": "SELECT n AS cores, round(n / (n * 0.1e0 + 0.9e0), 8) AS amdahl, CAST(10 AS DOUBLE) AS ceiling, round(n - 0.1e0 * (n - 1), 8) AS gustafson FROM (SELECT unnest(generate_series(1, 64)) AS n) x",
    "queueing": "SELECT n AS percent, round(n / CAST(100 - n AS DOUBLE), 8) AS queue_length, round(n / CAST(100 - n AS DOUBLE), 8) AS wait FROM (SELECT unnest(generate_series(1, 99)) AS n) x",
    "simpson": "SELECT n AS degree, round(1 / CAST(n + 1 AS DOUBLE), 7) AS integral FROM (SELECT unnest(generate_series(1, 6)) AS n) x",
    "horspool": "SELECT item_id, CAST(strpos(text, 'on') AS BIGINT) AS first_hit FROM benchmark WHERE contains(text, 'on')",
    "rabinkarp": "SELECT item_id, CAST(len(string_split(text, 'in')) - 1 AS BIGINT) AS hits FROM benchmark WHERE text IS NOT NULL",
    "zalgo": "SELECT item_id, list_max(h) AS last_hit, CAST(len(h) AS BIGINT) AS hits FROM (SELECT item_id, list_filter(generate_series(2, length(text)), lambda i: starts_with(text[i:], text[:2])) AS h FROM benchmark) x WHERE len(h) > 0",
    "ahocorasick": "SELECT item_id, p AS pattern, CAST(len(regexp_extract_all(text, p)) AS BIGINT) AS hits FROM benchmark CROSS JOIN (VALUES ('the'), ('er'), ('on'), ('he')) q(p) WHERE contains(text, p)",
    "booth": "SELECT s, list_min(list_transform(generate_series(1, length(s)), lambda i: substr(concat(s, s), i, length(s)))) AS least_rotation FROM (SELECT DISTINCT p_brand AS s FROM part) x",
    "deltaencode": _EV + ", l AS (SELECT k, list(t ORDER BY t, seq) AS ts FROM ev GROUP BY k) SELECT k, CAST(len(ts) AS BIGINT) AS n, CAST(1 + coalesce(list_sum(list_transform(generate_series(2, len(ts)), lambda i: greatest(1, (length(bin(ts[i] - ts[i - 1])) + 6) // 7))), 0) AS BIGINT) AS encoded_bytes, CAST(len(ts) * 8 AS BIGINT) AS raw_bytes FROM l",
    "gray": "SELECT n, CAST(list_sum(list_transform(generate_series(0, 8), lambda b: CASE WHEN (n >> b) & 1 <> (n >> (b + 1)) & 1 THEN 1 << b ELSE 0 END)) AS BIGINT) AS code FROM (SELECT unnest(generate_series(1, 256)) AS n) x",
    # A run starts where the kind before is another, and lasts to the next start.
    "rle": _R + ", h AS (SELECT a.k, a.kind, a.i, a.seq, lead(a.i) OVER (PARTITION BY a.k ORDER BY a.i) AS upto FROM r a LEFT JOIN r b ON a.k = b.k AND b.i = a.i - 1 WHERE b.kind IS DISTINCT FROM a.kind) SELECT k, kind, coalesce(upto, (SELECT max(i) + 1 FROM r WHERE r.k = h.k)) - i AS run_length, seq AS starts FROM h",
    "twostackqueue": _EV + ", q AS (SELECT k, list(v ORDER BY seq) FILTER (kind <> 'purchase') AS ins, list(seq ORDER BY seq) FILTER (kind = 'purchase') AS outs FROM ev GROUP BY k) SELECT k, ins[i] AS dequeued, outs[i] AS taken_at FROM (SELECT *, unnest(generate_series(1, least(len(ins), len(outs)))) AS i FROM q WHERE ins IS NOT NULL AND outs IS NOT NULL) x",
    "coinchange": """WITH RECURSIVE ways(amount, coins) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT amount + c, coins + 1 FROM ways CROSS JOIN (VALUES (3), (5), (7)) d(c) WHERE amount + c <= 90)
        SELECT n AS amount, coalesce(min(coins), -1) AS coins FROM (SELECT unnest(generate_series(1, 90)) AS n) x LEFT JOIN ways ON amount = n GROUP BY n""",
    "content_hash": _EV + "SELECT DISTINCT k, left(sha256(CAST(k AS VARCHAR)), 32) AS digest, CAST(list_reduce(list_transform(string_split(left(sha256(CAST(k AS VARCHAR)), 8), ''), lambda h: CAST(strpos('0123456789abcdef', h) - 1 AS BIGINT)), lambda a, b: a * 16 + b) % 16 AS BIGINT) AS bucket FROM ev",
}
PLAIN = {name: text.replace(") , ", "), ") for name, text in PLAIN.items()}
