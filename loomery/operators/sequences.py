"""Event-time windows, row frames, ordering and interval sets, as SQL over ``(k, seq, t, v, kind, ok)``."""

from loomery.operators.sqlop import SqlOperator as Op

_RANKED = "(SELECT k, v, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM {ev})"
_PREFIX = "(SELECT k, seq, v, i, CAST(sum(w) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS p, w FROM (SELECT k, seq, v, v - 50 AS w, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM {ev}) r)"

WINDOWS = {
    "windows": Op("SELECT k, INT(t / {size}e0) * {size} AS window_start, INT(t / {size}e0) * {size} + {size} AS window_end, count(*) AS n FROM {ev} GROUP BY 1, 2", {"size": 86400}),
    # Starts are aligned to the slide and never before the first tick.
    "windows_sliding": Op(
        """SELECT w * {slide} AS window_start, count(*) AS n, TOTAL(v) AS total FROM (SELECT v, SERIES(greatest(CAST(0 AS BIGINT), INT((t - {size}) / {slide}e0) + 1), INT(t / {slide}e0)) AS w FROM {ev}) x GROUP BY w""",
        {"size": 86400, "slide": 21600},
    ),
    "hoppingwindow": Op(
        "SELECT kind, w * {hop} AS window_start, count(*) AS n, CAST(ceil({size}e0 / {hop}) AS BIGINT) AS overlap FROM (SELECT kind, SERIES(greatest(CAST(0 AS BIGINT), INT((t - {size}) / {hop}e0) + 1), INT(t / {hop}e0)) AS w FROM {ev}) x GROUP BY kind, w",
        {"size": 100000, "hop": 43200},
    ),
    # Sessions: a gap of at most {gap} continues; overlapping reach merges.
    "windows_session": Op(
        """SELECT k, min(t) AS session_start, max(t) + {gap} AS session_end, count(*) AS n FROM (SELECT k, t, CAST(sum(fresh) OVER (PARTITION BY k ORDER BY t, seq) AS BIGINT) AS s FROM
           (SELECT k, t, seq, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t, seq) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {ev}) a) b GROUP BY k, s""",
        {"gap": 43200},
    ),
    "sessionmerge": Op(
        """SELECT k, min(a) AS first_t, max(b) AS last_t, TOTAL(n) AS n FROM (SELECT k, a, b, n, CAST(sum(CASE WHEN a - reach <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a) AS BIGINT) AS s FROM (SELECT k, a, b, n, max(b) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM
           (SELECT k, INT(t / 86400e0) AS day, min(t) AS a, max(t) AS b, count(*) AS n FROM {ev} GROUP BY 1, 2) d) e) f GROUP BY k, s""",
        {"gap": 50000},
    ),
    "daywindows": Op(
        """SELECT d.label AS label, count(*) AS n, min(d.length) AS length FROM {ev} e JOIN (SELECT label, day_start, lead(day_start) OVER (ORDER BY day_start) AS day_end, lead(day_start) OVER (ORDER BY day_start) - day_start AS length FROM (SELECT i AS label, 1704067200 + i * 86400 + CASE WHEN i > 10 THEN 3600 ELSE 0 END AS day_start FROM
           (SELECT SERIES(CAST(0 AS BIGINT), CAST(40 AS BIGINT)) AS i) s) a) d ON e.t >= d.day_start AND e.t < d.day_end GROUP BY d.label"""
    ),
    "windowcost": Op("SELECT s AS slide, CAST(c AS BIGINT) AS live_panes, INT(2592000e0 / s) * {keys} AS firings, c * 64 AS state_bytes FROM (SELECT s, INT(86400e0 / s) * {keys} AS c FROM (SELECT i * 3600 AS s FROM (SELECT SERIES(CAST(1 AS BIGINT), CAST(24 AS BIGINT)) AS i) h) a) b", {"keys": 150}),
    "lateroom": Op(
        """SELECT CASE WHEN late <= 3600 THEN '1 short' WHEN late <= 36000 THEN '2 medium' ELSE '3 long' END AS bucket, count(*) AS n, count(DISTINCT w) AS windows, TOTAL(CASE WHEN late > {patience} THEN 1 ELSE 0 END) AS expired FROM
           (SELECT INT(e / 3600e0) AS w, mark - e AS late FROM (SELECT e, max(e) OVER (PARTITION BY kind ORDER BY a, seq) AS mark FROM (SELECT kind, seq, t AS e, t + (seq * 7919 % 97) * 600 AS a FROM {ev}) x) y WHERE e < mark) z GROUP BY 1""",
        {"patience": 30000},
    ),
}

FRAMES = {
    "diffarray": Op("SELECT day, CAST(sum(d) OVER (ORDER BY day) AS BIGINT) AS active FROM (SELECT day, TOTAL(d) AS d FROM (SELECT min(INT(t / 86400e0)) AS day, 1 AS d FROM {ev} GROUP BY k UNION ALL SELECT max(INT(t / 86400e0)) + 1 AS day, -1 AS d FROM {ev} GROUP BY k) a GROUP BY day) b"),
    "emitpolicy": Op("SELECT k, TOTAL(CASE WHEN p IS NULL OR v <> p THEN 1 ELSE 0 END) AS on_change, TOTAL(CASE WHEN (p < 50 AND v >= 50) OR (p >= 50 AND v < 50) THEN 1 ELSE 0 END) AS on_crossing FROM (SELECT k, v, lag(v) OVER (PARTITION BY k ORDER BY seq) AS p FROM {ev}) x GROUP BY k"),
    "ewma": Op("SELECT x.k AS k, round(sum({a} * v * power(1 - {a}, n - i)), 5) AS raw, round(sum({a} * v * power(1 - {a}, n - i)) / (1 - power(1 - {a}, max(n))), 5) AS corrected FROM " + _RANKED + " x JOIN (SELECT k, count(*) AS n FROM {ev} GROUP BY k) c ON x.k = c.k GROUP BY x.k", {"a": "3e-1"}),
    "kadane": Op("SELECT k, max(p - least(0, before)) AS best FROM (SELECT k, p, coalesce(min(p) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM " + _PREFIX + " a) b GROUP BY k"),
    "longestunique": Op("SELECT k, CAST(max(i - edge) AS BIGINT) AS longest FROM (SELECT k, i, max(p) OVER (PARTITION BY k ORDER BY i) AS edge FROM (SELECT k, i, coalesce(lag(i) OVER (PARTITION BY k, v ORDER BY i), 0) AS p FROM " + _RANKED + " a) b) c GROUP BY k"),
    "prefixsum": Op("SELECT k, max(CASE WHEN i = {hi} THEN p END) - coalesce(max(CASE WHEN i = {lo} THEN p END), 0) AS range_sum, max(CASE WHEN i = n THEN p END) AS total FROM (SELECT k, i, count(*) OVER (PARTITION BY k) AS n, CAST(sum(v) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS p FROM " + _RANKED + " a) b GROUP BY k", {"lo": 5, "hi": 15}),
    "prefixsum2d": Op("SELECT r, c, CAST(sum(s) OVER (PARTITION BY c ORDER BY r) AS BIGINT) AS p FROM (SELECT r, c, CAST(sum(v) OVER (PARTITION BY r ORDER BY c) AS BIGINT) AS s FROM (SELECT k % 8 AS r, seq % 8 AS c, TOTAL(v) AS v FROM {ev} GROUP BY 1, 2) a) b"),
    "rainwater": Op("SELECT k, TOTAL(least(l, r) - v) AS water FROM (SELECT k, v, max(v) OVER (PARTITION BY k ORDER BY i) AS l, max(v) OVER (PARTITION BY k ORDER BY i DESC) AS r FROM " + _RANKED + " a) b GROUP BY k"),
    "runningmedian": Op("SELECT k, seq, round(percentile(v, 0.5) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS med FROM {ev}", {}, "SELECT k, seq, round(median(v) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS med FROM {ev}"),
    "slidingcount": Op("SELECT k, seq, CAST(sum(v) OVER w AS BIGINT) AS total, count(*) OVER w AS n, round(avg(v) OVER w, 6) AS mean FROM {ev} WINDOW w AS (PARTITION BY k ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"),
    "slidingmax": Op("SELECT k, seq, max(v) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS top FROM {ev}"),
}

ORDERING = {
    "coordcompress": Op("SELECT k, seq, CAST(dense_rank() OVER (PARTITION BY k ORDER BY v) - 1 AS BIGINT) AS rank FROM {ev}"),
    "coordinatedomission": Op("SELECT kind, count(*) AS samples, TOTAL(v2) AS total FROM (SELECT kind, v - {every} * i AS v2 FROM (SELECT kind, v, SERIES(CAST(0 AS BIGINT), greatest(CAST(0 AS BIGINT), INT((v - 1) / {every}e0))) AS i FROM {ev}) y) x WHERE v2 > 0 OR v2 IS NULL GROUP BY kind", {"every": 25}),
    "countingsort": Op("SELECT v, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY v) AS BIGINT) AS ends FROM {ev} GROUP BY v"),
    "heapsort": Op("SELECT k, seq, CAST(row_number() OVER (PARTITION BY k ORDER BY v, seq) AS BIGINT) AS place FROM {ev}"),
    "ordering": Op("SELECT k, TOTAL(CASE WHEN s <= top THEN 1 ELSE 0 END) AS violations FROM (SELECT k, s, max(s) OVER (PARTITION BY k ORDER BY a, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT k, seq, seq AS s, t + (seq * 7919 % 97) * 3600 AS a FROM {ev}) x) y GROUP BY k"),
    "orderstat": Op("SELECT k, TOTAL(CASE WHEN v <= {value} THEN 1 ELSE 0 END) AS rank, max(CASE WHEN r = {nth} THEN v END) AS selected FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v, seq) AS r FROM {ev}) x GROUP BY k", {"value": 40, "nth": 7}),
    "quickselect": Op("SELECT kind, v FROM (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY v, seq) AS r FROM {ev}) x WHERE r = {nth} + 1", {"nth": 12}),
    "lis": Op(
        "SELECT k, CAST(size(aggregate(transform(array_sort(collect_list(named_struct('s', seq, 'v', v))), e -> e.v), CAST(array() AS ARRAY<BIGINT>), (a, x) -> concat(filter(a, e -> e < x), array(x), slice(filter(a, e -> e >= x), 2, 1000000)))) AS BIGINT) AS longest FROM {ev} GROUP BY k",
        {},
        "SELECT k, CAST(len(list_reduce(list(v ORDER BY seq), lambda a, x: list_concat(list_filter(a, lambda e: e < x), list_concat([x], list_filter(a, lambda e: e >= x)[2:])), CAST([] AS BIGINT[]))) AS BIGINT) AS longest FROM {ev} GROUP BY k",
    ),
    "nextpermutation": Op(
        """SELECT k, JOINED(transform(CASE WHEN i = 0 THEN reverse(a) ELSE concat(slice(a, 1, i - 1), array(a[j - 1]), reverse(transform(sequence(i + 1, size(a)), x -> CASE WHEN x = j THEN a[i - 1] ELSE a[x - 1] END))) END, x -> TEXT(x)), ',') AS following FROM
           (SELECT k, a, i, CASE WHEN i = 0 THEN 0 ELSE array_max(filter(sequence(i + 1, size(a)), x -> a[x - 1] > a[i - 1])) END AS j FROM (SELECT k, a, coalesce(array_max(filter(sequence(1, size(a) - 1), x -> a[x - 1] < a[x])), 0) AS i FROM
           (SELECT k, transform(array_sort(collect_list(named_struct('s', seq, 'v', v % 9))), e -> e.v) AS a FROM (SELECT k, v, seq FROM {ev}) q GROUP BY k HAVING count(*) > 1) b) c) d""",
        {},
        """SELECT k, array_to_string(CASE WHEN i = 0 THEN list_reverse(a) ELSE list_concat(a[1:i - 1], list_concat([a[j]], list_reverse(list_transform(generate_series(i + 1, len(a)), lambda x: CASE WHEN x = j THEN a[i] ELSE a[x] END)))) END, ',') AS following FROM
           (SELECT k, a, i, CASE WHEN i = 0 THEN 0 ELSE list_max(list_filter(generate_series(i + 1, len(a)), lambda x: a[x] > a[i])) END AS j FROM (SELECT k, a, coalesce(list_max(list_filter(generate_series(1, len(a) - 1), lambda x: a[x] < a[x + 1])), 0) AS i FROM
           (SELECT k, list(v % 9 ORDER BY seq) AS a FROM (SELECT k, v, seq FROM {ev}) q GROUP BY k HAVING count(*) > 1) b) c) d""",
    ),
    "resequencer": Op("SELECT k, max(CASE WHEN seen = seq_in THEN seq_in ELSE 0 END) AS contiguous, count(*) AS offered FROM (SELECT k, r AS seq_in, count(*) OVER (PARTITION BY k ORDER BY r) AS seen FROM (SELECT DISTINCT k, v % 30 + 1 AS r FROM {ev}) x) y GROUP BY k"),
    "skewmeter": Op("SELECT k, max(CASE WHEN r = CAST(ceil(n * 0.9e0) AS BIGINT) THEN d END) AS p90, round(100 * avg(CASE WHEN d > {bound} THEN 1e0 ELSE 0e0 END), 4) AS refused_share FROM (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d, seq) AS r, count(*) OVER (PARTITION BY k) AS n FROM (SELECT k, seq, (seq * 7919 % 97) * 60 AS d FROM {ev}) x) y GROUP BY k", {"bound": 3000}),
}

_SPANS = "(SELECT k, t AS a, t + (v + 1) * 600 AS b, seq FROM {ev})"
SETS = {
    "mergeintervals": Op("SELECT k, min(a) AS a, max(b) AS b FROM (SELECT k, a, b, CAST(sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a, b, seq) AS BIGINT) AS s FROM (SELECT k, a, b, seq, max(b) OVER (PARTITION BY k ORDER BY a, b, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM " + _SPANS + " x) y) z GROUP BY k, s"),
    "intervalset": Op("SELECT k, TOTAL(greatest(CAST(0 AS BIGINT), b - greatest(a, coalesce(reach, a)))) AS covered FROM (SELECT k, a, b, max(b) OVER (PARTITION BY k ORDER BY a, b, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM " + _SPANS + " x) y GROUP BY k"),
    "sweepline": Op("SELECT k, max(c) AS peak FROM (SELECT k, CAST(sum(d) OVER (PARTITION BY k ORDER BY pt, d, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS c FROM (SELECT k, a AS pt, 1 AS d, seq FROM " + _SPANS + " x UNION ALL SELECT k, b AS pt, -1 AS d, seq FROM " + _SPANS + " y) z) w GROUP BY k"),
    "crdtcounter": Op("SELECT kind, TOTAL(up) AS added, TOTAL(up) - TOTAL(down) AS value FROM (SELECT kind, k, max(CASE WHEN ok THEN v ELSE 0 END) AS up, max(CASE WHEN v < 30 THEN v ELSE 0 END) AS down FROM {ev} GROUP BY kind, k) x GROUP BY kind"),
    "crdtset": Op("SELECT DISTINCT k FROM {ev} WHERE kind = 'signup' EXCEPT SELECT k FROM {ev} WHERE kind = 'error' AND v > 90"),
    "lwwregister": Op("SELECT k, max_by(v, seq) AS v, max(seq) AS stamp, count(*) - 1 AS discarded FROM {ev} GROUP BY k"),
    "lwwset": Op("SELECT k, item FROM (SELECT k, v % 10 AS item, max(CASE WHEN ok THEN seq END) AS added, coalesce(max(CASE WHEN NOT ok THEN seq END), -1) AS removed FROM {ev} GROUP BY 1, 2) x WHERE added >= removed"),
    # An add stays unless a later removal of its item has seen it.
    "orset": Op(
        "SELECT DISTINCT k, item FROM (SELECT k, v % 10 AS item, seq, ok, max(CASE WHEN NOT ok THEN seq END) OVER (PARTITION BY k, v % 10) AS removed FROM {ev}) x WHERE ok AND (removed IS NULL OR seq > removed)",
        {},
        "SELECT DISTINCT a.k AS k, a.item AS item FROM (SELECT k, v % 10 AS item, seq AS tag FROM {ev} WHERE ok) a LEFT JOIN (SELECT x.k AS k, y.seq AS tag FROM {ev} x JOIN {ev} y ON x.k = y.k AND x.v % 10 = y.v % 10 AND y.seq < x.seq WHERE NOT x.ok AND y.ok) r ON a.k = r.k AND a.tag = r.tag WHERE r.tag IS NULL",
    ),
    "merkle": Op("SELECT bucket, SHA(JOINED(LIST(TEXT(k)), ',')) AS digest FROM (SELECT DISTINCT BUCKET(k, {leaves}) AS bucket, k FROM {ev}) x GROUP BY bucket", {"leaves": 16}),
    "unionstream": Op("SELECT min(top) - {bound} AS merged, count(*) AS inputs, max(top) - min(top) AS spread FROM (SELECT kind, max(t) AS top FROM {ev} GROUP BY kind) x WHERE top > (SELECT max(t) FROM {ev}) - {idle}", {"bound": 3600, "idle": 864000}),
}

OPERATORS = WINDOWS | FRAMES | ORDERING | SETS
