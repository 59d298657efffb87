"""Strings, numbers, indexes and small optimisation problems, as SQL.

String operators run over benchmark items and event properties; number
operators over keys of the tables and series of a given length.
"""

from loomery.operators.sqlop import SqlOperator as Op

_N = "(SELECT SERIES(CAST(1 AS BIGINT), CAST({n} AS BIGINT)) AS n)"
_WORDS = "(SELECT DISTINCT p_brand AS s FROM {part})"
_LONG = "(SELECT item_id, text AS s FROM {benchmark})"
_AT = "(SELECT item_id, s, SERIES(CAST(1 AS BIGINT), CAST(length(s) AS BIGINT)) AS i FROM " + _LONG + " w)"

STRINGS = {
    "kmp": Op("SELECT item_id, count(*) AS hits, min(i) AS first_hit FROM " + _AT + " x WHERE substring(s, CAST(i AS INT), length('{pattern}')) = '{pattern}' GROUP BY item_id", {"pattern": "the"}, "SELECT item_id, count(*) AS hits, min(i) AS first_hit FROM " + _AT + " x WHERE starts_with(s[i:], '{pattern}') GROUP BY item_id"),
    "horspool": Op("SELECT item_id, CAST(instr(s, '{pattern}') AS BIGINT) AS first_hit FROM " + _LONG + " x WHERE instr(s, '{pattern}') > 0", {"pattern": "on"}),
    "rabinkarp": Op("SELECT item_id, INT((length(s) - length(replace(s, '{pattern}', ''))) / 2e0) AS hits FROM " + _LONG + " x", {"pattern": "in"}),
    "zalgo": Op("SELECT item_id, max(i) AS last_hit, count(*) AS hits FROM " + _AT + " x WHERE i > 1 AND substring(s, CAST(i AS INT), 2) = substring(s, 1, 2) GROUP BY item_id"),
    "ahocorasick": Op("SELECT item_id, p AS pattern, count(*) AS hits FROM (SELECT item_id, s, i, p FROM " + _AT + " x CROSS JOIN (SELECT 'the' AS p UNION ALL SELECT 'er' AS p UNION ALL SELECT 'on' AS p UNION ALL SELECT 'he' AS p) q) y WHERE substring(s, CAST(i AS INT), length(p)) = p GROUP BY item_id, p"),
    "booth": Op("SELECT s, min(r) AS least_rotation FROM (SELECT s, concat(substring(s, CAST(i AS INT)), substring(s, 1, CAST(i - 1 AS INT))) AS r FROM (SELECT s, SERIES(CAST(1 AS BIGINT), CAST(length(s) AS BIGINT)) AS i FROM " + _WORDS + " w) x) y GROUP BY s"),
    "deltaencode": Op("SELECT k, count(*) AS n, TOTAL(CASE WHEN d < 128 THEN 1 WHEN d < 16384 THEN 2 WHEN d < 2097152 THEN 3 WHEN d < 268435456 THEN 4 ELSE 5 END) AS encoded_bytes, count(*) * 8 AS raw_bytes FROM (SELECT k, t - lag(t, 1, t) OVER (PARTITION BY k ORDER BY t, seq) AS d FROM {ev}) x GROUP BY k"),
    "editdistance": Op("SELECT a.s AS a, b.s AS b, CAST(levenshtein(a.s, b.s) AS BIGINT) AS distance FROM " + _WORDS + " a JOIN " + _WORDS + " b ON a.s < b.s"),
    "gray": Op("SELECT n, XOR(n, RSHIFT(n, 1)) AS code FROM " + _N + " x", {"n": 256}),
    "lcpkasai": Op(
        """SELECT item_id, max(coalesce(array_max(filter(sequence(1, least(length(suffix), length(before))), n -> substring(suffix, 1, n) = substring(before, 1, n))), 0)) AS longest_repeat FROM
           (SELECT item_id, suffix, lag(suffix) OVER (PARTITION BY item_id ORDER BY suffix) AS before FROM (SELECT item_id, substring(s, CAST(i AS INT)) AS suffix FROM """ + _AT + """ a) b) c WHERE before IS NOT NULL GROUP BY item_id""",
        {},
        """SELECT item_id, CAST(max(coalesce(list_max(list_filter(generate_series(1, least(length(suffix), length(before))), lambda n: suffix[1:n] = before[1:n])), 0)) AS INTEGER) AS longest_repeat FROM
           (SELECT item_id, suffix, lag(suffix) OVER (PARTITION BY item_id ORDER BY suffix) AS before FROM (SELECT item_id, s[i:] AS suffix FROM """ + _AT + """ a) b) c WHERE before IS NOT NULL GROUP BY item_id""",
    ),
    "luhn": Op("SELECT c_custkey, luhn_check(lpad(CAST(c_custkey * 7919 AS STRING), 12, '0')) AS valid FROM {customer}", {}, "SELECT c_custkey, list_sum(list_transform(generate_series(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(d[i] AS INT) * 2 > 9 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END)) % 10 = 0 AS valid FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') AS d FROM {customer}) x"),
    "rle": Op("SELECT k, kind, count(*) AS run_length, min(seq) AS starts FROM (SELECT k, kind, seq, row_number() OVER (PARTITION BY k ORDER BY seq) - row_number() OVER (PARTITION BY k, kind ORDER BY seq) AS g FROM {ev}) x GROUP BY k, kind, g"),
    "snowflake": Op("SELECT seq, ((t - 1704067200) * 1000 * 4194304) + (k % 1024) * 4096 + row_number() OVER (PARTITION BY k % 1024, t ORDER BY seq) - 1 AS id FROM {ev}"),
    # Every node of a trie of names: the words below it and the first of them.
    "trie": Op(
        "SELECT prefix, count(*) AS words, min(s) AS first_word FROM (SELECT s, substring(s, 1, CAST(n AS INT)) AS prefix FROM (SELECT s, SERIES(CAST(1 AS BIGINT), CAST(length(s) AS BIGINT)) AS n FROM (SELECT DISTINCT p_name AS s FROM {part}) w) x) y GROUP BY prefix",
        {},
        "SELECT prefix, len(words) AS words, words[1] AS first_word FROM (SELECT prefix, list(s ORDER BY s) AS words FROM (SELECT s, unnest(list_transform(generate_series(1, length(s)), lambda n: s[:n])) AS prefix FROM (SELECT DISTINCT p_name AS s FROM {part}) w) x GROUP BY prefix) y",
    ),
    "lcs": Op(
        """SELECT a.s AS a, b.s AS b, CAST(element_at(aggregate(sequence(1, length(a.s)), transform(sequence(0, length(b.s)), j -> 0), (row, i) -> aggregate(sequence(1, length(b.s)), array(0), (out, j) -> array_append(out, CASE WHEN substring(a.s, i, 1) = substring(b.s, j, 1) THEN row[j - 1] + 1 ELSE greatest(row[j], out[j - 1]) END))), -1) AS BIGINT) AS length FROM """ + _WORDS + " a JOIN " + _WORDS + " b ON a.s < b.s",
        {},
        """SELECT a.s AS a, b.s AS b, CAST(list_reduce(generate_series(1, length(a.s)), lambda acc, i: list_reduce(generate_series(1, length(b.s)), lambda o, j: list_append(o, CASE WHEN a.s[i] = b.s[j] THEN acc[j] + 1 ELSE greatest(acc[j + 1], o[j]) END), [0]), list_transform(generate_series(0, length(b.s)), lambda j: 0))[-1] AS BIGINT) AS length FROM """ + _WORDS + " a JOIN " + _WORDS + " b ON a.s < b.s",
    ),
}

NUMBERS = {
    "sieve": Op("SELECT a.n AS prime FROM " + _N + " a LEFT JOIN (SELECT DISTINCT x.n * y.n AS c FROM " + _N + " x JOIN " + _N + " y ON x.n > 1 AND y.n > 1 AND x.n <= y.n AND x.n * y.n <= {n}) b ON a.n = b.c WHERE b.c IS NULL AND a.n > 1", {"n": 1000}, "SELECT a.n AS prime FROM " + _N + " a WHERE a.n > 1 AND NOT EXISTS (SELECT 1 FROM " + _N + " b WHERE b.n > 1 AND b.n < a.n AND a.n % b.n = 0)"),
    "simpson": Op("SELECT n AS degree, round(sum(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(i / {steps}e0, n)) / (3e0 * {steps}), 7) AS integral FROM " + _N + " x CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST({steps} AS BIGINT)) AS i) s GROUP BY n", {"n": 6, "steps": 200}),
    "extgcd": Op(
        "SELECT c_custkey, aggregate(sequence(1, 60), named_struct('a', c_custkey, 'b', c_nationkey + CAST({plus} AS BIGINT)), (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a) AS gcd FROM {customer}",
        {"plus": 360},
        "SELECT c_custkey, gcd(c_custkey, CAST(c_nationkey + {plus} AS BIGINT)) AS gcd FROM {customer}",
    ),
    "crt": Op("SELECT c_custkey, min(x) AS solution FROM {customer} JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST(1000 AS BIGINT)) AS x) s ON x % 7 = c_custkey % 7 AND x % 11 = c_nationkey % 11 AND x % 13 = 5 GROUP BY c_custkey", {}, "SELECT c_custkey, CAST((715 * (c_custkey % 7) + 364 * (c_nationkey % 11) + 924 * 5) % 1001 AS BIGINT) AS solution FROM {customer}"),
    "matrixpow": Op(
        "SELECT n, aggregate(sequence(CAST(1 AS BIGINT), n), named_struct('a', CAST(0 AS BIGINT), 'b', CAST(1 AS BIGINT)), (s, i) -> named_struct('a', s.b, 'b', s.a + s.b), s -> s.a) AS fibonacci FROM " + _N + " x",
        {"n": 80},
        "SELECT n, CAST((list_reduce(generate_series(1, n), lambda s, i: {'a': s.b, 'b': s.a + s.b}, {'a': CAST(0 AS BIGINT), 'b': CAST(1 AS BIGINT)})).a AS BIGINT) AS fibonacci FROM " + _N + " x",
    ),
    "linearrecurrence": Op(
        "SELECT n, aggregate(sequence(CAST(1 AS BIGINT), n), named_struct('a', CAST(1 AS BIGINT), 'b', CAST(2 AS BIGINT), 'c', CAST(3 AS BIGINT)), (s, i) -> named_struct('a', s.b, 'b', s.c, 'c', (2 * s.c + 3 * s.a) % 1000003), s -> s.a) AS term FROM " + _N + " x",
        {"n": 60},
        "SELECT n, CAST((list_reduce(generate_series(1, n), lambda s, i: {'a': s.b, 'b': s.c, 'c': (2 * s.c + 3 * s.a) % 1000003}, {'a': CAST(1 AS BIGINT), 'b': CAST(2 AS BIGINT), 'c': CAST(3 AS BIGINT)})).a AS BIGINT) AS term FROM " + _N + " x",
    ),
    "rootfind": Op(
        "SELECT n, round(aggregate(sequence(1, 60), named_struct('lo', 0e0, 'hi', 20e0), (s, i) -> CASE WHEN power((s.lo + s.hi) / 2, 3) < n THEN named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2) END, s -> s.lo), 6) AS cube_root FROM " + _N + " x",
        {"n": 100},
        "SELECT n, round(power(n, 1 / 3e0), 6) AS cube_root FROM " + _N + " x",
    ),
    "ternarysearch": Op(
        "SELECT n, round(aggregate(sequence(1, 120), named_struct('lo', 0e0, 'hi', 100e0), (s, i) -> CASE WHEN -power(s.lo + (s.hi - s.lo) / 3 - n / 3e0, 2) < -power(s.hi - (s.hi - s.lo) / 3 - n / 3e0, 2) THEN named_struct('lo', s.lo + (s.hi - s.lo) / 3, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', s.hi - (s.hi - s.lo) / 3) END, s -> s.lo), 4) AS peak FROM " + _N + " x",
        {"n": 50},
        "SELECT n, round(n / 3e0, 4) AS peak FROM " + _N + " x",
    ),
}

INDEXES = {
    "bitmapindex": Op("SELECT kind, count(*) AS equals, TOTAL(CASE WHEN v % 2 = 0 THEN 1 ELSE 0 END) AS both, (SELECT count(*) FROM {ev}) - count(*) AS complement FROM {ev} GROUP BY kind"),
    "minqueue": Op("SELECT k, seq, min(v) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS minimum FROM {ev}"),
    "twostackqueue": Op("SELECT e.k AS k, e.v AS dequeued, d.seq AS taken_at FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM {ev} WHERE kind <> 'purchase') e JOIN (SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM {ev} WHERE kind = 'purchase') d ON e.k = d.k AND e.r = d.r"),
}

_DP = "transform(sequence(0, {capacity}), j -> CASE WHEN j >= x.w THEN greatest(s[j], s[j - CAST(x.w AS INT)] + x.p) ELSE s[j] END)"
OPTIMISATION = {
    "knapsack": Op(
        "SELECT k, element_at(aggregate(xs, transform(sequence(0, {capacity}), j -> CAST(0 AS BIGINT)), (s, x) -> " + _DP + "), -1) AS best FROM (SELECT k, array_sort(collect_list(named_struct('seq', seq, 'w', v % 17 + 1, 'p', v))) AS xs FROM {ev} GROUP BY k) y",
        {"capacity": 60},
        "SELECT k, (list_reduce(xs, lambda s, x: list_transform(generate_series(0, {capacity}), lambda j: CASE WHEN j >= x.w THEN greatest(s[j + 1], s[j - x.w + 1] + x.p) ELSE s[j + 1] END), list_transform(generate_series(0, {capacity}), lambda j: CAST(0 AS BIGINT))))[-1] AS best FROM (SELECT k, list({'w': v % 17 + 1, 'p': v} ORDER BY seq) AS xs FROM {ev} GROUP BY k) y",
    ),
    # Fewest coins of 3, 5 and 7; an amount they cannot make gives -1.
    "coinchange": Op(
        "SELECT n AS amount, CAST(coalesce(min(CASE WHEN rest >= 0 AND rest % 3 = 0 THEN a + b + c END), -1) AS BIGINT) AS coins FROM (SELECT n, a, b, n - 7 * a - 5 * b AS rest, INT((n - 7 * a - 5 * b) / 3e0) AS c FROM " + _N + " x CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST(20 AS BIGINT)) AS a) p CROSS JOIN (SELECT SERIES(CAST(0 AS BIGINT), CAST(20 AS BIGINT)) AS b) q) y GROUP BY n",
        {"n": 90},
    ),
    "fractionalknapsack": Op("SELECT k, round(sum(CASE WHEN c <= {capacity} THEN p WHEN c - w < {capacity} THEN p * ({capacity} - (c - w)) / CAST(w AS DOUBLE) ELSE 0 END), 5) AS best FROM (SELECT k, w, CAST(p AS DOUBLE) AS p, CAST(sum(w) OVER (PARTITION BY k ORDER BY p / CAST(w AS DOUBLE) DESC, seq) AS BIGINT) AS c FROM (SELECT k, seq, v % 17 + 1 AS w, v AS p FROM {ev}) a) b GROUP BY k", {"capacity": 60}),

    "weightedschedule": Op(
        "SELECT k, aggregate(xs, named_struct('best', CAST(0 AS BIGINT), 'log', CAST(array() AS ARRAY<STRUCT<b: BIGINT, w: BIGINT>>)), (s, x) -> named_struct('best', greatest(s.best, x.w + coalesce(array_max(transform(filter(s.log, e -> e.b <= x.a), e -> e.w)), 0)), 'log', array_append(s.log, named_struct('b', x.b, 'w', greatest(s.best, x.w + coalesce(array_max(transform(filter(s.log, e -> e.b <= x.a), e -> e.w)), 0))))), s -> s.best) AS best FROM (SELECT k, array_sort(collect_list(named_struct('b', t + v * 3000, 'seq', seq, 'a', t, 'w', v))) AS xs FROM {ev} GROUP BY k) y",
        {},
        "SELECT k, (list_reduce(xs, lambda s, x: {'best': greatest(s.best, x.w + coalesce(list_max(list_transform(list_filter(s.log, lambda e: e.b <= x.a), lambda e: e.w)), 0)), 'log': list_append(s.log, {'b': x.b, 'w': greatest(s.best, x.w + coalesce(list_max(list_transform(list_filter(s.log, lambda e: e.b <= x.a), lambda e: e.w)), 0))})}, {'best': CAST(0 AS BIGINT), 'log': CAST([] AS STRUCT(b BIGINT, w BIGINT)[])})).best AS best FROM (SELECT k, list({'b': t + v * 3000, 'seq': seq, 'a': t, 'w': v} ORDER BY t + v * 3000, seq) AS xs FROM {ev} GROUP BY k) y",
    ),
}

OPERATORS = STRINGS | NUMBERS | INDEXES | OPTIMISATION
