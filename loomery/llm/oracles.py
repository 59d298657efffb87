"""SQL for a second engine of the queries of this package that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM q
"""

DEDUP = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def _jump(buckets: int) -> str:
    advanced = "((s.st * 2862933555777941757 + 1) % 18446744073709551616)"
    start = "{'st': CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END, 'at': CAST(0 AS DOUBLE), 'nx': CAST(0 AS DOUBLE)}"
    step = f"CASE WHEN s.nx < {buckets} THEN {{'st': {advanced}, 'at': s.nx, 'nx': CAST(floor((s.nx + 1) * (2147483648e0 / (CAST({advanced} // 8589934592 AS DOUBLE) + 1))) AS DOUBLE)}} ELSE s END"
    return f"CAST((list_reduce(generate_series(1, {buckets}), lambda s, x: {step}, {start})).at AS INTEGER)"


SHARDING = f"""
WITH bits AS (SELECT i, list_reduce(generate_series(1, 8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v FROM (SELECT unnest(generate_series(0, 255)) AS i) s),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
d AS (SELECT doc_id, coalesce(text, '') AS t, {_jump(8)} AS shard, {_jump(9)} AS grown_shard FROM documents),
b AS (SELECT doc_id, t, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST(concat('0x', h) AS BIGINT)) AS bytes, shard, grown_shard FROM d)
SELECT doc_id, CAST(strlen(b.t) + 1 AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32,
       'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM b CROSS JOIN crc
"""

_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, lag(role) OVER o AS before, lead(role) OVER o AS after FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
m AS (SELECT *, CASE WHEN before = role THEN 5 WHEN role = 'system' THEN 7 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 3 ELSE 7 + length(replace({_ESCAPED.format('role')}, ']', '&rsqb;')) END
             + length({_ESCAPED.format('text')}) + CASE WHEN after = role THEN 0 WHEN role = 'system' THEN 8 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 4 ELSE 7 END AS chars FROM w),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS whole,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT d.doc_id, coalesce(min(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
