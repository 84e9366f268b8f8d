"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) z WHERE len(w) >= size),
hits AS (SELECT a.doc_id, a.i, a.size, v.item FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM spot) a JOIN win v ON v.size = a.size AND v.s = a.s),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, lower(sha1(b)) AS hex FROM p),
bits AS (SELECT page_id, n, hex, list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', hex[i]) - 1), 4)), 'string_agg', '') AS bits FROM h),
d AS (SELECT page_id, n, hex, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(bits[5 * i + j] AS INTEGER) * CAST(pow(2, 5 - j) AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS digest FROM bits)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY hex, n)
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS t FROM d),
x AS (SELECT doc_id, unnest(t) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * c >= 90 * (len(a.t) + len(b.t) - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(n, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT n, v FROM reach JOIN e ON m = u)
SELECT s.doc_id, CAST(len(t) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN (SELECT n, min(m) AS component_id FROM reach GROUP BY n) r ON r.n = s.doc_id
"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op6_warc": OP6, "op9_jaccard_join": OP9}
