"""SQL of the queries that SQL can express, over the same tables."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# five bits at a time, each read from the two hex digits that hold it
OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS d FROM p),
f AS (SELECT d, payload_bytes, min(page_id) AS first FROM h GROUP BY 1, 2)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(d, (5 * i) // 4 + 1, 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
FROM h JOIN f USING (d, payload_bytes)
"""

_SHINGLES = f"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOW}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d)"""

OP4 = f"""
WITH RECURSIVE {_SHINGLES}, n AS (SELECT doc_id, len(g) AS n FROM s), x AS (SELECT doc_id, unnest(g) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT node, b FROM r JOIN e ON reached = a), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON node = doc_id
"""

_ESCAPE = "replace(replace(replace(replace({x}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e'), '<|', '\\p')"

OP5 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
l AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, length(any_value(loss)) AS loss_chars, sha256(any_value(loss)) AS loss_sha256,
  CAST(sum(4 + length(replace(replace({_ESCAPE.format(x='role')}, ':', '\\c'), chr(10), '\\w')) + 2 + length({_ESCAPE.format(x='text')}) + 8) AS BIGINT) AS formatted_chars
FROM t JOIN l USING (conv_id) GROUP BY 1
"""

CHAT_PARTS = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ((turn % 5) + 5) % 5 AS k FROM conversations), n AS (SELECT *, CASE k WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'document' WHEN 3 THEN 'video' END AS kind, row_number() OVER w AS no, count(*) FILTER (k <> 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS place FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_ESCAPE.format(x='text')})),
m AS (SELECT *, '### ' || replace(replace({_ESCAPE.format(x='role')}, ':', '\\c'), chr(10), '\\w') || ':' || chr(10) || {_ESCAPE.format(x='text')} || CASE WHEN kind IS NULL THEN '\\e' ELSE '<|' || kind || ':' || place || '|>' END || '\\pend</turn>' || chr(10) AS said, CASE k WHEN 0 THEN 256 WHEN 1 THEN 128 WHEN 2 THEN 7 ELSE 0 END AS tokens FROM n)
SELECT conv_id, count(*) AS n_turns, CAST(sum(tokens) AS INTEGER) AS media_tokens, coalesce(string_agg(kind || ' media:' || turn || ' ' || tokens, ',' ORDER BY no) FILTER (kind IS NOT NULL), '') AS attachments, sha256(string_agg(said, '' ORDER BY no)) AS formatted_sha256 FROM m GROUP BY 1
"""

# two hex digits a byte, so that cuts fall on bytes
OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM n WHERE n >= 100)),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w), g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM k WHERE r > 1),
i AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
c AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM i UNION ALL SELECT doc_id, max(b), CAST(1000000000 AS BIGINT) FROM i GROUP BY 1), q AS (SELECT c.doc_id, string_agg(substr(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS kept FROM c JOIN n ON c.doc_id = n.doc_id GROUP BY 1),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM i GROUP BY 1)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM n LEFT JOIN t USING (doc_id) LEFT JOIN q USING (doc_id)
"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), g AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT node, b FROM r JOIN e ON reached = a), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM e WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id
"""

_WORDS = f"list_filter(regexp_split_to_array({LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w, least(13, len({_WORDS})) AS n FROM benchmark),
x AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b WHERE n > 0)), k AS (SELECT DISTINCT n FROM x),
y AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, n, i, item FROM y JOIN x USING (n, g)), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES = {"op1_warc": OP1, "op4_minhash": OP4, "op5_chat": OP5, "chat_parts": CHAT_PARTS, "op6_suffix": OP6, "op8_vectors": OP8, "op10_decontaminate": OP10}
