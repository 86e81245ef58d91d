"""DuckDB SQL for the queries of ``queries`` that SQL can express.

The other queries (sampling, components, classifiers, minimax cuts, gradient
training, fingerprints, CRF, tokenizers) are held against brute force in the tests.
"""

from __future__ import annotations

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, w[p:p + n - 1] AS words FROM s),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT rid, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT rid, item_id, p, win.n AS n FROM spots JOIN win ON win.n = spots.n AND w[p:p + spots.n - 1] = words),
marked AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY 1),
items AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT rid, item_id::VARCHAR AS k FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN items USING (rid)
"""

URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, '.' || host AS dotted FROM h),
j AS (SELECT *, CASE WHEN dotted LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN dotted LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN dotted LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN dotted LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
  host LIKE '%spam%' OR host LIKE '%casino%' OR host LIKE '%cheap-pills%' OR host LIKE '%porn%' OR dotted LIKE '%.ads.%' OR dotted LIKE '%.doubleclick.%' OR path LIKE '%/ads/%' OR path LIKE '%/banner/%' OR path LIKE '%.exe' OR path LIKE '%.zip' AS junk FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN junk THEN 'block' ELSE 'allow' END AS verdict FROM j
"""

# crc32 bit by bit, for the ids that say how many turns a conversation takes over.
_CRC = """xor(list_reduce(list_transform(range(0, length({0}) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295::BIGINT ELSE ord({0}[i])::BIGINT END),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS own, {_CRC.format("(conv_id::VARCHAR)")} % 6 AS h FROM t GROUP BY 1),
f AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS w FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, w, unnest(generate_series(0, len(w))) AS depth FROM f),
k AS (SELECT conv_id, depth, depth = len(w) AS stops, w[1:depth] AS key, w[1:depth - 1] AS up, coalesce(length(w[depth].x), 0) AS chars FROM p),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(chars) AS chars, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops) AS ends FROM k GROUP BY 1, 2),
ch AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (depth, key)),
below AS (SELECT key, n_convs, n_children, chars, unnest(generate_series(0, depth)) AS d FROM m),
s AS (SELECT d AS depth, key[1:d] AS key, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM below GROUP BY 1, 2)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s USING (depth, key) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.key = m.up
"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, x, n, form, array_to_string(w[1:a], '') AS head, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": DECONTAMINATION, "op5_url_filters": URLS, "op11_conversation_trie": TRIE, "op12_fill_in_middle": FILL_IN_MIDDLE}
