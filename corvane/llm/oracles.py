"""The same results in DuckDB's SQL, over its registered tables."""

OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, lang, source, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM s)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
m AS (SELECT s.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM s LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  (1000 * word_chars) // greatest(n_words, 1) AS mean_chars, (1000 * n_symbols) // greatest(n_words, 1) AS symbol_rate,
  (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_line_rate FROM m),
u AS (UNPIVOT (SELECT lang, source, mean_chars, symbol_rate, dup_line_rate FROM f WHERE NOT base_failed) ON mean_chars, symbol_rate, dup_line_rate INTO NAME measure VALUE v),
e AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS e FROM u),
b AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE ((v >> e) + 1) * (1 << e) - 1 END AS top FROM e),
q0 AS (SELECT lang, source, measure, count(*) AS n, quantile_disc(top, 0.25) AS a, quantile_disc(top, 0.75) AS z FROM b GROUP BY ALL),
q1 AS (SELECT lang, measure, count(*) AS n, quantile_disc(top, 0.25) AS a, quantile_disc(top, 0.75) AS z FROM b GROUP BY ALL),
q2 AS (SELECT measure, quantile_disc(top, 0.25) AS a, quantile_disc(top, 0.75) AS z FROM b GROUP BY ALL),
p1 AS (SELECT lang, measure, (n * q1.a + 20 * q2.a) // (n + 20) AS a, (n * q1.z + 20 * q2.z) // (n + 20) AS z FROM q1 JOIN q2 USING (measure)),
p0 AS (SELECT lang, source, measure, (n * q0.a + 20 * p1.a) // (n + 20) AS a, (n * q0.z + 20 * p1.z) // (n + 20) AS z FROM q0 JOIN p1 USING (lang, measure)),
c AS (SELECT lang, source, measure, a - 4 * (z - a) - s AS lo, z + 4 * (z - a) + s AS hi FROM p0 JOIN (VALUES ('mean_chars', 1500), ('symbol_rate', 600), ('dup_line_rate', 400)) AS t(measure, s) USING (measure))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(mean_chars BETWEEN a.lo AND a.hi, true) AND coalesce(symbol_rate BETWEEN b.lo AND b.hi, true)
  AND coalesce(dup_line_rate BETWEEN c.lo AND c.hi, true) AS kept
FROM f LEFT JOIN c AS a ON (f.lang, f.source, 'mean_chars') = (a.lang, a.source, a.measure)
LEFT JOIN c AS b ON (f.lang, f.source, 'symbol_rate') = (b.lang, b.source, b.measure)
LEFT JOIN c ON (f.lang, f.source, 'dup_line_rate') = (c.lang, c.source, c.measure)
"""

OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.h = f.h
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM t),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l)),
h AS (SELECT doc_id, g.n, i, item_id FROM g JOIN t ON g.n = t.n AND g.x = t.x),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS own FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(own, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.b AS component_id, d.doc_id = c.b AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) AS c ON c.a = d.doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM h),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
o AS (SELECT v.doc_id, count(c.k) AS n_removed, string_agg(word, ' ' ORDER BY v.k) FILTER (c.k IS NULL) AS kept FROM v LEFT JOIN c ON v.doc_id = c.doc_id AND v.k = c.k GROUP BY v.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, n, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN i + 100 <= n THEN md5(substr(x, 2 * i + 1, 200)) END AS g FROM (SELECT *, unnest(range(0, n)) AS i FROM d)),
f AS (SELECT doc_id, i, byte, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS dup FROM b),
c AS (SELECT doc_id, i, byte, coalesce(max(CASE WHEN dup THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS gone FROM f),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM c),
o AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

OP13_SQL = """
WITH t AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
s AS (SELECT c, l, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: [CAST(ascii(y) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS b FROM t),
k AS (SELECT c, l, xor(list_reduce(b, lambda a, y: xor(xor(a, y) >> 1, (xor(a, y) & 1) * 3988292384)), 4294967295) % 9 AS h FROM s),
r AS (SELECT k.c, list_concat(coalesce(b.l, [])[1:k.h], k.l[k.h + 1:]) AS l FROM k LEFT JOIN t AS b ON b.c = k.c - k.c % 5),
p AS (SELECT c, d, l[1:d] AS x, len(l) = d AS stops FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT x, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (stops), '')) AS ends_sha256 FROM p GROUP BY x, d),
w AS (SELECT x[1:d - 1] AS up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(x[d].x) END AS saves FROM n LEFT JOIN w ON n.x = w.up),
a AS (SELECT y AS x, sum(saves) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT x[1:unnest(range(0, d + 1))] AS y, saves, n_children FROM f) GROUP BY y)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a ON a.x = f.x LEFT JOIN n AS u ON f.d > 0 AND u.x = f.x[1:f.d - 1]
"""
