"""SQL (DuckDB) for the operators that it can express on whole small tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, (SELECT min(b) FROM r WHERE r.a = w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""

_ALNUM = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION = f"""
WITH i AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS m, array_to_string(ws[k:k + 12], ' ') AS s FROM i, unnest(range(1, greatest(len(ws) - 11, 2))) t(k) WHERE len(ws) > 0),
d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
dw AS (SELECT doc_id, k, m, array_to_string(ws[k:k + m - 1], ' ') AS s FROM d, (SELECT DISTINCT m FROM iw) AS sizes, unnest(range(1, greatest(len(ws) - m + 2, 1)::BIGINT)) t(k)),
h AS (SELECT doc_id, k, dw.m, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.m = iw.m),
c AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM h, unnest(range(0, m)) t(o) GROUP BY 1),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i:i + 34], ' ')) AS c FROM w, unnest(range(1, greatest(len(ws) - 33, 1))) t(i)),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM v, range(35) t(k) WHERE c > 1),
x AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y ON y.doc_id = w.doc_id"""


def _crc32(text: str) -> str:
    """crc32 of a short text, bit by bit."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda k: [ascii(({text})[k])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


RUNS = f"""
WITH o AS (SELECT doc_id, {_WORDS} AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
p AS (SELECT doc_id, ws, h, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS r FROM o),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + r)) END + 1]) ELSE ws END AS ws FROM p),
w AS (SELECT doc_id, n, i, ws[i + 1] AS w FROM d, unnest(range(n)) t(i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
c AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM g GROUP BY doc_id, q, island HAVING count(*) >= greatest(24 - q, 2 * q)),
f AS (SELECT doc_id, s, len, min(q) AS q FROM c GROUP BY doc_id, s, len),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM f GROUP BY doc_id),
t AS (SELECT x.doc_id, x.s, x.len, x.q FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.doc_id = x.doc_id
    AND (y.len * x.q > x.len * y.q OR y.len * x.q = x.len * y.q AND (y.s < x.s OR y.s = x.s AND y.q < x.q)))),
e AS (SELECT DISTINCT doc_id, k AS i FROM f, unnest(range(s + q, s + len)) u(k)),
k AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN e ON e.doc_id = w.doc_id AND e.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, t.s AS start, t.len AS length, t.q AS period, 1000 * t.len // t.q AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

TRIE = f"""
WITH RECURSIVE o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {_crc32("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS base FROM o GROUP BY conv_id),
s AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS given FROM c LEFT JOIN c b ON b.conv_id = c.base),
t AS (SELECT o.conv_id, pos - h + given AS pos, role, text FROM o JOIN s ON s.conv_id = o.conv_id WHERE pos > h
    UNION ALL SELECT s.conv_id, pos, role, text FROM s JOIN o ON o.conv_id = s.base WHERE pos <= given),
m AS (SELECT c.conv_id, count(t.pos) AS len FROM c LEFT JOIN t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
k AS (SELECT conv_id, pos, text, sha256(role || chr(10) || text) AS turn FROM t),
p(conv_id, depth, path, parent, len) AS (SELECT conv_id, 0::BIGINT, '', NULL::VARCHAR, len FROM m
    UNION ALL SELECT p.conv_id, p.depth + 1, sha256(p.path || k.turn), p.path, p.len FROM p JOIN k ON k.conv_id = p.conv_id AND k.pos = p.depth + 1),
n AS (SELECT depth, path, parent, min(p.conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN len = depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id) AS ends, max(coalesce(length(k.text), 0)) AS chars
    FROM p LEFT JOIN k ON k.conv_id = p.conv_id AND k.pos = p.depth GROUP BY depth, path, parent),
e AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.parent = n.path) AS n_children FROM n),
u AS (SELECT e.depth, e.path, sum((y.n_children = 0)::BIGINT) AS n_leaves, sum((y.n_convs - 1) * y.chars) AS saved
    FROM e JOIN p ON p.conv_id = e.conv_id AND p.depth = e.depth
    JOIN (SELECT DISTINCT a.depth AS depth, a.path AS path, b.depth AS d, b.path AS q FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth) r ON r.depth = e.depth AND r.path = e.path
    JOIN e y ON y.depth = r.d AND y.path = r.q GROUP BY e.depth, e.path)
SELECT e.conv_id, e.depth, f.conv_id AS parent_conv_id, e.n_convs, e.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM e JOIN u ON u.depth = e.depth AND u.path = e.path LEFT JOIN e f ON f.depth = e.depth - 1 AND f.path = e.parent"""
