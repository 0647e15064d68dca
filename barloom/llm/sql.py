"""SQL with the rows of this subpackage's queries, where SQL can express them at a bearable cost.

op1's verdict, the codecs and the language model have no SQL form; op3's takes
minutes on the tables. Tests hold those to brute-force versions.
"""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.c = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) q ON q.d = d.doc_id""",
    "op4_benchmark_decontamination": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS z, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, z, k, array_to_string(list_slice(w, k, k + z - 1), ' ') AS g FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM w, (SELECT DISTINCT z FROM g) WHERE len(w) >= z)),
h AS (SELECT doc_id, k, s.z, item FROM s JOIN g ON s.g = g.g AND s.z = g.z),
n AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + z)) AS i FROM (SELECT DISTINCT doc_id, k, z FROM h)) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS t FROM h GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN i ON i.doc_id = w.doc_id""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, k, md5(array_to_string(list_slice(w, k, k + 49), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS d FROM s GROUP BY 1),
h AS (SELECT doc_id, k FROM s JOIN f USING (g) WHERE d < doc_id),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
c AS (SELECT p.doc_id, x, i, coalesce(max(h.k) OVER (PARTITION BY p.doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), -99) > i - 50 AS gone FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.k = p.i),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM c GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN a ON a.doc_id = w.doc_id""",
    "op7_url_filters": rf"""
WITH u AS (SELECT page_id, coalesce(regexp_matches(html, '%%%|\*\*\*|###'), false) AS junk, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages),
k AS (SELECT page_id, junk, translate(regexp_extract(r, '^[^/?#]*', 0), {LOWER}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT unnest(['ads-track.example.com', 'casino-win.example.net', 'spam-farm.example.org', 'adult-x.example.com', 'cheap-pills.example.net', 'free-bets.example.net']) AS site),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'example.net', '/de/8'), ('allow', 'net', '/de/'), ('block', 'org', '/es/')) t(action, h, p)),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action FROM k JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT k.page_id, host, path, rule, coalesce(action, CASE WHEN host || path IN (SELECT host || path FROM k WHERE junk OR EXISTS (SELECT 1 FROM l WHERE host = site OR ends_with(host, '.' || site))) THEN 'block' ELSE 'allow' END) AS verdict FROM k LEFT JOIN m ON k.page_id = m.page_id""",
}
