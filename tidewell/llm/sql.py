"""DuckDB SQL for the queries that SQL can express, by plain counting rather than by the operators' methods."""

_WORDS = "coalesce(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), CAST([] AS VARCHAR[]))"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS.format("text")} AS w FROM benchmark),
i2 AS (SELECT id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
i3 AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i2),
win AS (SELECT DISTINCT id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM i3),
sizes AS (SELECT DISTINCT n FROM win),
d2 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN sizes ON len(w) >= n),
d3 AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM d2),
hit AS (SELECT d3.doc_id, d3.k, d3.n, win.id FROM d3 JOIN win ON d3.n = win.n AND d3.s = win.s),
places AS (SELECT DISTINCT doc_id, k, n FROM hit),
words AS (SELECT doc_id, unnest(range(k, k + n)) AS p FROM places),
a AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM words GROUP BY doc_id),
b AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS p FROM d),
g AS (SELECT p.doc_id, p, CASE WHEN p + 50 <= len(h) // 2 THEN substr(h, CAST(2 * p + 1 AS INTEGER), 100) END AS s, substr(h, CAST(2 * p + 1 AS INTEGER), 2) AS byte FROM p JOIN d USING (doc_id)),
first AS (SELECT s, min(doc_id) AS least FROM g WHERE s IS NOT NULL GROUP BY s),
c AS (SELECT g.doc_id, g.p, g.byte, first.least < g.doc_id AS covered FROM g LEFT JOIN first USING (s)),
r AS (SELECT doc_id, p, byte, coalesce(bool_or(covered) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM c),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM r),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
r AS (SELECT doc_id, w, least(5, len(w)) AS n FROM d WHERE len(w) > 0 AND doc_id IS NOT NULL),
u AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM r),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + n - 1], ' ') AS s FROM u),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS h, count(*) AS n FROM s GROUP BY doc_id),
classes AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS class_size FROM sets),
reps AS (SELECT class_id, class_size, n FROM classes WHERE doc_id = class_id),
rs AS (SELECT s.doc_id, s.s FROM s JOIN reps ON s.doc_id = reps.class_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM rs a JOIN rs b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, q.class_size AS size FROM x JOIN reps p ON p.class_id = a JOIN reps q ON q.class_id = b WHERE 5 * n_both >= 4 * (p.n + q.n - n_both)),
reach AS (SELECT class_id AS id, class_id AS root FROM reps UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id),
grouped AS (SELECT id, min(root) AS group_id FROM reach GROUP BY id),
counts AS (SELECT a, CAST(sum(size) AS BIGINT) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_size, 1) AS class_size, coalesce(counts.n, 0) + coalesce(class_size, 1) - 1 AS n_links, coalesce(group_id, d.doc_id) AS group_id
FROM d LEFT JOIN classes USING (doc_id) LEFT JOIN counts ON counts.a = class_id LEFT JOIN grouped ON grouped.id = class_id
"""
