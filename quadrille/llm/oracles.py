"""DuckDB SQL for the results of the operators whose results a definition fixes, written from the definition: by brute force."""

NEAR_DUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 80 * (zx.n + zy.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS low FROM w UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept
FROM (SELECT id, min(low) AS low FROM r GROUP BY 1) JOIN w ON w.doc_id = id LEFT JOIN z USING (doc_id)
"""

SUFFIX = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, h, len(h) // 2 AS n FROM b),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
cut AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM rep)),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM cut GROUP BY 1, 2),
kept AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a, z FROM spans),
left_over AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS k, sum(z - a) AS removed, count(*) AS runs
  FROM kept JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

SIMILAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
g AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT vec_id AS id, vec_id AS low FROM v UNION SELECT g.y, r.low FROM r JOIN g ON g.x = r.id),
n AS (SELECT x AS vec_id, count(*) AS n FROM g GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept
FROM (SELECT id AS vec_id, min(low) AS low FROM r GROUP BY 1) LEFT JOIN n USING (vec_id)
"""

SQL = {"op6_induced_suffix": SUFFIX, "op9_minhash_near_dup": NEAR_DUP, "op10_cross_polytope": SIMILAR_VECTORS}
