"""DuckDB SQL of the contracts of operators that SQL can express on small tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components by the least id reachable, from links (a, b) both ways and nodes (id).
REACH = """reach(id, other) AS (
  SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

NEAR = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), nodes AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN component ON component.id = d.doc_id"""

REPEATS = """WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), piece AS (  -- of 899 bytes, so that no place is far from the start of its string
  SELECT doc_id, c, substr(h, 2 * c + 1, 1798) AS p FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399, 500)) AS c FROM t WHERE len(h) >= 800)
), place AS (
  SELECT doc_id, c + j AS i, md5(substr(p, 2 * j + 1, 800)) AS m FROM (SELECT doc_id, c, p, unnest(range(0, len(p) // 2 - 399)) AS j FROM piece)
), often AS (
  SELECT m FROM place GROUP BY m HAVING count(*) > 1
), hit AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM place SEMI JOIN often USING (m)
), island AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit
), span AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM island GROUP BY doc_id, k
), gap AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM span
), cut AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gap JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)"""

DECONTAMINATED = """WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), place AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pattern) WHERE len(w) >= m)
), found AS (
  SELECT doc_id, item_id, place.m, i FROM place JOIN pattern USING (m, s)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM found) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)"""

VECTORS = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e
  FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) >= 0.93
), nodes AS (SELECT vec_id AS id FROM embeddings), {REACH}, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings LEFT JOIN degree ON a = vec_id JOIN component ON id = vec_id"""
