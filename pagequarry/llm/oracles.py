"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TWINS: dict[str, str] = {}

_TWINS["op8_minhash"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda k: array_to_string(ws[k:k + 4], ' '))) AS sh
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def registry() -> dict[str, str]:
    return dict(_TWINS)

_TWINS["op4_substrings"] = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS pos, unnest(list_transform(range(1, len(ws) - 11), lambda k: array_to_string(ws[k:k + 12], ' '))) AS seq
  FROM w WHERE len(ws) >= 13
), m AS (SELECT seq, min(doc_id) AS first_doc FROM win GROUP BY 1),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (
    SELECT win.doc_id, unnest(range(pos, pos + 13)) AS p FROM win JOIN m USING (seq) WHERE first_doc < win.doc_id) GROUP BY 1
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
    CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS ks
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""

_QUOTAS = "(0, '', 30), (1, 'src0', 150), " + ", ".join(f"({k}, '{name}', {100 if name in ('src1', 'src2', 'src3', 'src4') else 28})" for k, name in enumerate(sorted(f"src{n}" for n in range(1, 20)), 2))

_TWINS["op2_mixing"] = f"""
WITH RECURSIVE q(i, pool, quota) AS (VALUES {_QUOTAS}),
a AS (SELECT list(quota ORDER BY i) AS av FROM q),
edf(t, ks, pick) AS (
  SELECT 0, list_transform(av, lambda x: 0), 0 FROM a
  UNION ALL
  SELECT t + 1, list_transform(ks, lambda k, i: CASE WHEN i = p THEN k + 1 ELSE k END), p FROM (
    SELECT t, ks, list_min(list_filter(list_transform(ks, lambda k, i: CASE WHEN k < av[i] AND (k * 1000) // av[i] <= t
      THEN {{'d': CAST(ceil((k + 1) * 1000.0 / av[i]) AS BIGINT), 'i': i}} END), lambda x: x IS NOT NULL)).i AS p
    FROM edf, a WHERE t < 1000)
), slots AS (
  SELECT q.pool, q.quota, e.ks[e.pick] - 1 AS k, e.t - 1 AS slot FROM edf e JOIN q ON q.i + 1 = e.pick WHERE e.t > 0
), d AS (
  SELECT doc_id, source, coalesce(q.pool, '') AS pool,
    (row_number() OVER (PARTITION BY coalesce(q.pool, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // 8 AS block
  FROM documents LEFT JOIN q ON q.pool = source AND source <> ''
)
SELECT doc_id, source, block, (block // quota) * 1000 + (k * 1000) // quota AS release,
  (block // quota) * 1000 + CAST(ceil((k + 1) * 1000.0 / quota) AS BIGINT) AS deadline, (block // quota) * 1000 + slot AS slot
FROM d JOIN slots ON slots.pool = d.pool AND slots.k = block % quota
"""

_TWINS["op5_nearest"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, a.n + 1), lambda i: a.e[i] * b.e[i])) AS dot,
    sqrt(list_sum(list_transform(a.e, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b.e, lambda x: x * x))) AS nb
  FROM v a JOIN v b ON a.n = b.n AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT query_id, vec_id, dot / (na * nb) AS score, row_number() OVER (PARTITION BY query_id ORDER BY dot / (na * nb) DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_TWINS["op3_embedding_duplicates"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(range(1, a.n + 1), lambda i: a.e[i] * b.e[i])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) >= 0.98
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1), k AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""

_TWINS["op11_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR doc_id IS NULL OR doc_id = last), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_TWINS["op13_lexical_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS ts FROM documents),
n AS (SELECT r, doc_id, len(ts) AS size FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS terms FROM n),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
c AS (
  SELECT item_id, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * size * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN p USING (t) JOIN n USING (r), s GROUP BY item_id, r
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM c JOIN n USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
