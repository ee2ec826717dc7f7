"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[p:p + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw))),
h AS (SELECT DISTINCT doc_id, p, m, item_id FROM dw JOIN iw USING (m, w)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM h)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP2 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN least <> page_id THEN least END AS refers_to
FROM q
"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11(rounds: int = 2) -> str:
    """Codebooks as tables (part, entry, position, value), a table for each round."""
    nearest = """SELECT i, p, e, d FROM (
    SELECT i, p, e, d, row_number() OVER (PARTITION BY i, p ORDER BY d, e) AS r FROM (
      SELECT x.i, x.p, b.e, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM x JOIN {0} b USING (p, j) GROUP BY ALL)) WHERE r = 1"""
    out = f"""WITH k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings WHERE {_WHOLE}),
x AS MATERIALIZED (
  SELECT i, (c - 1) // w AS p, (c - 1) % w AS j, floor(256 * embedding[c]::DOUBLE)::BIGINT AS v
  FROM (SELECT i, embedding, len(embedding) // 16 AS w, unnest(range(1, len(embedding) + 1)) AS c FROM k)),
b0 AS MATERIALIZED (SELECT p, i AS e, j, v FROM x WHERE i < 64),
"""
    for r in range(rounds):
        out += f"""a{r} AS MATERIALIZED ({nearest.format(f"b{r}")}),
b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM b{r} b
  LEFT JOIN (SELECT p, e, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM a{r} JOIN x USING (i, p) GROUP BY ALL) m USING (p, e, j)),
"""
    return out + f"""f AS MATERIALIZED ({nearest.format(f"b{rounds}")}),
c AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY i)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN c USING (i)"""


def _op12(rounds: int = 10) -> str:
    """Centroids as tables (cluster, position, value), a table for each round."""
    nearest = """SELECT i, e, d FROM (
    SELECT i, e, d, row_number() OVER (PARTITION BY i ORDER BY d, e) AS r FROM (
      SELECT x.i, b.e, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM x JOIN {0} b USING (j) GROUP BY ALL)) WHERE r = 1"""
    out = f"""WITH k AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS i FROM embeddings WHERE len(embedding) = 64 AND {_WHOLE}),
x AS MATERIALIZED (SELECT i, c AS j, floor(1024 * embedding[c]::DOUBLE)::BIGINT AS v FROM (SELECT i, embedding, unnest(range(1, 65)) AS c FROM k)),
b0 AS MATERIALIZED (SELECT i AS e, j, v FROM x WHERE i < 8),
"""
    for r in range(rounds):
        out += f"""a{r} AS MATERIALIZED ({nearest.format(f"b{r}")}),
b{r + 1} AS MATERIALIZED (
  SELECT b.e, b.j, coalesce(m.v, b.v) AS v FROM b{r} b
  LEFT JOIN (SELECT e, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM a{r} JOIN x USING (i) GROUP BY ALL) m USING (e, j)),
"""
    return out + f"""f AS MATERIALIZED ({nearest.format(f"b{rounds}")})
SELECT vec_id, e::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY e))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM k JOIN f USING (i) JOIN (SELECT e, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS h FROM b{rounds} GROUP BY e) USING (e)"""


ORACLES = {"op1_decontamination": OP1, "op2_warc": OP2, "op11_vector_codes": _op11(), "op12_centroid_clustering": _op12()}
