"""DuckDB SQL stating the results of the queries that SQL can express."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

STATEMENTS["op4_decontaminate"] = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size,
         array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win
  FROM item_words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS r(i)
  WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(words) - size + 2)) AS r(i)),
hits AS (SELECT doc_id, i, doc_windows.size AS size, item_id
         FROM doc_windows JOIN item_windows USING (win, size)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM hits, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

STATEMENTS["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, n, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
        FROM documents)),
repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT doc_id, n, line, first_doc IS NOT NULL AND first_doc <> doc_id AS gone
  FROM lines LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

STATEMENTS["op12_hard_negatives"] = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM kept a, kept b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
      FROM positives JOIN scored USING (anchor_id)
      WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
WHERE rank <= 3
"""


def _lloyd(clusters: int = 40, rounds: int = 5) -> str:
    """A statement with the rounds one after the other; products of small integers are exact."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
centres0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v AS c FROM kept
  WHERE vec_id IS NOT NULL QUALIFY cluster < {clusters})"""]
    for r in range(rounds + 1):
        steps.append(f"""
placed{r} AS MATERIALIZED (
  SELECT vec_id, v, cluster, distance FROM (
    SELECT vec_id, v, cluster, (list_dot_product(v, v) - 2 * list_dot_product(v, c)
                                + list_dot_product(c, c))::BIGINT AS distance
    FROM kept, centres{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM placed{r})
  GROUP BY cluster, d),
centres{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM centres{r} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY d) AS m
    FROM sums{r} GROUP BY cluster) USING (cluster))""")
    return ",".join(steps) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM placed{rounds} JOIN centres{rounds} USING (cluster)
"""


STATEMENTS["op13_sharded_kmeans"] = _lloyd()
