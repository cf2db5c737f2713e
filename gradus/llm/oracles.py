"""DuckDB SQL for the corpus queries that SQL can express: plain definitions, without pivots or sparse products."""

from __future__ import annotations

import string

TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(CAST(x AS DOUBLE) * 256) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), t AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END)) AS g
  FROM d
), reps AS (
  SELECT min(r) AS v, g, len(g) AS n, min(doc_id) AS doc_id FROM s WHERE doc_id IS NOT NULL AND len(g) > 0 GROUP BY g
), posts AS (
  SELECT v, n, unnest(g) AS g FROM reps
), shared AS (
  SELECT a.v AS a, b.v AS b, a.n AS n, b.n AS m, count(*) AS k
  FROM posts a JOIN posts b ON a.g = b.g AND a.v < b.v AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 90 * (n + m - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT v, v FROM reps
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least_of AS (
  SELECT reach.a AS v, min(reps.doc_id) AS m FROM reach JOIN reps ON reps.v = reach.b GROUP BY reach.a
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(least_of.m, s.doc_id) AS component_id
FROM s LEFT JOIN reps ON s.doc_id IS NOT NULL AND reps.g = s.g LEFT JOIN least_of ON least_of.v = reps.v
"""

FILTERS = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), least_of AS (
  SELECT text, min(doc_id) AS first FROM d GROUP BY text
), f AS (
  SELECT d.r, d.doc_id, part, list_filter([
    CASE WHEN len(w) < 50 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
    CASE WHEN 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 'C' END,
    CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > first THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM d JOIN least_of USING (text)
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), p(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)
), s AS (
  SELECT o AS filter_order, k AS step, o[k] AS own, string_split(o[:k - 1], '') AS before FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5
), e AS (
  SELECT part, filter_order, step, own, n, good, toxic, len(fails) AS m,
    list_contains(fails, own) AS here, list_has_any(fails, before) AS gone
  FROM c, s
), t AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (here AND m = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM e GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
"""


def sql() -> dict[str, str]:
    return {"op2_topk": TOP_K, "op7_jaccard": JACCARD, "op11_filters": FILTERS}
