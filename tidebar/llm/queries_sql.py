"""Comparison SQL of the operators on pages and embeddings."""

from __future__ import annotations

_FINITE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
_INTEGERS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def archived() -> str:
    """SHA-1 in base32: eight times five hexadecimal digits, each four letters."""
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, sha1(h) AS d,
  row_number() OVER w AS place, first_value(page_id) OVER w AS head
  FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(list_transform(range(0, 8),
    lambda i: CAST('0x' || substr(d, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)),
    lambda v: {letters}), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN head END AS refers_to
FROM f"""


def hard_negatives() -> str:
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  {_INTEGERS} AS q FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


def clusters(k: int = 40, rounds: int = 5) -> str:
    """One assignment and one update per round, written out."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_INTEGERS} AS q
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, q FROM kept
  QUALIFY k < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'k': k}}) AS m FROM (
  SELECT x.r, c.k, CAST(list_sum(list_transform(list_zip(x.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
    AS BIGINT) AS d FROM kept x CROSS JOIN c{i} c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS q FROM (
    SELECT m.k AS k, j, sum(v) AS s, count(*) AS n
    FROM (SELECT a.m, unnest(x.q) AS v, unnest(range(1, 65)) AS j FROM a{i} a JOIN kept x USING (r))
    GROUP BY m.k, j) GROUP BY k
  UNION ALL SELECT k, q FROM c{i} WHERE k NOT IN (SELECT m.k FROM a{i}))""")
    return f"""WITH {", ".join(steps)}
SELECT x.vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance,
  CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept x USING (r) JOIN c{rounds} c ON c.k = m.k"""
