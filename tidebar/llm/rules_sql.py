"""Comparison SQL (DuckDB) of the quality rules, the estimation unrolled step by step."""

from __future__ import annotations

from tidebar.llm.rules import BASE_FAILED, BLOCK, RULES, STEPS

_MEASURES = rf"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM m WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM again) GROUP BY r),
x AS MATERIALIZED (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(list_distinct(list_transform(w, lambda x, i: concat((i - 1) // {BLOCK}, ' ', x)))) AS n_distinct, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
  len(regexp_extract_all(t, '[!?]')) AS n_marks FROM m LEFT JOIN rep USING (r))"""


def oracle() -> str:
    rules = range(len(RULES))
    votes = ", ".join(
        f"CASE WHEN {bad} THEN 2 WHEN {good} THEN 1 ELSE 0 END AS v{i}" for i, (_, bad, good) in enumerate(RULES))
    names = ", ".join(f"v{i}" for i in rules)
    logit = " + ".join(
        f"CASE v{i} WHEN 2 THEN ln(a{i} / (1 - a{i})) WHEN 1 THEN -ln(a{i} / (1 - a{i})) ELSE 0 END" for i in rules)
    accuracy = ", ".join(
        f"least(greatest((coalesce(sum(CASE v{i} WHEN 2 THEN b * n WHEN 1 THEN (1 - b) * n END), 0) + 9)"
        f" / (coalesce(sum(CASE WHEN v{i} > 0 THEN n END), 0) + 10), 0.55e0), 0.995e0) AS a{i}" for i in rules)
    steps = ["acc0 AS MATERIALIZED (SELECT " + ", ".join(f"0.9e0 AS a{i}" for i in rules) + ")"]
    for k in range(STEPS):
        steps.append(f"post{k} AS MATERIALIZED (SELECT pat.*, 1 / (1 + exp(-({logit}))) AS b FROM pat, acc{k})")
        steps.append(f"acc{k + 1} AS MATERIALIZED (SELECT {accuracy} FROM post{k})")
    failed = f"({BASE_FAILED})"
    return (
        f"WITH {_MEASURES}, voted AS MATERIALIZED (SELECT *, {votes} FROM x), "
        f"pat AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL), {', '.join(steps)} "
        f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, "
        f"{failed} AS base_failed, NOT {failed} AND b <= 0.5 AS kept "
        f"FROM voted JOIN post{STEPS - 1} USING ({names})"
    )
