"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

import math

from . import secrets as S

VECTOR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(name: str, pattern: str) -> str:
    """A table of all matches with their places: document, ordinal, match, start, end."""
    return f"""
{name}_cut AS (
  SELECT doc_id, regexp_extract_all(t, {_quoted(pattern)}) AS m, string_split_regex(t, {_quoted(pattern)}) AS g FROM d),
{name} AS (
  SELECT doc_id, m[i] AS m, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_cut))"""


def _tail(z: str) -> str:
    return f"(1 / (1 + exp(1.5976 * ({z}) + 0.07056 * ({z}) * ({z}) * ({z}))))"


def _secrets() -> str:
    share = {k: math.log(a / b) for k, (a, b) in S.WRITING.items()}
    kinds = ("lower", "a-z", "CASE k WHEN 16 THEN 6 WHEN 32 THEN 0 ELSE 26 END"), ("upper", "A-Z", "CASE k WHEN 16 THEN 0 ELSE 26 END"), (
        "digit", "0-9", "CASE k WHEN 16 THEN 10 WHEN 32 THEN 6 ELSE 10 END"), ("sign", "+/", "CASE k WHEN 64 THEN 2 ELSE 0 END")
    counts = ", ".join(f"length(b) - length(regexp_replace(b, '[{letters}]', '', 'g')) AS c_{name}, ({of}) AS w_{name}" for name, letters, of in kinds)
    chi2 = " + ".join(f"CASE WHEN w_{n} > 0 THEN (c_{n} - n * w_{n} / k) * (c_{n} - n * w_{n} / k) / (n * w_{n} / k) ELSE 0 END" for n, *_ in kinds)
    e_log = " + ".join(f"c_{n} * (ln(1 / k) - ({share[n]!r}))" for n, *_ in kinds)
    alphabet = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ALPHABETS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("f0", S.ASSIGN)}, {_found("f1", S.ACCESS)}, {_found("f2", S.HEX)}, {_found("f3", S.CANDIDATE)},
base AS (
  SELECT doc_id, s, 0 AS kind, s + length(m) AS e FROM f0 WHERE length(regexp_extract(m, {_quoted(S.ASSIGN)}, 2)) >= {S.LEAST_VALUE}
  UNION ALL SELECT doc_id, s, 1, s + length(m) FROM f1 UNION ALL SELECT doc_id, s, 2, s + length(m) FROM f2),
cand AS (
  SELECT doc_id, s, s + length(m) AS e, m, CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN 'hex'
         WHEN regexp_matches(m, '^[A-Z2-7]+=*$') THEN 'base32' ELSE 'base64' END AS enc
  FROM f3 WHERE NOT regexp_matches(m, '^[0-9]+$')
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = f3.doc_id AND base.s < f3.s + length(f3.m) AND f3.s < base.e)),
body AS (
  SELECT doc_id, s, e, CASE enc {alphabet} END AS a, CASE enc WHEN 'hex' THEN 16.0::DOUBLE WHEN 'base32' THEN 32 ELSE 64 END AS k,
         CASE WHEN enc = 'hex' THEN lower(rtrim(m, '=')) ELSE translate(rtrim(m, '='), '-_', '+/') END AS b FROM cand),
counted AS (
  SELECT *, length(b)::DOUBLE AS n, {counts},
         list_transform(string_split(b, ''), lambda c: (instr(a, c) - 1)::DOUBLE) AS x FROM body),
valued AS (
  SELECT *, {chi2} AS chi2, CASE k WHEN 64 THEN 3.0 ELSE 1.0 END AS df, {e_log} AS e_log,
         len(list_filter(x, lambda v: v > k / 2 - 0.5))::DOUBLE AS above,
         1.0 + len(list_filter(range(1, len(x)), lambda i: (x[i] > k / 2 - 0.5) <> (x[i + 1] > k / 2 - 0.5))) AS runs,
         coalesce(list_sum(list_transform(range(1, len(x)), lambda i: (x[i] - (k / 2 - 0.5)) * (x[i + 1] - (k / 2 - 0.5)))), 0) AS moment
  FROM counted),
spread AS (SELECT *, 1 + 2 * above * (n - above) / n AS expected FROM valued),
tested AS (
  SELECT *, (expected - 1) * (expected - 2) / (n - 1) AS variance,
         (pow(chi2 / df, 1.0 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) AS chi2_z,
         moment / ((k * k - 1) / 12) / sqrt(n - 1) AS serial_z FROM spread),
judged AS (
  SELECT doc_id, s, e, CASE WHEN least({_tail("chi2_z")}, CASE WHEN variance > 0 THEN 2 * {_tail("abs(runs - expected) / sqrt(variance)")} ELSE 0 END,
         2 * {_tail("abs(serial_z)")}) >= {S.BATTERY_LEVEL} / 3 THEN e_log ELSE '-Infinity'::DOUBLE END AS log_e FROM tested),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY log_e DESC) AS place, count(*) OVER (PARTITION BY doc_id) AS m FROM judged),
bar AS (
  SELECT doc_id, min(log_e) AS bar FROM ranked WHERE log_e >= ln(m / ({S.DISCOVERY_RATE} * place)) GROUP BY doc_id),
added AS (SELECT j.doc_id, j.s, 3 AS kind, j.e FROM judged j JOIN bar USING (doc_id) WHERE j.log_e >= bar.bar),
spans AS (
  SELECT doc_id, kind, s, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e AS span
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans,
         count(*) FILTER (kind = 3) AS n_random
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN joined ON joined.doc_id = d.doc_id
"""


SECRETS = _secrets()
