"""SQL for those queries whose whole result SQL can express, over the whole tables."""

from __future__ import annotations

#: Marks and escapes are those of ``chat.INSTRUCT``.
CHAT = """WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
  replace(replace(replace(text, '&', '&#38;'), '<', '&#60;'), '[', '&#91;') AS shown FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(shown) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 9 + length(replace(replace(replace(replace(replace(replace(role, '&', '&#38;'), '<', '&#60;'), '[', '&#91;'), '|', '&#124;'), '/', '&#47;'), '>', '&#62;')) END) AS BIGINT) AS formatted_chars,
  bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM t GROUP BY conv_id"""

#: Every 400-byte string of every text, by its digest; islands of starts; what stands between them.
SUFFIX = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT r, h, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)),
rep AS (SELECT r, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
m AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM rep),
g AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS island FROM m),
s AS (SELECT r, island, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY r, island),
kept AS (SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS x, a AS y FROM s UNION ALL SELECT r, max(b), NULL FROM s GROUP BY r),
told AS (SELECT r, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY x) AS left_ FROM kept JOIN d USING (r) GROUP BY r),
lost AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, h))) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN told USING (r)"""

VECTORS = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v) AND list_inner_product(v, v) > 0),
l AS (SELECT a.r AS u, b.r AS w FROM ok a JOIN ok b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT r AS u, r AS w FROM e UNION SELECT reach.u, l.w FROM reach JOIN l ON l.u = reach.w),
c AS (SELECT reach.u, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.w GROUP BY 1),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.u = e.r LEFT JOIN n ON n.u = e.r"""
