"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LEAKS = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_sets AS (
  SELECT item_id, least(5, len(w)) AS n, unnest(list_distinct([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)])) AS s
  FROM item_words WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lengths AS (SELECT DISTINCT n FROM item_sets), doc_sets AS (
  SELECT doc_id, n, unnest(list_distinct([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)])) AS s
  FROM doc_words, lengths WHERE len(w) >= n
), sizes AS (SELECT item_id, count(*) AS n_item FROM item_sets GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, CAST(count(*) AS DOUBLE) / any_value(n_item) AS containment
FROM item_sets JOIN doc_sets USING (n, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.75 * any_value(n_item)
"""

_TOPK = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

_LINES = rf"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (
  SELECT key, min(doc_id) AS holder FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.holder AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)])) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id, d.doc_id = min(y) AS kept
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""


_MIX = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15) AS BIGINT) AS h FROM documents
), base AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1, 2][rank % 3 + 1] AS weight, [0.5::DOUBLE, -0.5, 0][rank % 3 + 1] AS ramp, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM base
), tried AS (
  SELECT *, cap / weight AS level, (words - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed
), found AS (SELECT min((level, rank, share)) FILTER (share <= level) AS f FROM tried), targets AS (
  SELECT source, source_size, n, ramp, least(cap, coalesce(f[3] * weight, cap)) AS target FROM tried, found
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp, CAST(round_even(t.target, 0) AS BIGINT) AS due,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h % CAST(ceil(sqrt(n)) AS BIGINT), h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lap
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, greatest(0, least(due - lap, size)) AS once, greatest(0, least(due - lap - source_size, size)) AS twice, CASE WHEN due > 0 THEN CAST(lap AS DOUBLE) / due END AS u FROM placed
)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken,
  CASE WHEN once > 0 THEN 2 * u / (1 + ramp + sqrt(greatest(0.0::DOUBLE, (1 + ramp) * (1 + ramp) - 4 * ramp * u))) END AS position
FROM taken
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_curriculum_mix": _MIX, "op6_benchmark_leaks": _LEAKS, "op8_exact_topk": _TOPK, "op9_line_dedup": _LINES, "op10_near_dedup": _NEAR}
