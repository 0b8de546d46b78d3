"""SQL for the rows of those queries that SQL can express."""

QUALITY_RULES = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), split AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM docs
), win AS (
  SELECT rid, i, list_slice(ws, i, i + 4) AS five
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM split WHERE len(ws) >= 5)
), again AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, five) > 1
), cover AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid
), measures AS (
  SELECT d.doc_id, d.source, len(s.ws) AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(s.ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(s.ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM docs d JOIN split s USING (rid) LEFT JOIN cover c USING (rid)
), rules AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
         10 * n_symbols > n_words AND n_words > 0 AS symbols,
         n_dup_lines > 0 AND 100 * n_repeat_words > 10 * n_words AS lines
  FROM measures
), failures AS (
  UNPIVOT (SELECT source, short::INT AS short, repeats::INT AS repeats, symbols::INT AS symbols, lines::INT AS lines FROM rules)
  ON short, repeats, symbols, lines INTO NAME rule VALUE failed
), hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed)::DOUBLE AS f FROM failures GROUP BY ALL
), total AS (
  SELECT rule, sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(f) / sum(n) AS m FROM hosts GROUP BY rule
), around AS (
  SELECT rule, any_value(m) AS m, (sum(h.n * (f / h.n - m) * (f / h.n - m)) - (any_value(k) - 1) * any_value(m) * (1 - any_value(m)))
         / nullif(any_value(t.n) - any_value(nn) / any_value(t.n), 0) AS between_hosts
  FROM hosts h JOIN total t USING (rule) GROUP BY rule
), prior AS (
  SELECT rule, m, CASE WHEN between_hosts > 1e-12 THEN least(greatest(m * (1 - m) / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM around
), verdict AS (
  SELECT source, max((f + m * s) / (n + s)) > 0.5 AS host_failed FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT r.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       short OR repeats AS base_failed, NOT (short OR repeats) AND NOT host_failed AS kept
FROM rules r JOIN verdict v ON r.source IS NOT DISTINCT FROM v.source
"""

LINE_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), split AS (
  SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM docs
), lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), judged AS (
  SELECT k.rid, k.i, k.line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keep AS dropped FROM keyed k LEFT JOIN shared s USING (key)
), done AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS kept
  FROM judged GROUP BY rid
)
SELECT d.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM done JOIN docs d USING (rid)
"""
