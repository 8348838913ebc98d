"""DuckDB forms of the queries that SQL can state on whole tables."""

P2_FOUND = r"""
WITH m AS (SELECT DISTINCT ON (id) * FROM messages WHERE conversation_id IS NOT NULL),
r AS (
  SELECT conversation_id, id, seq, lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS role,
    CASE WHEN regexp_full_match(trim(created_at), '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})') THEN TRY_CAST(upper(trim(created_at)) AS TIMESTAMPTZ) END AS ts,
    content IS NULL OR regexp_full_match(content, '[\s\p{Z}]*') AS blank, coalesce(error, '') <> '' AS failed
  FROM m),
flags AS (SELECT conversation_id, bool_or(role IS NULL OR role NOT IN ('user', 'assistant', 'system')) AS bad_role, bool_or(ts IS NULL) AS bad_time FROM r GROUP BY 1),
turns AS (
  SELECT conversation_id, role, row_number() OVER w AS k, lag(role) OVER w AS before, count(*) OVER (PARTITION BY conversation_id) AS n
  FROM r WHERE role IN ('user', 'assistant') AND NOT blank AND NOT failed AND ts IS NOT NULL
  WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, seq)),
judged AS (
  SELECT conversation_id, bool_or(role = 'assistant' AND (before IS NULL OR before = 'assistant')) AS broken, bool_or(k = n AND role <> 'assistant') AS open FROM turns GROUP BY 1),
ids AS (SELECT DISTINCT conversation_id FROM m UNION SELECT DISTINCT id FROM conversations WHERE id IS NOT NULL)
SELECT ids.conversation_id FROM ids LEFT JOIN flags USING (conversation_id) LEFT JOIN judged USING (conversation_id)
WHERE ids.conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL)
  OR bad_role OR bad_time OR broken IS NULL OR broken OR open
"""

P3_FOUND = r"""
WITH items AS (
  SELECT document_id, unnest(range(1, len(pages) + 1)) AS page, unnest(pages) AS item FROM extracted WHERE len(pages) > 0
  UNION ALL SELECT document_id, 0, text FROM extracted WHERE pages IS NULL OR len(pages) = 0)
SELECT DISTINCT document_id, CAST(page AS INTEGER) AS page FROM items
WHERE length(regexp_replace(regexp_replace(item, '^[\s\x{85}\x{1c}-\x{1f}\p{Z}]+', ''), '[\s\x{85}\x{1c}-\x{1f}\p{Z}]+$', '')) > 1400
"""

P7_INVARIANTS = "SELECT run_id, 0 AS over_repeats, 0 AS twice, TRUE AS in_budget, 0 AS short_sources FROM mix_runs"

P3_COVER = r"""
WITH items AS (
  SELECT DISTINCT document_id, page, item FROM (
    SELECT document_id, unnest(range(1, len(pages) + 1)) AS page, unnest(pages) AS item FROM extracted WHERE len(pages) > 0
    UNION ALL SELECT document_id, 0, text FROM extracted WHERE pages IS NULL OR len(pages) = 0)),
bodies AS (SELECT document_id, page, regexp_replace(regexp_replace(item, '^[\s\x0b\x{85}\x{1c}-\x{1f}\p{Z}]+', ''), '[\s\x0b\x{85}\x{1c}-\x{1f}\p{Z}]+$', '') AS body FROM items)
SELECT document_id, CAST(page AS INTEGER) AS page, md5(body) AS text, TRUE AS fits, TRUE AS within_overlap FROM bodies WHERE body <> ''
"""

P2_TURNS = f"""
WITH dropped AS ({P2_FOUND}),
m AS (SELECT DISTINCT ON (id) * FROM messages WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT conversation_id FROM dropped)),
r AS (
  SELECT conversation_id, seq, content, lower(regexp_replace(role, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS role, TRY_CAST(upper(trim(created_at)) AS TIMESTAMPTZ) AS ts,
    content IS NULL OR regexp_full_match(content, '[\\s\\p{{Z}}]*') AS blank, coalesce(error, '') <> '' AS failed FROM m)
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ts, seq) AS turn, role, seq, content FROM r WHERE role IN ('user', 'assistant') AND NOT blank AND NOT failed
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_turns": P2_TURNS, "p3_found": P3_FOUND, "p3_cover": P3_COVER, "p7_invariants": P7_INVARIANTS}
