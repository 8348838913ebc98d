"""Queries over texts: measures, cleaning, passages, headers; each with its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import text as x
from docketry.operators import chunking
from docketry.operators.catalog import once
from docketry.session import read_table as t


def _pages(s, b):
    """Documents as small web pages, so that the cleaner has whole texts to work on."""
    d = t(s, b, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("<html><HEAD><title>"), F.coalesce("lang", F.lit("")), F.lit("</title><style>p {}</style></HEAD><body><script type='x'>var a = '</p>';</script><p>"),
                 F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>&nbsp;&quot;end&quot;<br/></body></html>")).alias("html"),
    )


PAGES_SQL = """(SELECT doc_id, '<html><HEAD><title>' || coalesce(lang, '') || '</title><style>p {}</style></HEAD><body><script type=''x''>var a = ''</p>'';</script><p>'
    || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p>&nbsp;&quot;end&quot;<br/></body></html>' AS html FROM documents)"""
# White space as Unicode and Java see it together.
WS = r"[\s\x0b\x{85}\x{1c}-\x{1f}\p{Z}]"


def _headers(s, b):
    f = once(t(s, b, "files")).join(once(t(s, b, "cases")).select(F.col("id").alias("case_id"), "reference"), "case_id", "left")
    page = F.when(F.col("page_count") > 1, F.col("page_count"))
    head = x.context_header(F.col("reference"), F.col("file_name"), page)
    return f.select("id", head.alias("header"), x.embed_input(head, F.col("mime"), x.task_prefix(F.lit("nomic-embed-text"), False)).alias("input"), x.format_id(F.lit("nomic-embed-text")).alias("format_id"))


QUERIES = {
    "html_text": lambda s, b: _pages(s, b).select("doc_id", x.strip_html("html").alias("text")),
    "doc_stats": lambda s, b: t(s, b, "documents").select("doc_id", x.word_count("text").cast("long").alias("words"), x.token_estimate("text").cast("long").alias("token_estimate"), F.sha2("text", 256).alias("checksum")),
    "duplicate_docs": lambda s, b: t(s, b, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1"),
    "chunks": lambda s, b: chunking.chunks(t(s, b, "extracted")),
    "chunk_counts": lambda s, b: chunking.chunk_sizes(t(s, b, "extracted")),
    "context_headers": _headers,
    "mime_types": lambda s, b: once(t(s, b, "files")).select("id", x.guess_mime("file_name").alias("mime"), x.is_supported(x.guess_mime("file_name")).alias("supported"), x.safe_name(F.col("file_name")).alias("safe_name")),
    "snippets": lambda s, b: t(s, b, "documents").select("doc_id", x.snippet(F.col("text"), 120).alias("snippet")),
    "format_bytes": lambda s, b: once(t(s, b, "files")).select("id", x.format_bytes(F.col("size_bytes")).alias("shown")),
    "format_relative": lambda s, b: once(t(s, b, "cases")).select("id", x.format_relative(F.col("updated_at"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).alias("shown")),
    "error_diagnosis": lambda s, b: once(t(s, b, "messages")).filter("error <> ''").select("id", x.diagnosis(F.col("error")).alias("problem")),
    "format_date": lambda s, b: once(t(s, b, "messages")).select("id", x.format_date("created_at").alias("shown")),
    "valid_json": lambda s, b: once(t(s, b, "messages")).select("id", x.valid_json("citations").alias("valid")),
    "service_errors": lambda s, b: once(t(s, b, "messages")).select("id", x.service_error("error").alias("kind")),
    "document_passages": lambda s, b: chunking.document_chunks(chunking.chunks(t(s, b, "extracted")), once(t(s, b, "files")).filter("index_status = 'Failed'").select(F.col("id").alias("document_id"))).select("document_id", "ordinal", "chunk_id", F.md5("text").alias("text")),
    "csv_rows": lambda s, b: once(t(s, b, "people")).select("id", F.concat_ws(",", *[x.csv_field(F.col(c)) for c in ("full_name", "role", "organization", "email", "notes")]).alias("line")),
}


def _csv(c: str) -> str:
    return f"""CASE WHEN regexp_matches(coalesce({c}, ''), '[",\\n]') THEN '"' || replace(coalesce({c}, ''), '"', '""') || '"' ELSE coalesce({c}, '') END"""


SQL = {
    "html_text": rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<head[^>]*>.*?</head>', ' ', 'gis') AS h FROM {PAGES_SQL}),
        e AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS h FROM a)
        SELECT doc_id, trim(regexp_replace(h, '{WS}+', ' ', 'g')) AS text FROM e""",
    "doc_stats": rf"""SELECT doc_id, CASE WHEN trim(regexp_replace(text, '{WS}+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g')), ' ')) END AS words,
        CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 1 AS token_estimate, sha256(text) AS checksum FROM documents""",
    "duplicate_docs": "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "context_headers": """WITH f AS (SELECT f.id, f.mime, concat_ws(' — ', nullif(trim(c.reference), ''), nullif(trim(f.file_name), ''), CASE WHEN page_count > 1 THEN 'p. ' || page_count END) AS header
        FROM (SELECT DISTINCT * FROM files) f LEFT JOIN (SELECT DISTINCT * FROM cases) c ON c.id = f.case_id)
        SELECT id, header, 'search_document: ' || CASE WHEN header = '' THEN mime ELSE header || chr(10) || chr(10) || mime END AS input, 'v2|nomic-embed-text' AS format_id FROM f""",
    "mime_types": r"""WITH f AS (SELECT id, file_name, CASE lower(regexp_extract(file_name, '\.([^./\\]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
        WHEN 'doc' THEN 'application/msword' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/plain' WHEN 'markdown' THEN 'text/plain' WHEN 'rtf' THEN 'application/rtf' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'csv' THEN 'text/csv'
        WHEN 'json' THEN 'application/json' WHEN 'xml' THEN 'application/xml' WHEN 'eml' THEN 'message/rfc822' WHEN 'msg' THEN 'application/vnd.ms-outlook' ELSE 'application/octet-stream' END AS mime FROM (SELECT DISTINCT * FROM files))
        SELECT id, mime, mime NOT IN ('message/rfc822', 'application/vnd.ms-outlook', 'application/octet-stream') AS supported, regexp_replace(file_name, '[^\p{L}\p{N}._-]', '_', 'g') AS safe_name FROM f""",
    "snippets": r"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(text[1:120], '[\s\x0b\p{Z}]+$', '') || '...' END AS snippet FROM documents",
    "format_bytes": """SELECT id, CASE WHEN size_bytes = 0 THEN '0 B' WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', floor(size_bytes / 1024.0 * 10 + 0.5) / 10) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', floor(size_bytes / 1048576.0 * 10 + 0.5) / 10)
        ELSE printf('%.1f GB', floor(size_bytes / 1073741824.0 * 10 + 0.5) / 10) END AS shown FROM (SELECT DISTINCT * FROM files)""",
    "format_relative": """WITH d AS (SELECT id, updated_at, CAST(floor(epoch(TIMESTAMP '2023-01-01')) - floor(epoch(updated_at)) AS BIGINT) AS s FROM (SELECT DISTINCT * FROM cases))
        SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago' ELSE strftime(updated_at, '%Y-%m-%d') END AS shown FROM d""",
    "error_diagnosis": """SELECT id, CASE WHEN starts_with(trim(error), '{') THEN json_extract_string(TRY_CAST(error AS JSON), '$.problem') END AS problem FROM (SELECT DISTINCT ON (id) * FROM messages) WHERE error <> ''""",
    "csv_rows": f"SELECT id, {' || chr(44) || '.join(_csv(c) for c in ('full_name', 'role', 'organization', 'email', 'notes'))} AS line FROM (SELECT DISTINCT * FROM people)",
}

_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x0b\x{{85}}\x{{1c}}-\x{{1f}}\p{{Z}}]+', ''), '[\s\x0b\x{{85}}\x{{1c}}-\x{{1f}}\p{{Z}}]+$', '')"


def _units(body: str) -> str:
    """The list of paragraphs or sentences of a text."""
    paras = f"list_filter(list_transform(regexp_split_to_array({body}, '\\n[\\s\\x0b]*\\n'), lambda q: {_STRIP.format('q')}), lambda q: q <> '')"
    sentence = "string_split(regexp_replace(q, '([.!?])([\\s\\x0b]+[\\p{Lu}0-9\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"flatten(list_transform({paras}, lambda q: CASE WHEN strlen(q) <= 1400 THEN [q] ELSE {sentence} END))"


#: Packing as a recursion over the start of a passage; off: bytes before each unit, g: the same without the joining spaces.
CHUNKS_SQL = f"""
WITH RECURSIVE d AS (SELECT DISTINCT ON (document_id) document_id, text, pages FROM extracted),
pg AS (SELECT document_id, unnest(range(1, len(pages) + 1)) AS page, unnest(pages) AS body FROM d WHERE len(pages) > 0),
pu AS (SELECT document_id, page, unnest(range(1, len(u) + 1)) AS k, unnest(u) AS u FROM (SELECT document_id, page, {_units('body')} AS u FROM pg WHERE body IS NOT NULL)),
paged AS (SELECT document_id, list({{'u': u, 'page': page}} ORDER BY page, k) AS units FROM pu GROUP BY document_id),
plain AS (SELECT document_id, list_transform({_units('text')}, lambda x: {{'u': x, 'page': CAST(NULL AS BIGINT)}}) AS units FROM d WHERE text IS NOT NULL AND document_id NOT IN (SELECT document_id FROM paged)),
un AS (SELECT * FROM paged UNION ALL SELECT * FROM plain WHERE len(units) > 0),
uk AS (SELECT document_id, unnest(range(1, len(units) + 1)) AS k, unnest(list_transform(units, lambda x: strlen(x.u))) AS b FROM un),
cum AS (SELECT document_id, list_prepend(0, list(off ORDER BY k)) AS off, list_prepend(0, list(g ORDER BY k)) AS g FROM (SELECT document_id, k, sum(b + 1) OVER w AS off, sum(b) OVER w AS g FROM uk WINDOW w AS (PARTITION BY document_id ORDER BY k)) GROUP BY document_id),
r(document_id, ordinal, i, j) AS (
  SELECT document_id, 0, 0, greatest(1, len(list_filter(off, lambda x: x <= 1401)) - 1) FROM cum
  UNION ALL
  SELECT n.document_id, n.ordinal, n.i, greatest(n.i + 1, len(list_filter(c.off, lambda x: x <= c.off[n.i + 1] + 1401)) - 1) FROM (
    SELECT r.document_id, r.ordinal + 1 AS ordinal, CASE WHEN len(list_filter(c.g, lambda x: x <= c.g[r.j + 1] - 220)) BETWEEN r.i + 1 AND r.j - 1 THEN len(list_filter(c.g, lambda x: x <= c.g[r.j + 1] - 220)) ELSE r.j END AS i
    FROM r JOIN cum c USING (document_id) WHERE r.j < len(c.off) - 1) n JOIN cum c USING (document_id))
SELECT document_id || ':' || ordinal AS chunk_id, document_id, ordinal, CAST(off[i + 1] AS BIGINT) AS start_off, CAST(off[j + 1] - 1 AS BIGINT) AS end_off, units[i + 1].page AS page,
  array_to_string(list_transform(units[i + 1 : j], lambda x: x.u), ' ') AS text, CAST(ceil(strlen(array_to_string(list_transform(units[i + 1 : j], lambda x: x.u), ' ')) / 4.0) AS BIGINT) + 1 AS token_estimate
FROM r JOIN cum USING (document_id) JOIN un USING (document_id)
"""
SQL["chunks"] = CHUNKS_SQL
SQL["chunk_counts"] = f"SELECT document_id, count(*) AS n_chunks, CAST(sum(token_estimate) AS BIGINT) AS n_tokens FROM ({CHUNKS_SQL}) GROUP BY document_id"
SQL["document_passages"] = f"SELECT document_id, ordinal, chunk_id, md5(text) AS text FROM ({CHUNKS_SQL}) WHERE document_id IN (SELECT id FROM files WHERE index_status = 'Failed')"
SQL["service_errors"] = r"""SELECT DISTINCT ON (id) id, CASE WHEN trim(coalesce(error, '')) = '' THEN NULL WHEN regexp_matches(lower(error), 'connection refused|could not connect|dns|unreachable') THEN 'unreachable' WHEN regexp_matches(lower(error), 'timed out|timeout|deadline') THEN 'timeout'
    WHEN regexp_matches(lower(error), '\b401\b|unauthorized|invalid api key') THEN 'unauthorized' WHEN regexp_matches(lower(error), '\b404\b|model .*not found|no such model') THEN 'missing model' WHEN regexp_matches(lower(error), '\b429\b|rate limit|too many requests') THEN 'rate limit' ELSE 'other' END AS kind FROM messages"""
SQL["valid_json"] = "SELECT DISTINCT ON (id) id, citations IS NOT NULL AND json_valid(citations) AS valid FROM messages"
