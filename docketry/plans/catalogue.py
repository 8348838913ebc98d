"""Queries over the catalogue tables, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import catalog as c
from docketry.operators import consistency as w
from docketry.operators.ordering import numbered
from docketry.session import read_table as t

NOW = "2022-06-15 12:00:00"
LINKS = "(SELECT DISTINCT case_id, person_id FROM case_people)"


def _edits(s, b):
    """Edits made from the cases themselves: every case whose id begins with a or b is closed, c is reopened with a new title, d gets a blank title (refused)."""
    first = F.substring("id", 1, 1)
    cases = c.once(t(s, b, "cases")).filter(first.isin("a", "b", "c", "d"))
    none = F.lit(None).cast("string")
    return cases.select(
        "id", F.when(first == "a", F.concat("reference", F.lit("-X"))).otherwise(none).alias("reference"), F.when(first == "c", F.concat(F.lit("Re: "), "title")).when(first == "d", F.lit(" ")).otherwise(F.col("title")).alias("title"),
        none.alias("category_id"), F.when(first == "c", "Open").otherwise("Closed").alias("status"), none.alias("description"),
    )


def sheets(s, b):
    """Conversations stand for sheets: they have a title, a case and a time of change."""
    return c.once(t(s, b, "conversations")).select("id", "title", "case_id", F.lit(200).alias("rows"), F.lit(26).alias("cols"), F.lit("{}").alias("cells"), "created_at", "updated_at")


def case_events(s, b):
    """Imports of files stand for the events of cases."""
    return c.once(t(s, b, "files")).select("id", F.col("file_name").alias("title"), "case_id", F.col("index_status").alias("kind"), F.col("created_at").alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("ends_at"), "created_at")


def _event_edits(s, b):
    """Events whose id begins with a get a new title and no kind, b a blank title (refused), c no start (refused); d comes in anew under another id."""
    first = F.substring("id", 1, 1)
    old = case_events(s, b).filter(first.isin("a", "b", "c", "d"))
    return old.select(
        F.when(first == "d", F.concat(F.lit("new-"), "id")).otherwise(F.col("id")).alias("id"), F.when(first == "b", " ").otherwise(F.concat(F.lit("Re: "), "title")).alias("title"), "case_id",
        F.lit("").alias("kind"), F.when(first != "c", F.col("starts_at")).alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("ends_at"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


def _sheet_edits(s, b):
    """Sheets whose id begins with a get cells, b cells that are no JSON (refused); c comes in anew under another id without anything."""
    first = F.substring("id", 1, 1)
    none = lambda kind: F.lit(None).cast(kind)
    return sheets(s, b).filter(first.isin("a", "b", "c")).select(
        F.when(first == "c", F.concat(F.lit("new-"), "id")).otherwise(F.col("id")).alias("id"), none("string").alias("title"), none("string").alias("case_id"), none("int").alias("rows"), none("int").alias("cols"),
        F.when(first == "a", '{"A1": "1"}').when(first == "b", "{broken").alias("cells"), none("timestamp_ntz").alias("created_at"), none("timestamp_ntz").alias("updated_at"),
    )


def _wanted_cases(s, b):
    """The cases that files are filed under, and as many keys that no case has."""
    ids = t(s, b, "files").select(F.col("case_id").alias("id")).filter("id IS NOT NULL").distinct()
    return ids.unionByName(ids.select(F.concat(F.lit("no-"), "id").alias("id")))


def _gone(s, b):
    return c.once(t(s, b, "cases")).filter("substring(id, 1, 1) IN ('1', '2')").select("id")


def _deleted(name):
    return lambda s, b: w.delete_cases(_gone(s, b), c.once(t(s, b, "cases")), c.once(t(s, b, "files")), c.once(t(s, b, "conversations")), t(s, b, "case_people").distinct())[name]


GONE_SQL = "(SELECT id FROM cases WHERE id[1] IN ('1', '2'))"

QUERIES = {
    "dashboard_counts": lambda s, b: c.dashboard(*[t(s, b, x) for x in ("cases", "people", "files", "conversations", "categories")]),
    "cases_by_status": lambda s, b: c.by_status(t(s, b, "cases")),
    "category_breakdown": lambda s, b: c.category_breakdown(t(s, b, "cases"), t(s, b, "categories")),
    "category_list": lambda s, b: c.category_list(t(s, b, "categories"), t(s, b, "cases")),
    "case_list_counts": lambda s, b: c.case_list(*[t(s, b, x) for x in ("cases", "categories", "files", "case_people")]),
    "case_list_filtered": lambda s, b: c.case_list(*[t(s, b, x) for x in ("cases", "categories", "files", "case_people")], search=" warehouse ", status="Open"),
    "people_search": lambda s, b: c.people_list(t(s, b, "people"), t(s, b, "case_people"), search="holdings"),
    "case_roster": lambda s, b: c.roster(t(s, b, "case_people"), t(s, b, "people")),
    "roster_order": lambda s, b: c.placed_roster(t(s, b, "case_people"), t(s, b, "people")).select("case_id", "person_id", "place"),
    "people_by_name": lambda s, b: numbered(c.once(t(s, b, "people")).select("id", "full_name"), [c.nocase("full_name"), F.col("id")], "place", 1).select("id", "place"),
    "case_lookup": lambda s, b: c.lookup(t(s, b, "cases").select("id", "reference", "title"), _wanted_cases(s, b)),
    "sheets_with_case": lambda s, b: c.with_case(sheets(s, b), t(s, b, "cases")).select("id", "title", "case_id", "case_reference", "case_title"),
    "events_with_case": lambda s, b: c.with_case(case_events(s, b), t(s, b, "cases")).select("id", "title", "kind", "case_id", "case_reference", "case_title"),
    "merge_events": lambda s, b: w.upsert_events(case_events(s, b), _event_edits(s, b), NOW).select("id", "title", "case_id", "kind", "starts_at", "created_at"),
    "merge_sheets": lambda s, b: w.upsert_sheets(sheets(s, b), _sheet_edits(s, b), NOW).select("id", "title", "rows", "cols", "cells", "updated_at"),
    "case_files": lambda s, b: c.file_list(t(s, b, "files").join(c.once(t(s, b, "cases")).filter("status = 'Open'").select(F.col("id").alias("case_id")), "case_id", "left_semi"), t(s, b, "cases")).select("id", "case_id", "case_reference"),
    "file_list_filtered": lambda s, b: c.file_list(t(s, b, "files"), t(s, b, "cases"), search="lease"),
    "recent_documents": lambda s, b: c.recent(c.file_list(t(s, b, "files"), t(s, b, "cases")), "created_at", 8),
    "next_reference": lambda s, b: c.next_reference(t(s, b, "cases")),
    "smallest_free_reference": lambda s, b: c.smallest_free(t(s, b, "cases")),
    "conversation_list": lambda s, b: c.conversation_list(t(s, b, "conversations"), t(s, b, "messages")),
    "recent_history": lambda s, b: c.history(t(s, b, "messages")),
    "prompts": lambda s, b: c.prompts(t(s, b, "conversations"), t(s, b, "messages"), c.once(t(s, b, "conversations")).filter("title <> ''").select(F.col("id").alias("conversation_id"), F.col("title").alias("question")), "Answer from the documents."),
    "auto_title": lambda s, b: c.auto_title(t(s, b, "conversations"), t(s, b, "messages")),
    "message_citations": lambda s, b: c.citations(t(s, b, "messages")),
    "duplicate_files": lambda s, b: c.repeated(t(s, b, "files"), "checksum"),
    "table_search": lambda s, b: c.table_search(c.once(t(s, b, "people")), "Plc", ["full_name", "organization", "role", "email"]).select("id", "full_name", "organization"),
    "table_page": lambda s, b: c.page(t(s, b, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 40, 80),
    "events_window": lambda s, b: c.between(t(s, b, "events"), "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("event_id", "ts", "event_type"),
    "upcoming_events": lambda s, b: c.upcoming(t(s, b, "events"), "2024-01-10 15:30:00").select("event_id", "ts", "event_type"),
    "events_by_day": lambda s, b: c.per_day(t(s, b, "events")).withColumn("day", F.col("day").cast("string")),
    "month_grid": lambda s, b: c.month_grid(t(s, b, "events")).withColumns({x: F.col(x).cast("string") for x in ("month", "day")}),
    "merge_cases": lambda s, b: w.upsert_cases(t(s, b, "cases"), _edits(s, b), NOW).select("id", "reference", "title", "status", "closed_at", "updated_at"),
    "delete_case_files": _deleted("files"),
    "delete_case_links": _deleted("case_people"),
    "delete_case_conversations": _deleted("conversations"),
    "reconcile_index": lambda s, b: w.reconcile(t(s, b, "files"), t(s, b, "extracted")),
    "stale_vectors": lambda s, b: w.stale(t(s, b, "files"), t(s, b, "extracted").select("document_id", F.when(F.length("text") % 3 == 0, "v1|small").otherwise("v2|small").alias("format_id")).dropDuplicates(["document_id"]), "v2|small"),
}

SQL = {
    "dashboard_counts": """SELECT (SELECT count(DISTINCT id) FROM cases) AS cases, (SELECT count(DISTINCT id) FROM cases WHERE lower(status) = 'open') AS open_cases,
        (SELECT count(DISTINCT id) FROM people) AS people, (SELECT count(DISTINCT id) FROM files) AS documents, (SELECT count(DISTINCT id) FROM files WHERE index_status = 'Ready') AS indexed_documents,
        (SELECT count(DISTINCT id) FROM conversations) AS conversations, (SELECT count(DISTINCT id) FROM categories) AS categories""",
    "cases_by_status": "SELECT status, count(DISTINCT id) AS n FROM cases GROUP BY status",
    "category_breakdown": """SELECT coalesce(k.name, 'Uncategorised') AS name, coalesce(k.color, '#64748b') AS color, count(*) AS case_count
        FROM (SELECT DISTINCT * FROM cases) c LEFT JOIN categories k ON k.id = c.category_id GROUP BY c.category_id, k.name, k.color""",
    "category_list": "SELECT id, name, practice_area, color, (SELECT count(DISTINCT c.id) FROM cases c WHERE c.category_id = k.id) AS case_count FROM categories k",
    "case_list_counts": f"""SELECT c.id, reference, title, status, k.name AS category_name, k.color AS category_color, updated_at,
        (SELECT count(DISTINCT f.id) FROM files f WHERE f.case_id = c.id) AS document_count, (SELECT count(*) FROM {LINKS} p WHERE p.case_id = c.id) AS person_count
        FROM (SELECT DISTINCT * FROM cases) c LEFT JOIN categories k ON k.id = c.category_id""",
    "people_search": f"""SELECT id, full_name, role, organization, email, (SELECT count(*) FROM {LINKS} l WHERE l.person_id = p.id) AS case_count FROM (SELECT DISTINCT * FROM people) p
        WHERE contains(lower(full_name), 'holdings') OR contains(lower(organization), 'holdings') OR contains(lower(email), 'holdings')""",
    "case_roster": """SELECT l.case_id, l.person_id, l.role_in_case, p.full_name, p.role FROM (SELECT DISTINCT * FROM case_people) l JOIN (SELECT DISTINCT * FROM people) p ON p.id = l.person_id""",
    "roster_order": """SELECT case_id, person_id, row_number() OVER (PARTITION BY case_id ORDER BY translate(role_in_case, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NULLS FIRST, translate(full_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NULLS FIRST, person_id) AS place
        FROM (SELECT DISTINCT * FROM case_people) l JOIN (SELECT DISTINCT * FROM people) p ON p.id = l.person_id""",
    "people_by_name": "SELECT id, row_number() OVER (ORDER BY translate(full_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NULLS FIRST, id) AS place FROM (SELECT DISTINCT id, full_name FROM people)",
    "case_lookup": """WITH k AS (SELECT DISTINCT case_id AS id FROM files WHERE case_id IS NOT NULL), a AS (SELECT id FROM k UNION ALL SELECT 'no-' || id FROM k)
        SELECT a.id, reference, title, c.id IS NOT NULL AS found FROM a LEFT JOIN (SELECT DISTINCT * FROM cases) c ON c.id = a.id""",
    "sheets_with_case": "SELECT v.id, v.title, v.case_id, c.reference AS case_reference, c.title AS case_title FROM (SELECT DISTINCT * FROM conversations) v LEFT JOIN (SELECT DISTINCT * FROM cases) c ON c.id = v.case_id",
    "events_with_case": "SELECT f.id, file_name AS title, index_status AS kind, f.case_id, c.reference AS case_reference, c.title AS case_title FROM (SELECT DISTINCT * FROM files) f LEFT JOIN (SELECT DISTINCT * FROM cases) c ON c.id = f.case_id",
    "merge_events": """WITH f AS (SELECT DISTINCT * FROM files)
        SELECT id, CASE WHEN id[1] = 'a' THEN 'Re: ' || file_name ELSE file_name END AS title, case_id, CASE WHEN id[1] = 'a' THEN 'Deadline' ELSE index_status END AS kind, created_at AS starts_at, created_at FROM f
        UNION ALL SELECT 'new-' || id, 'Re: ' || file_name, case_id, 'Deadline', created_at, TIMESTAMP '2022-06-15 12:00:00' FROM f WHERE id[1] = 'd' AND created_at IS NOT NULL""",
    "merge_sheets": """WITH v AS (SELECT DISTINCT * FROM conversations)
        SELECT id, title, 200 AS rows, 26 AS cols, CASE WHEN id[1] = 'a' THEN '{"A1": "1"}' ELSE '{}' END AS cells, CASE WHEN id[1] = 'a' THEN TIMESTAMP '2022-06-15 12:00:00' ELSE updated_at END AS updated_at FROM v
        UNION ALL SELECT 'new-' || id, NULL, 200, 26, '{}', TIMESTAMP '2022-06-15 12:00:00' FROM v WHERE id[1] = 'c'""",
    "case_files": "SELECT f.id, f.case_id, c.reference AS case_reference FROM (SELECT DISTINCT * FROM files) f JOIN (SELECT DISTINCT * FROM cases) c ON c.id = f.case_id WHERE c.status = 'Open'",
    "file_list_filtered": """SELECT f.id, file_name, mime, size_bytes, index_status, f.case_id, c.reference AS case_reference, c.title AS case_title, f.created_at
        FROM (SELECT DISTINCT * FROM files) f LEFT JOIN (SELECT DISTINCT * FROM cases) c ON c.id = f.case_id WHERE contains(lower(file_name), 'lease')""",
    "recent_documents": """SELECT f.id, file_name, mime, size_bytes, index_status, f.case_id, c.reference AS case_reference, c.title AS case_title, f.created_at
        FROM (SELECT DISTINCT * FROM files) f LEFT JOIN (SELECT DISTINCT * FROM cases) c ON c.id = f.case_id ORDER BY f.created_at DESC NULLS LAST, f.id LIMIT 8""",
    "next_reference": r"""SELECT year, printf('%s-CV-%04d', year, top + 1) AS next_reference FROM (
        SELECT regexp_extract(reference, '^(\d{4})-CV-(\d+)', 1) AS year, max(CAST(regexp_extract(reference, '^(\d{4})-CV-(\d+)', 2) AS BIGINT)) AS top
        FROM cases WHERE regexp_matches(reference, '^\d{4}-CV-\d+') GROUP BY 1)""",
    "smallest_free_reference": r"""WITH u AS (SELECT DISTINCT reference[1:4] AS year, CAST(regexp_extract(reference, '^(\d{4})-CV-0*(\d+)$', 2) AS BIGINT) AS n FROM cases WHERE regexp_matches(reference, '^\d{4}-CV-\d+$')),
        c AS (SELECT year, n + 1 AS i FROM u UNION SELECT year, 1 FROM u)
        SELECT year, min(i) AS free_number FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.year = c.year AND u.n = c.i) GROUP BY year""",
    "conversation_list": "SELECT id, title, case_id, updated_at, (SELECT count(DISTINCT m.id) FROM messages m WHERE m.conversation_id = c.id) AS message_count FROM (SELECT DISTINCT * FROM conversations) c",
    "recent_history": """SELECT conversation_id, id, role, content, back FROM (
        SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC, id DESC) AS back FROM (SELECT DISTINCT ON (id) * FROM messages) WHERE role IN ('user', 'assistant') AND coalesce(error, '') = '') WHERE back <= 12""",
    "prompts": """WITH q AS (SELECT DISTINCT id AS conversation_id, title FROM conversations WHERE title <> ''),
        h AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC, id DESC) AS back FROM (SELECT DISTINCT ON (id) * FROM messages) WHERE role IN ('user', 'assistant') AND coalesce(error, '') = '')
        SELECT conversation_id, 0 AS place, 'system' AS role, 'Answer from the documents.' AS content FROM q UNION ALL SELECT conversation_id, 13 - back, role, content FROM h WHERE back <= 12 AND conversation_id IN (SELECT conversation_id FROM q)
        UNION ALL SELECT conversation_id, 13, 'user', title FROM q""",
    "auto_title": """SELECT c.id, coalesce(trim(f.first[1:60]), c.title) AS title FROM (SELECT DISTINCT * FROM conversations) c
        LEFT JOIN (SELECT conversation_id, arg_min(content, (seq, id)) AS first FROM messages WHERE lower(trim(role)) = 'user' GROUP BY 1) f ON f.conversation_id = c.id
        WHERE coalesce(c.title, '') IN ('', 'New conversation', 'Untitled')""",
    "duplicate_files": "SELECT checksum, count(DISTINCT id) AS n, min(id) AS first_id FROM files WHERE checksum IS NOT NULL GROUP BY checksum HAVING count(DISTINCT id) > 1",
    "table_search": """SELECT id, full_name, organization FROM (SELECT DISTINCT * FROM people)
        WHERE contains(lower(full_name), 'plc') OR contains(lower(organization), 'plc') OR contains(lower(role), 'plc') OR contains(lower(email), 'plc')""",
    "table_page": "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40 OFFSET 40",
    "events_window": "SELECT event_id, ts, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'",
    "upcoming_events": "SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 40",
    "events_by_day": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "month_grid": """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) AS month FROM events), n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
        SELECT CAST(month AS VARCHAR) AS month, cell, CAST(CAST(date_trunc('week', month) AS DATE) + CAST(cell AS INTEGER) AS VARCHAR) AS day, coalesce(n.n, 0) AS n FROM m, range(42) r(cell) LEFT JOIN n ON n.day = CAST(date_trunc('week', month) AS DATE) + CAST(cell AS INTEGER)""",
    "merge_cases": """SELECT id, CASE WHEN id[1] = 'a' THEN reference || '-X' ELSE reference END AS reference, CASE WHEN id[1] = 'c' THEN 'Re: ' || title ELSE title END AS title,
        CASE WHEN id[1] = 'c' THEN 'Open' WHEN id[1] IN ('a', 'b') THEN 'Closed' ELSE status END AS status,
        CASE WHEN id[1] = 'c' THEN NULL WHEN id[1] IN ('a', 'b') THEN CASE WHEN status = 'Closed' THEN coalesce(closed_at, TIMESTAMP '2022-06-15 12:00:00') ELSE TIMESTAMP '2022-06-15 12:00:00' END ELSE closed_at END AS closed_at,
        CASE WHEN id[1] IN ('a', 'b', 'c') THEN TIMESTAMP '2022-06-15 12:00:00' ELSE updated_at END AS updated_at FROM (SELECT DISTINCT * FROM cases)""",
    "delete_case_files": f"SELECT * REPLACE (CASE WHEN case_id IN {GONE_SQL} THEN NULL ELSE case_id END AS case_id) FROM (SELECT DISTINCT * FROM files)",
    "delete_case_conversations": f"SELECT * REPLACE (CASE WHEN case_id IN {GONE_SQL} THEN NULL ELSE case_id END AS case_id) FROM (SELECT DISTINCT * FROM conversations)",
    "delete_case_links": f"SELECT DISTINCT * FROM case_people WHERE case_id NOT IN {GONE_SQL}",
    "reconcile_index": """SELECT DISTINCT document_id, 'remove' AS action FROM extracted WHERE document_id NOT IN (SELECT id FROM files WHERE index_status = 'Ready')
        UNION ALL SELECT DISTINCT id, 'fail' FROM files WHERE index_status = 'Ready' AND id NOT IN (SELECT document_id FROM extracted)""",
    "stale_vectors": """SELECT DISTINCT f.id AS document_id FROM files f LEFT JOIN extracted e ON e.document_id = f.id WHERE f.index_status = 'Ready' AND (e.document_id IS NULL OR length(e.text) % 3 = 0)""",
    "message_citations": """WITH m AS (SELECT DISTINCT ON (id) id, TRY_CAST(citations AS JSON) AS j FROM messages), x AS (SELECT id, unnest(range(1, CAST(json_array_length(j) AS BIGINT) + 1)) AS n, j FROM m WHERE json_type(j) = 'ARRAY')
        SELECT id, n, j[n - 1] ->> 'chunkId' AS chunk_id, j[n - 1] ->> 'documentId' AS document_id, CAST(j[n - 1] ->> 'page' AS BIGINT) AS page, CAST(j[n - 1] ->> 'score' AS DOUBLE) AS score FROM x""",
}
SQL["case_list_filtered"] = SQL["case_list_counts"] + " WHERE status = 'Open' AND (contains(lower(title), 'warehouse') OR contains(lower(reference), 'warehouse') OR contains(lower(c.description), 'warehouse'))"
