"""Queries over the tree of cases: nodes, filters, mentions, ranked lookup, graph layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import graph, tree
from docketry.plans.catalogue import case_events, sheets
from docketry.session import cut
from docketry.session import read_table as t


def _nodes(s, b):
    return cut(tree.case_tree(tree.tree_nodes(*[t(s, b, x) for x in ("cases", "files", "case_people", "people")])))


def _notes(s, b):
    """Texts that mention every filed document, its case, and an address that is no mention."""
    n = _nodes(s, b).filter("kind = 'document' AND case_id IS NOT NULL")
    ref = tree.case_reference(F.col("node_key"))
    return n.select(F.col("id").alias("note"), F.concat(F.lit("Compare @"), F.upper("node_key"), F.lit(" with @"), ref, F.lit(", mail a.b@"), ref, F.lit(" or @"), "node_key", F.lit(" now")).alias("text"))


def _collapsed(n):
    return n.filter("kind = 'case' AND ordinal % 3 = 0").select("id")


def _fragments(n):
    return n.filter("ordinal % 50 = 0").select(F.substring("node_key", 1, 9).alias("fragment")).unionByName(n.filter("ordinal % 50 = 0 AND kind = 'document'").select(F.substring("label", 1, 5).alias("fragment"))).distinct()


QUERIES = {
    "case_tree": lambda s, b: _nodes(s, b).select("id", "node_key", "kind", "label", "parent_id", "depth", "ordinal", "status", "detail"),
    "tree_counts": lambda s, b: tree.counts_by_kind(tree.tree_nodes(*[t(s, b, x) for x in ("cases", "files", "case_people", "people")])),
    "tree_filter": lambda s, b: tree.filter_tree(_nodes(s, b), "Witness").select("id", "ordinal"),
    "tree_ancestors": lambda s, b: tree.ancestors(_nodes(s, b)),
    "tree_visible": lambda s, b: tree.visible(n := _nodes(s, b), _collapsed(n), ["person"]),
    "mention_parse": lambda s, b: tree.mentions(t(s, b, "messages").dropDuplicates(["id"]), "id", "content"),
    "mention_docs": lambda s, b: tree.mentioned_documents(tree.mentions(_notes(s, b), "note", "text"), _nodes(s, b), "note"),
    "mention_segments": lambda s, b: tree.segments(_notes(s, b), "note", "text"),
    "mention_spans": lambda s, b: tree.mention_spans(t(s, b, "messages").dropDuplicates(["id"]), "id", "content"),
    "segment_texts": lambda s, b: tree.segments(t(s, b, "messages").dropDuplicates(["id"]), "id", "content").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "").alias("text")),
    "linked_mentions": lambda s, b: tree.linked_segments(tree.segments(_notes(s, b), "note", "text"), _nodes(s, b)).filter("kind = 'mention'").select("note", "place", "node_id"),
    "row_nodes": lambda s, b: tree.row_nodes(t(s, b, "files").dropDuplicates(["id"]).select("id", "file_name"), _nodes(s, b), "document"),
    "caret_fragments": lambda s, b: t(s, b, "messages").dropDuplicates(["id"]).select("id", tree.fragment_at(F.col("content"), F.instr("content", "@") + 3).alias("fragment")),
    "slash_commands": lambda s, b: tree.slash_commands(t(s, b, "messages").dropDuplicates(["id"]).select("id", F.concat(F.lit("/"), F.lower("content")).alias("text")), "id", "text", s.createDataFrame(tree.COMMANDS, "name string, template string")),
    "full_tree": lambda s, b: tree.case_tree(tree.tree_nodes(*[t(s, b, x) for x in ("cases", "files", "case_people", "people")], sheets(s, b), case_events(s, b))).select("id", "node_key", "kind", "label", "parent_id", "depth", "ordinal", "status"),
    "mention_rank": lambda s, b: tree.rank_mentions(_nodes(s, b), "lease", 100),
    "quick_find": lambda s, b: tree.quick_find(_nodes(s, b), "an"),
    "resolve_mention": lambda s, b: tree.resolve(n := _nodes(s, b), _fragments(n)),
    "node_targets": lambda s, b: tree.tree_nodes(*[t(s, b, x) for x in ("cases", "files", "case_people", "people")]).select("id", tree.target(F.col("id"))["kind"].alias("kind"), tree.target(F.col("id"))["key"].alias("key"), tree.case_reference(F.col("node_key")).alias("reference")),
    "case_graph": lambda s, b: graph.items(_nodes(s, b)),
    "case_graph_roots": lambda s, b: graph.roots(_nodes(s, b)),
    "case_graph_bounds": lambda s, b: graph.bounds(_nodes(s, b)),
    "case_graph_edges": lambda s, b: graph.edges(_nodes(s, b)).select("case_id", "source", "target", "path"),
}

_N = """c AS (SELECT DISTINCT * FROM cases), f AS (SELECT DISTINCT * FROM files), l AS (SELECT DISTINCT * FROM case_people), p AS (SELECT DISTINCT * FROM people),
u AS (
  SELECT 'case:' || id AS id, lower(reference) AS node_key, 'case' AS kind, title AS label, NULL AS parent_id, 0 AS depth, status, reference AS detail, id AS case_id, NULL AS document_id, 1 AS k, updated_at AS st, NULL AS sx FROM c
  UNION ALL SELECT 'document:' || f.id, CASE WHEN c.id IS NOT NULL THEN lower(c.reference) || '/' || lower(file_name) ELSE lower(file_name) END, 'document', file_name, 'case:' || f.case_id, CASE WHEN f.case_id IS NULL THEN 0 ELSE 1 END,
    index_status, mime, f.case_id, f.id, 2, f.created_at, NULL FROM f LEFT JOIN c ON c.id = f.case_id
  UNION ALL SELECT 'person:' || person_id || ':' || case_id, coalesce(lower(c.reference) || '/' || person_id, lower(person_id)), 'person', full_name, 'case:' || case_id, 1, coalesce(nullif(role_in_case, ''), role), nullif(organization, ''), case_id, NULL, 3, NULL, full_name
    FROM l JOIN p ON p.id = l.person_id LEFT JOIN c ON c.id = l.case_id),
n AS (SELECT *, row_number() OVER (ORDER BY k, st DESC NULLS LAST, sx NULLS FIRST, id) - 1 AS ordinal FROM u)"""
_NOTES = f"""notes AS (SELECT id AS note, 'Compare @' || upper(node_key) || ' with @' || split_part(node_key, '/', 1) || ', mail a.b@' || split_part(node_key, '/', 1) || ' or @' || node_key || ' now' AS text FROM n WHERE kind = 'document' AND case_id IS NOT NULL)"""
_SCORE = "CASE WHEN node_key = '{0}' THEN 100 WHEN starts_with(node_key, '{0}') THEN 80 - length(node_key) * 0.1 WHEN starts_with(lower(label), '{0}') THEN 70 - length(label) * 0.1 WHEN contains(node_key, '{0}') THEN 50 - length(node_key) * 0.1 WHEN contains(lower(label), '{0}') THEN 40 - length(label) * 0.1 END + CASE kind WHEN 'document' THEN 5 WHEN 'case' THEN -2 ELSE 0 END"
_MENTIONS = "list_transform(regexp_extract_all({0}, '(?:^|[^\\w.@-])@([A-Za-z0-9][A-Za-z0-9._/-]*)', 1), lambda m: lower(m))"
_G = """i AS (SELECT *, CASE kind WHEN 'document' THEN 2 WHEN 'person' THEN 3 END AS kr FROM n WHERE kind <> 'case' AND case_id IS NOT NULL),
g0 AS (SELECT case_id, kind, kr, count(*) AS m FROM i GROUP BY ALL),
g AS (SELECT *, coalesce(sum(m * 36 + 20) OVER (PARTITION BY case_id ORDER BY kr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM g0),
gy AS (SELECT *, (top + top + m * 36 - 8) / 2.0 - 14 AS y FROM g)"""

#: Where each mention begins, by looking for them one after the other.
_SPANS = """WITH RECURSIVE m AS (SELECT DISTINCT ON (id) id, content FROM messages WHERE content IS NOT NULL),
    h AS (SELECT id, content, regexp_extract_all(content, '(?:^|[^\\w.@-])@[A-Za-z0-9][A-Za-z0-9._/-]*') AS hs FROM m),
    r(id, content, hs, k, pos, handle) AS (SELECT id, content, hs, 0, 0, CAST(NULL AS VARCHAR) FROM h WHERE len(hs) > 0
      UNION ALL SELECT id, content, hs, k + 1, pos + strpos(substring(content, pos + 1), hs[k + 1]) - 1 + length(hs[k + 1]), hs[k + 1] FROM r WHERE k < len(hs))
    SELECT id, lower(handle[strpos(handle, '@') + 1:]) AS handle, pos - length(handle) + strpos(handle, '@') - 1 AS start, pos AS "end" FROM r WHERE k > 0"""

SQL = {
    "mention_spans": _SPANS,
    "segment_texts": "SELECT DISTINCT ON (id) id, content AS text FROM messages WHERE content <> ''",
    "linked_mentions": f"""WITH {_N}, {_NOTES}, h AS (SELECT note, {_MENTIONS.format('text')} AS h FROM notes), m AS (SELECT note, unnest(range(1, len(h) + 1)) AS k, unnest(h) AS handle FROM h)
        SELECT m.note, CAST(2 * k AS BIGINT) AS place, (SELECT arg_min(id, ordinal) FROM n WHERE n.node_key = m.handle) AS node_id FROM m""",
    "row_nodes": f"WITH {_N} SELECT f.id, f.file_name, 'document:' || f.id AS node_id FROM f",
    "caret_fragments": r"""SELECT id, CASE WHEN regexp_matches(x, '(?:^|[^\w.@-])@([A-Za-z0-9][A-Za-z0-9._/-]*)?$') THEN regexp_extract(x, '(?:^|[^\w.@-])@([A-Za-z0-9][A-Za-z0-9._/-]*)?$', 1) END AS fragment FROM (SELECT DISTINCT ON (id) id, content[1:strpos(content, '@') + 3] AS x FROM messages)""",
    "slash_commands": """WITH m AS (SELECT DISTINCT ON (id) id, lower(content) AS x FROM messages WHERE content IS NOT NULL), w AS (SELECT id, regexp_extract('/' || x, '^/(\\S*)', 1) AS q, x FROM m)
        SELECT id, name, replace(template, '{}', trim(regexp_replace('/' || x, '^/\\S*', ''))) AS expanded FROM w JOIN (VALUES ('summarize', 'Summarize {}'), ('compare', 'Compare {} with '), ('dates', 'List every date mentioned in {}'), ('draft', 'Draft a letter about {}')) c(name, template) ON starts_with(name, q)""",
    "full_tree": f"""WITH {_N.rsplit('n AS (SELECT', 1)[0]} x AS (SELECT * FROM u
        UNION ALL SELECT 'sheet:' || v.id, CASE WHEN c.id IS NOT NULL THEN lower(c.reference) || '/' || lower(v.title) ELSE lower(v.title) END, 'sheet', v.title, 'case:' || v.case_id, CASE WHEN v.case_id IS NULL THEN 0 ELSE 1 END, '200 x 26', NULL, v.case_id, NULL, 4, v.updated_at, NULL FROM (SELECT DISTINCT * FROM conversations) v LEFT JOIN c ON c.id = v.case_id
        UNION ALL SELECT 'event:' || f.id, CASE WHEN c.id IS NOT NULL THEN lower(c.reference) || '/' || lower(file_name) ELSE lower(file_name) END, 'event', file_name, 'case:' || f.case_id, CASE WHEN f.case_id IS NULL THEN 0 ELSE 1 END, index_status, NULL, f.case_id, NULL, 5, f.created_at, NULL FROM f LEFT JOIN c ON c.id = f.case_id)
        SELECT id, node_key, kind, label, parent_id, depth, row_number() OVER (ORDER BY k, st DESC NULLS LAST, sx NULLS FIRST, id) - 1 AS ordinal, status FROM x""",
    "case_tree": f"WITH {_N} SELECT id, node_key, kind, label, parent_id, depth, ordinal, status, detail FROM n",
    "tree_counts": f"WITH {_N} SELECT count(*) FILTER (kind = 'case') AS \"case\", count(*) FILTER (kind = 'document') AS document, count(*) FILTER (kind = 'person') AS person, 0 AS sheet, 0 AS event FROM n",
    "tree_filter": f"""WITH {_N}, h AS (SELECT * FROM n WHERE contains(lower(concat_ws(chr(1), label, node_key, status, detail)), 'witness'))
        SELECT id, ordinal FROM n WHERE id IN (SELECT id FROM h) OR id IN (SELECT parent_id FROM h)""",
    "tree_ancestors": f"WITH {_N} SELECT id, parent_id AS ancestor, 1 AS steps FROM n WHERE parent_id IS NOT NULL",
    "tree_visible": f"""WITH {_N}, v AS (SELECT * FROM n WHERE kind <> 'person') SELECT id, kind, label, ordinal AS path_a, -1 AS path_b FROM v WHERE parent_id IS NULL
        UNION ALL SELECT x.id, x.kind, x.label, y.ordinal, x.ordinal FROM v x JOIN v y ON y.id = x.parent_id WHERE NOT (y.kind = 'case' AND y.ordinal % 3 = 0)""",
    "mention_parse": f"""WITH m AS (SELECT id, {_MENTIONS.format('content')} AS h FROM (SELECT DISTINCT ON (id) * FROM messages)) SELECT id, unnest(range(1, len(h) + 1)) AS place, unnest(h) AS handle FROM m""",
    "mention_docs": f"""WITH {_N}, {_NOTES}, m AS (SELECT note, unnest(range(1, len(h) + 1)) AS place, unnest(h) AS handle FROM (SELECT note, {_MENTIONS.format('text')} AS h FROM notes))
        SELECT note, document_id, min(place) AS first_place FROM m JOIN n ON n.node_key = m.handle WHERE document_id IS NOT NULL GROUP BY ALL""",
    "mention_rank": f"""WITH {_N}, s AS (SELECT *, round({_SCORE.format('lease')}, 6) AS score FROM n) SELECT id, kind, node_key, score, '@' || node_key || ' ' AS "insert" FROM s WHERE score IS NOT NULL ORDER BY score DESC, ordinal LIMIT 100""",
    "quick_find": f"""WITH {_N}, s AS (SELECT *, round({_SCORE.format('an')}, 6) AS score FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, ordinal) AS place FROM s WHERE score IS NOT NULL)
        SELECT k AS kind_rank, kind, place, id, score FROM r WHERE place <= 5""",
    "resolve_mention": f"""WITH {_N}, fr AS (SELECT DISTINCT node_key[1:9] AS fragment FROM n WHERE ordinal % 50 = 0 UNION SELECT label[1:5] FROM n WHERE ordinal % 50 = 0 AND kind = 'document'),
        ks AS (SELECT id, ordinal, node_key AS k, 1 AS step FROM n UNION ALL SELECT id, ordinal, string_split(node_key, '/')[-1], 2 FROM n WHERE contains(node_key, '/')),
        m AS (SELECT fragment, step, arg_min(id, (k, ordinal)) AS id, count(*) - 1 AS more FROM fr JOIN ks ON starts_with(k, lower(trim(fragment))) WHERE trim(fragment) <> '' GROUP BY ALL)
        SELECT fragment, arg_min(id, step) AS id, arg_min(more, step) AS more FROM m GROUP BY fragment""",
    "node_targets": f"WITH {_N} SELECT id, string_split(id, ':')[1] AS kind, string_split(id, ':')[2] AS key, split_part(node_key, '/', 1) AS reference FROM n",
    "case_graph": f"""WITH {_N}, {_G} SELECT i.case_id, i.id, i.kind, CASE WHEN length(label) > 24 THEN label[1:23] || '…' ELSE label END AS label, 412 AS x,
        CAST(g.top + (row_number() OVER (PARTITION BY i.case_id, i.kind ORDER BY ordinal) - 1) * 36 AS DOUBLE) AS y FROM i JOIN g ON g.case_id = i.case_id AND g.kind = i.kind""",
    "case_graph_roots": f"""WITH {_N}, {_G}, r AS (SELECT case_id, (arg_min(y, kr) + arg_max(y, kr)) / 2.0 AS y, CAST(max(top + m * 36) - 8 AS DOUBLE) AS height, CAST(sum(m) AS BIGINT) AS connections FROM gy GROUP BY case_id)
        SELECT n.case_id, CASE WHEN length(detail) > 20 THEN detail[1:19] || '…' ELSE detail END AS label, y, height, connections FROM n JOIN r ON r.case_id = n.case_id WHERE kind = 'case'""",
    "case_graph_bounds": f"""WITH {_N}, {_G}, r AS (SELECT case_id, (arg_min(y, kr) + arg_max(y, kr)) / 2.0 AS y, max(top + (m - 1) * 36) AS most FROM gy GROUP BY case_id)
        SELECT r.case_id, 602 AS width, least(0.0, r.y) AS top, greatest(CAST(most AS DOUBLE), r.y) + 28 AS bottom FROM r""",
    "case_graph_edges": f"""WITH {_N}, {_G}, r AS (SELECT case_id, (arg_min(y, kr) + arg_max(y, kr)) / 2.0 AS y FROM gy GROUP BY case_id),
        k AS (SELECT i.case_id, i.kind, i.id, CAST(g.top + (row_number() OVER (PARTITION BY i.case_id, i.kind ORDER BY ordinal) - 1) * 36 AS DOUBLE) AS y, g.y AS gy FROM i JOIN gy g ON g.case_id = i.case_id AND g.kind = i.kind),
        e AS (SELECT case_id, 'case:' || case_id AS source, 'group:' || gy.kind AS target, 170.0 AS x1, CAST(r.y + 14 AS DOUBLE) AS y1, 226.0 AS x2, CAST(gy.y + 14 AS DOUBLE) AS y2 FROM gy JOIN r USING (case_id) JOIN (SELECT case_id FROM n WHERE kind = 'case') c USING (case_id)
          UNION ALL SELECT case_id, 'group:' || kind, id, 356.0, CAST(gy + 14 AS DOUBLE), 412.0, CAST(y + 14 AS DOUBLE) FROM k)
        SELECT case_id, source, target, 'M' || x1 || ',' || y1 || ' C' || CAST((x1 + x2) / 2 AS DECIMAL(9,1)) || ',' || y1 || ' ' || CAST((x1 + x2) / 2 AS DECIMAL(9,1)) || ',' || y2 || ' ' || x2 || ',' || y2 AS path FROM e""",
}
