"""The tree of cases and what is filed under them: nodes, ancestors, filters, mentions, ranked lookup.

Nodes are rows (id, node_key, kind, label, parent_id, depth, ordinal, status, detail, case_id, document_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.operators.catalog import once
from docketry.operators.ordering import Desc, numbered
from docketry.session import cut

KINDS = ["case", "document", "person", "sheet", "event"]
MENTION = r"(?<![\w.@-])@([A-Za-z0-9][A-Za-z0-9._/-]*)"


def tree_nodes(cases: DataFrame, files: DataFrame, case_people: DataFrame, people: DataFrame, sheets: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """All nodes without their ordinal: cases by newest change, documents by newest import, one person node per case by name,
    sheets (id, title, case_id, rows, cols, updated_at) by newest change and events (id, title, case_id, kind, starts_at) by newest start, where given.

    The key of a filed node is the case reference and its own name in lower case; an unfiled document has its name alone and
    hangs off the root. Columns sort_time and sort_text hold what orders a kind.
    """
    c = once(cases).select("id", "reference", "title", "status", "updated_at")
    ref = c.select(F.col("id").alias("case_id"), F.lower("reference").alias("ref"))
    none = F.lit(None).cast("string")
    case_nodes = c.select(
        F.concat(F.lit("case:"), "id").alias("id"), F.lower("reference").alias("node_key"), F.lit("case").alias("kind"), F.col("title").alias("label"), none.alias("parent_id"), F.lit(0).alias("depth"),
        "status", F.col("reference").alias("detail"), F.col("id").alias("case_id"), none.alias("document_id"), F.col("updated_at").alias("sort_time"), none.alias("sort_text"),
    )
    d = once(files).join(ref, "case_id", "left")
    filed = F.col("case_id").isNotNull()
    doc_nodes = d.select(
        F.concat(F.lit("document:"), "id").alias("id"), F.when(F.col("ref").isNotNull(), F.concat("ref", F.lit("/"), F.lower("file_name"))).otherwise(F.lower("file_name")).alias("node_key"), F.lit("document").alias("kind"),
        F.col("file_name").alias("label"), F.when(filed, F.concat(F.lit("case:"), "case_id")).alias("parent_id"), F.when(filed, 1).otherwise(0).alias("depth"),
        F.col("index_status").alias("status"), F.col("mime").alias("detail"), "case_id", F.col("id").alias("document_id"), F.col("created_at").alias("sort_time"), none.alias("sort_text"),
    )
    p = case_people.dropDuplicates(["case_id", "person_id"]).join(once(people).select(F.col("id").alias("person_id"), "full_name", "role", "organization"), "person_id").join(ref, "case_id", "left")
    person_nodes = p.select(
        F.concat(F.lit("person:"), "person_id", F.lit(":"), "case_id").alias("id"), F.when(F.col("ref").isNotNull(), F.concat("ref", F.lit("/"), "person_id")).otherwise(F.lower("person_id")).alias("node_key"), F.lit("person").alias("kind"),
        F.col("full_name").alias("label"), F.concat(F.lit("case:"), "case_id").alias("parent_id"), F.lit(1).alias("depth"),
        F.coalesce(F.nullif("role_in_case", F.lit("")), "role").alias("status"), F.nullif("organization", F.lit("")).alias("detail"), "case_id", none.alias("document_id"), F.lit(None).cast("timestamp_ntz").alias("sort_time"), F.col("full_name").alias("sort_text"),
    )
    out = case_nodes.unionByName(doc_nodes).unionByName(person_nodes)
    if sheets is not None:
        size = F.concat(F.col("rows").cast("string"), F.lit(" x "), F.col("cols").cast("string"))
        out = out.unionByName(_filed(once(sheets).join(ref, "case_id", "left"), "sheet", size, none, "updated_at"))
    if events is not None:
        out = out.unionByName(_filed(once(events).join(ref, "case_id", "left"), "event", F.col("kind"), F.col("starts_at").cast("string"), "starts_at"))
    return out


def _filed(rows: DataFrame, kind: str, status: Column, detail: Column, time: str) -> DataFrame:
    """Nodes of titled rows that may hang off a case."""
    filed = F.col("case_id").isNotNull()
    leaf = F.lower("title")
    return rows.select(
        F.concat(F.lit(f"{kind}:"), "id").alias("id"), F.when(F.col("ref").isNotNull(), F.concat("ref", F.lit("/"), leaf)).otherwise(leaf).alias("node_key"), F.lit(kind).alias("kind"), F.col("title").alias("label"),
        F.when(filed, F.concat(F.lit("case:"), "case_id")).alias("parent_id"), F.when(filed, 1).otherwise(0).alias("depth"), status.alias("status"), detail.alias("detail"), "case_id",
        F.lit(None).cast("string").alias("document_id"), F.col(time).alias("sort_time"), F.lit(None).cast("string").alias("sort_text"),
    )


def kind_rank(kind: str = "kind") -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))


def case_tree(nodes: DataFrame) -> DataFrame:
    """Nodes with their ordinal: kinds in fixed order, inside a kind newest first or by name, then by id."""
    return numbered(nodes, [kind_rank(), Desc(F.col("sort_time")), F.col("sort_text"), F.col("id")]).drop("sort_time", "sort_text")


def counts_by_kind(nodes: DataFrame) -> DataFrame:
    """One row with a column per kind, 0 where there is none."""
    return nodes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def _contains(c: str, text: str) -> Column:
    return F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text)), F.lit(False))


def filter_tree(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes that contain the text in label, key, status or detail, with their parents (the tree is two deep); blank text keeps all."""
    q = text.strip().lower()
    if not q:
        return nodes
    hits = nodes.filter(_contains("label", q) | _contains("node_key", q) | _contains("status", q) | _contains("detail", q))
    ids = hits.select("id").unionByName(hits.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi")


def ancestors(nodes: DataFrame) -> DataFrame:
    """id, ancestor, steps: every ancestor of every node, nearest first; each round doubles the reach until none is added. A circle of parents raises ValueError."""
    out, reach = cut(nodes.filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("steps"))), 1
    while True:
        if not out.filter("id = ancestor").isEmpty():
            raise ValueError("a node is its own ancestor")
        up = out.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("steps").alias("more"))
        new = cut(out.filter(F.col("steps") == reach).join(up, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps")))
        if new.isEmpty():
            return out
        out, reach = cut(out.unionByName(new)), 2 * reach


def visible(nodes: DataFrame, collapsed: DataFrame, hidden_kinds: list[str] | None = None) -> DataFrame:
    """Rows of the open tree with their sort path (parent's ordinal, own ordinal): children of collapsed nodes and of nodes filtered out do not show."""
    shown = nodes.filter(~F.col("kind").isin(hidden_kinds)) if hidden_kinds else nodes
    parent = shown.select(F.col("id").alias("parent_id"), F.col("ordinal").alias("parent_ordinal"))
    roots = shown.filter("parent_id IS NULL").select("id", "kind", "label", F.col("ordinal").alias("path_a"), F.lit(-1).cast("long").alias("path_b"))
    open_ = shown.join(parent, "parent_id").join(collapsed.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    return roots.unionByName(open_.select("id", "kind", "label", F.col("parent_ordinal").alias("path_a"), F.col("ordinal").alias("path_b")))


def mentions(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, place (from 1), handle (lower case) of each @mention; an @ after a letter, digit, point, hyphen or @ is none."""
    found = F.transform(F.regexp_extract_all(column, F.lit(MENTION), F.lit(1)), lambda m: F.lower(m))
    return texts.select(key, F.posexplode(found).alias("p", "handle")).select(key, (F.col("p") + 1).alias("place"), "handle")


def mentioned_documents(found: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, document_id, first_place: documents named by mentions, each once, with where it is first named; a case names none."""
    docs = nodes.filter("document_id IS NOT NULL").select(F.lower("node_key").alias("handle"), "document_id")
    return found.join(docs, "handle").groupBy(key, "document_id").agg(F.min("place").alias("first_place"))


def segments(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, place, kind (text or mention), value: parts whose values put together give the text back, whatever signs it holds."""
    between = F.split(column, MENTION, -1)
    found = F.regexp_extract_all(column, F.lit(MENTION), F.lit(0))
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    pairs = F.flatten(F.transform(between, lambda t, i: F.array(part("text", t), part("mention", F.get(found, i)))))
    out = texts.select(key, F.posexplode(F.filter(pairs, lambda x: x["value"] != "")).alias("p", "x"))
    return out.select(key, (F.col("p") + 1).alias("place"), "x.kind", "x.value")


def mention_spans(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, handle (lower case), start, end (characters from 0, the @ included) of each mention."""
    at = W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    placed = segments(texts, key, column).withColumn("end", F.sum(F.length("value")).over(at))
    return placed.filter("kind = 'mention'").select(key, F.lower(F.substring("value", 2, 1 << 30)).alias("handle"), (F.col("end") - F.length("value")).alias("start"), "end")


def linked_segments(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments with the node their mention names (`node_id`; NULL for texts and for handles of no node); of nodes with one key the first in the tree."""
    first = nodes.groupBy(F.lower("node_key").alias("handle")).agg(F.min_by("id", "ordinal").alias("node_id"))
    return parts.withColumn("handle", F.when(F.col("kind") == "mention", F.lower(F.substring("value", 2, 1 << 30)))).join(first, "handle", "left").drop("handle")


def fragment_at(text: Column, caret: Column) -> Column:
    """What has been typed of a mention before the caret, without the @; NULL where no mention is being typed."""
    before = F.substring(text, F.lit(1), caret)
    open_ = r"(?<![\w.@-])@([A-Za-z0-9][A-Za-z0-9._/-]*)?$"
    return F.when(before.rlike(open_), F.regexp_extract(before, open_, 1))


def row_nodes(rows: DataFrame, nodes: DataFrame, kind: str, key: str = "id") -> DataFrame:
    """Table rows with `node_id`: the node of that kind for the row's key, of several the last in the tree; NULL without one."""
    own = nodes.filter(F.col("kind") == kind).select(target(F.col("id"))["key"].alias("__key"), "id", "ordinal").groupBy("__key").agg(F.max_by("id", "ordinal").alias("node_id"))
    return rows.join(own, F.col(key) == F.col("__key"), "left").drop("__key")


# Commands that begin with a slash, and what they are expanded to.
COMMANDS = [("summarize", "Summarize {}"), ("compare", "Compare {} with "), ("dates", "List every date mentioned in {}"), ("draft", "Draft a letter about {}")]


def slash_commands(typed: DataFrame, key: str, column: str, commands: DataFrame) -> DataFrame:
    """key, name, expanded: the commands (`commands`: name, template) whose name begins with what stands behind the slash at the start of the text; the words behind it take the place of {} in the template. Commands meet texts by their own beginnings, an equality."""
    words = F.regexp_extract(column, r"^/(\S*)", 1)
    asked = typed.filter(F.col(column).startswith("/")).select(key, F.lower(words).alias("q"), F.trim(F.regexp_replace(column, r"^/\S*", "")).alias("rest"))
    starts = commands.select("name", "template", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substring(F.lower("name"), F.lit(1), n))).alias("q"))
    return asked.join(starts, "q").select(key, "name", F.replace("template", F.lit("{}"), F.col("rest")).alias("expanded"))


def mention_score(q: Column) -> Column:
    """How well a node fits what was typed; NULL if not at all."""
    k, t = F.lower("node_key"), F.lower("label")
    base = (
        F.when(k == q, F.lit(100.0)).when(F.startswith(k, q), 80 - F.length(k) * 0.1).when(F.startswith(t, q), 70 - F.length(t) * 0.1)
        .when(F.contains(k, q), 50 - F.length(k) * 0.1).when(F.contains(t, q), 40 - F.length(t) * 0.1)
    )
    return base + F.when(F.col("kind") == "document", 5.0).when(F.col("kind") == "case", -2.0).otherwise(0.0)


def rank_mentions(nodes: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """The best nodes for what was typed, with the text to insert; ties in tree order; blank text or no limit gives none."""
    q = text.strip().lower()
    scored = nodes.withColumn("score", F.round(mention_score(F.lit(q)), 6)).filter(F.col("score").isNotNull() & F.lit(bool(q) and limit > 0))
    return scored.orderBy(F.desc("score"), "ordinal").limit(max(limit, 0)).select("id", "kind", "node_key", "score", F.concat(F.lit("@"), "node_key", F.lit(" ")).alias("insert"))


def quick_find(nodes: DataFrame, text: str, per_kind: int = 5) -> DataFrame:
    """The best few nodes of every kind: kind_rank, kind, place, id, score."""
    q = text.strip().lower()
    scored = nodes.withColumn("score", F.round(mention_score(F.lit(q)), 6)).filter(F.col("score").isNotNull() & F.lit(bool(q)))
    top = scored.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "ordinal"))).filter(F.col("place") <= per_kind)
    return top.select(kind_rank().cast("int").alias("kind_rank"), "kind", "place", "id", "score")


def resolve(nodes: DataFrame, fragments: DataFrame) -> DataFrame:
    """fragment, id, more: the first node whose key starts with the fragment, or failing that whose last part does; and how many others do.

    Keys are cut to the lengths the fragments have and meet them whole, an equi-join for many fragments at once.
    """
    f = fragments.select(F.lower(F.trim("fragment")).alias("q"), "fragment").filter("q <> ''")
    lengths = f.agg(F.collect_set(F.length("q")).alias("lengths"))  # one row: the different lengths
    k = F.lower("node_key")
    keys = nodes.select("id", "ordinal", k.alias("k"), F.lit(1).alias("step"))
    leaves = nodes.filter(k.contains("/")).select("id", "ordinal", F.element_at(F.split(k, "/"), -1).alias("k"), F.lit(2).alias("step"))
    cuts = F.transform(F.filter("lengths", lambda n: n <= F.length("k")), lambda n: F.substring(F.col("k"), F.lit(1), n))
    met = keys.unionByName(leaves).crossJoin(F.broadcast(lengths)).select("id", "ordinal", "k", "step", F.explode(cuts).alias("q")).join(f, "q")
    best = met.groupBy("fragment", "step").agg(F.min_by("id", F.struct("k", "ordinal")).alias("id"), (F.count("*") - 1).alias("more"))
    return best.groupBy("fragment").agg(F.min_by(F.struct("id", "more"), "step").alias("b")).select("fragment", "b.id", "b.more")


def target(node_id: Column) -> Column:
    """What a node id opens: kind and key, of a person the person's."""
    parts = F.split(node_id, ":")
    return F.struct(F.get(parts, 0).alias("kind"), F.get(parts, 1).alias("key"))


def case_reference(node_key: Column) -> Column:
    return F.split_part(node_key, F.lit("/"), F.lit(1))
