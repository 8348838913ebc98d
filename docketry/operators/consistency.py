"""Writes as pure functions: upserts, deletes with referential actions, reconciliation of two stores.

A catalogue is a set of DataFrames; an operator returns the changed ones. Writing them to a new folder and switching the
reader to it afterwards makes the change atomic (`docketry.sources.store`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.catalog import once
from docketry.operators.ordering import numbered
from docketry.session import cut


def merge(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """`changes` replace rows of the same key and add the rest. NULL in a change keeps the old value; repeated changes of one key: the last by its own order is undefined, give one."""
    rest = [c for c in current.columns if c != key]
    new = changes.dropDuplicates([key]).select(F.col(key), *[(F.col(c) if c in changes.columns else F.lit(None)).cast(current.schema[c].dataType).alias(f"new_{c}") for c in rest])
    return once(current, key).join(new, key, "full_outer").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in rest])


def upsert_cases(cases: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Cases after a set of edits (id, reference, title, category_id, status, description).

    closed_at is set on the way to Closed, cleared on reopening, kept while closed; created_at and whatever an edit leaves
    NULL stay. Edits with a blank title are refused and change nothing. A new case without a reference gets the next free ones
    of the year of `now`, in the order of the ids.
    """
    at = F.lit(now).cast("timestamp_ntz")
    old = once(cases)
    new = changes.filter(F.trim("title") != "").dropDuplicates(["id"]).select("id", *[F.col(c).alias(f"new_{c}") for c in ("reference", "title", "category_id", "status", "description")], F.lit(True).alias("edited"))
    j = old.join(new, "id", "full_outer")
    status = F.coalesce("new_status", "status", F.lit("Open"))
    closed = F.when(F.col("edited").isNull(), F.col("closed_at")).when(status != "Closed", F.lit(None)).when(F.coalesce(F.col("status") == "Closed", F.lit(False)), F.coalesce("closed_at", at)).otherwise(at)
    j = j.withColumn("__reference", F.coalesce(F.when(F.trim("new_reference") != "", F.col("new_reference")), "reference"))
    year, tag = now[:4], "CV"
    blank = cut(j.filter("__reference IS NULL OR (reference IS NULL AND trim(__reference) = '')").select("id"))
    top = j.select(F.regexp_extract("__reference", rf"^{year}-{tag}-(\d+)", 1).alias("n")).filter("n <> ''").agg(F.coalesce(F.max(F.col("n").cast("long")), F.lit(0)).alias("top"))
    given = numbered(blank, [F.col("id")], "k", 1).crossJoin(F.broadcast(top)).select(F.col("id").alias("__id"), F.format_string(f"{year}-{tag}-%04d", F.col("top") + F.col("k")).alias("__given"))  # one row
    j = j.join(given, F.col("id") == F.col("__id"), "left")
    return j.select(
        "id", F.coalesce("__given", "__reference").alias("reference"), F.coalesce("new_title", "title").alias("title"),
        F.coalesce("new_category_id", "category_id").alias("category_id"), status.alias("status"), F.coalesce("new_description", "description").alias("description"),
        F.coalesce("opened_at", at).alias("opened_at"), closed.alias("closed_at"), F.coalesce("created_at", at).alias("created_at"), F.when(F.col("edited"), at).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upsert_events(events: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Events (id, title, case_id, kind, starts_at, ends_at, created_at) after a set of edits. Edits with a blank title or without a start are refused; a blank kind is `Deadline`; created_at stays."""
    kind = F.coalesce(F.when(F.trim("kind") != "", F.col("kind")), F.lit("Deadline"))
    good = changes.filter((F.trim("title") != "") & F.col("starts_at").isNotNull()).withColumn("kind", kind)
    out = merge(events, good.drop("created_at"))
    return out.withColumn("created_at", F.coalesce("created_at", F.lit(now).cast("timestamp_ntz")))


def upsert_sheets(sheets: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Sheets (id, title, case_id, rows, cols, cells, created_at, updated_at) after a set of edits. A new sheet has 200 rows, 26 columns and no cells; what an edit leaves NULL stays; an edit whose cells are no JSON is refused."""
    at = F.lit(now).cast("timestamp_ntz")
    good = changes.filter(F.col("cells").isNull() | F.try_parse_json("cells").isNotNull())
    out = merge(sheets, good.drop("created_at", "updated_at"))
    edited = good.select("id").distinct().withColumn("__edited", F.lit(True))
    full = out.join(edited, "id", "left").withColumns({"rows": F.coalesce("rows", F.lit(200)), "cols": F.coalesce("cols", F.lit(26)), "cells": F.coalesce("cells", F.lit("{}")), "created_at": F.coalesce("created_at", at)})
    return full.withColumn("updated_at", F.when(F.col("__edited"), at).otherwise(F.col("updated_at"))).drop("__edited")


# The categories a new catalogue starts with.
DEFAULT_CATEGORIES = [("Litigation", "Litigation", "#2563eb"), ("Corporate", "Corporate", "#16a34a"), ("Family", "Family", "#db2777"), ("Real estate", "Property", "#d97706"), ("Labour", "Employment", "#7c3aed")]


def seeded(categories: DataFrame, now: str) -> DataFrame:
    """The categories; where there are none yet, the default ones."""
    if not categories.isEmpty():
        return categories
    rows = categories.sparkSession.createDataFrame(DEFAULT_CATEGORIES, "name string, practice_area string, color string")
    new = rows.withColumns({"id": F.lower(F.replace("name", F.lit(" "), F.lit("-"))), "created_at": F.lit(now).cast("timestamp_ntz")})
    return new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in categories.schema])


def re_embedded(store: DataFrame, stale_documents: DataFrame, passages: DataFrame, embed) -> DataFrame:
    """The store (document_id, chunk_id, embedding) with the vectors of stale documents made anew by `embed` (passages in, chunk_id and embedding out); passages it gives no vector for keep their old one."""
    todo = passages.join(stale_documents.select("document_id").distinct(), "document_id", "left_semi")
    new = embed(todo).filter("embedding IS NOT NULL").select("chunk_id", F.col("embedding").alias("__new")).dropDuplicates(["chunk_id"])
    return store.join(new, "chunk_id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).select(*store.columns)


def delete_cases(gone: DataFrame, cases: DataFrame, files: DataFrame, conversations: DataFrame, case_people: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting cases (`gone`: id): their documents and conversations stay without a case, their links to people go."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()

    def unfiled(df: DataFrame) -> DataFrame:
        return df.join(ids, F.col("case_id") == F.col("__gone"), "left").withColumn("case_id", F.when(F.col("__gone").isNull(), F.col("case_id"))).drop("__gone")

    without = lambda df, key: df.join(ids, F.col(key) == F.col("__gone"), "left_anti")
    return {"cases": without(cases, "id"), "files": unfiled(files), "conversations": unfiled(conversations), "case_people": without(case_people, "case_id")}


def delete_conversations(gone: DataFrame, conversations: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """Conversations go with their messages."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()
    return {"conversations": conversations.join(ids, F.col("id") == F.col("__gone"), "left_anti"), "messages": messages.join(ids, F.col("conversation_id") == F.col("__gone"), "left_anti")}


def reconcile(files: DataFrame, stored: DataFrame) -> DataFrame:
    """What to repair between the catalogue and a store of indexed documents (`stored`: document_id): action `remove` for stored documents that are not Ready, `fail` for Ready ones the store lacks."""
    ready = once(files).filter("index_status = 'Ready'").select(F.col("id").alias("document_id"))
    have = stored.select("document_id").filter("document_id IS NOT NULL").distinct()
    return have.join(ready, "document_id", "left_anti").withColumn("action", F.lit("remove")).unionByName(ready.join(have, "document_id", "left_anti").withColumn("action", F.lit("fail")))


def replace_documents(vectors: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """The store after some documents came in again: all old rows of theirs go, the new ones come in."""
    return vectors.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stale(files: DataFrame, recorded: DataFrame, format_id: str) -> DataFrame:
    """Ready documents whose stored vectors were made by another recipe or model than `format_id` (`recorded`: document_id, format_id)."""
    ready = once(files).filter("index_status = 'Ready'").select(F.col("id").alias("document_id"))
    return ready.join(recorded, "document_id", "left").filter(~F.col("format_id").eqNullSafe(F.lit(format_id))).select("document_id")
