"""Hybrid retrieval: fuse ranked lists by reciprocal rank, look the hits up, build context and citations, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import embed_input, snippet, task_prefix
from docketry.session import cut, few

RRF_K = 60


def over_fetch(limit: int) -> int:
    """How many hits of each list go into the fusion."""
    return max(4 * limit, 20)


def rrf(lists: list[DataFrame], limit: int = 8) -> DataFrame:
    """Fuse lists of (query_id, chunk_id, rank from 1): sum of 1 / (60 + rank), scaled by the best of each question; query_id, chunk_id, score, rank.

    A missing or empty list leaves the others as they are. Ties by chunk_id.
    """
    parts = [x.select("query_id", F.col("chunk_id"), (1.0 / (RRF_K + F.col("rank"))).alias("part")) for x in lists]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    fused = all_parts.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")
    top = fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return top.withColumn("score", F.col("score") / F.max("score").over(W.partitionBy("query_id")))


def hydrate(hits: DataFrame, passages: DataFrame, documents: DataFrame, cases: DataFrame) -> DataFrame:
    """Hits with text, page, document and case. Hits whose passage or document is gone are dropped after ranking, so fewer rows may come out.

    The hits are written first: few of them go to where the texts are, which then stay in place.
    """
    hits = few(cut(hits))
    named = documents.select("document_id", "document_name", "case_id")
    where = cases.select(F.col("id").alias("case_id"), F.col("reference").alias("case_reference")).dropDuplicates(["case_id"])
    return hits.join(passages, "chunk_id").join(named, "document_id").join(where, "case_id", "left")


def citations(hits: DataFrame) -> DataFrame:
    """query_id, n, chunk_id, document_id, page, score, snippet; n counts the hits of a question by rank without gaps."""
    n = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return hits.select("query_id", n.alias("n"), "chunk_id", "document_id", "page", "score", snippet(F.col("text")).alias("snippet"))


def context_blocks(hits: DataFrame, nothing: str = "No matching passages were found.") -> DataFrame:
    """query_id, context: the numbered passages of a question, each under its document and place."""
    place = F.when(F.col("case_reference").isNotNull() & F.col("page").isNotNull(), F.concat("case_reference", F.lit(", p. "), F.col("page").cast("string")))
    place = place.when(F.col("case_reference").isNotNull(), F.col("case_reference")).when(F.col("page").isNotNull(), F.concat(F.lit("p. "), F.col("page").cast("string"))).otherwise("page unknown")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    block = hits.select("query_id", n.alias("n"), F.concat(F.lit("["), n.cast("string"), F.lit("] "), "document_name", F.lit(" ("), place, F.lit(")\n"), "text").alias("b"))
    return block.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 3, asked: DataFrame | None = None) -> DataFrame:
    """questions, recall at k, MRR. `ranked`: query_id, chunk_id, rank; `relevant`: query_id, chunk_id. A question counts with its best relevant hit, with 0 if it has none.

    `asked` (query_id): the questions that count; without it those of `relevant`. With it, `relevant` need hold hits only.
    """
    best = ranked.join(relevant, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    all_ = (relevant if asked is None else asked).select("query_id").distinct().join(best, "query_id", "left")
    return all_.agg(F.count("*").alias("questions"), F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def context_only_recall(ranked: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """Recall at k over questions that only the context of a passage answers (`targets`: query_id, chunk_id, in_text): those whose passage does not hold the answer itself. 0 for a question whose target is not found; NULL without such questions."""
    only = targets.filter("NOT in_text").select("query_id", "chunk_id")
    hit = only.join(ranked.filter(F.col("rank") <= k), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.max(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit")).agg(F.count("*").alias("questions"), F.avg("hit").alias("recall"))


def distinct_documents(hits: DataFrame) -> DataFrame:
    """query_id, n_documents: from how many documents the hits of a question come."""
    return hits.groupBy("query_id").agg(F.count_distinct("document_id").alias("n_documents"))


# The recipes of an embedding input: whether the task prefix and the context header go in.
RECIPES = [("plain", False, False), ("prefix", True, False), ("header", False, True), ("both", True, True)]


def recipe_inputs(passages: DataFrame, model: str) -> DataFrame:
    """Each passage (chunk_id, text, header) under each recipe: chunk_id, recipe, input. The rows of recipes are four."""
    prefix = task_prefix(F.lit(model), False)
    made = [F.struct(F.lit(name).alias("recipe"), embed_input(F.col("header") if header else F.lit(""), F.col("text"), prefix if with_prefix else None).alias("input")) for name, with_prefix, header in RECIPES]
    return passages.select("chunk_id", F.explode(F.array(*made)).alias("r")).select("chunk_id", "r.recipe", "r.input")
