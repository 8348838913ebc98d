"""Registered queries of the dealt problems; each runs over its whole tables with production parameters."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import dialogue, lookalike, mixing, mojibake, names, pieces, privacy, tokens
from docketry.session import read_table as t


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return names.links(t(spark, base, "people"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return dialogue.verdicts(t(spark, base, "messages"), t(spark, base, "conversations")).filter("reason IS NOT NULL").select("conversation_id")


def p2_turns(spark: SparkSession, base: str) -> DataFrame:
    return dialogue.turns(t(spark, base, "messages"), t(spark, base, "conversations")).select("conversation_id", "turn", "role", "seq", "content")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return pieces.oversized(t(spark, base, "extracted"))


def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    return pieces.pieces(t(spark, base, "extracted"))


def p3_cover(spark: SparkSession, base: str) -> DataFrame:
    """The items put together again from their pieces without the overlaps, and the longest piece of each."""
    body = pieces.pieces(t(spark, base, "extracted")).groupBy("document_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.expr("substring(text, overlap_chars + 1)").alias("core")))), lambda x: x["core"]), "").alias("text"), F.max(F.length("text")).alias("longest"), F.max("overlap_chars").alias("overlap")
    )
    return body.select("document_id", "page", F.md5("text").alias("text"), (F.col("longest") <= 1400).alias("fits"), (F.col("overlap") <= 220).alias("within_overlap"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.wrongly_decoded(t(spark, base, "extracted"))


def p4_restored(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.restored(t(spark, base, "extracted")).filter("found")


def _free_texts(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, bytes]:
    """The three columns of free text, the given names of the catalogue, and the secret of the surrogates: `spark.docketry.surrogate.key` (hexadecimal), or where it is unset a fresh one for this run."""
    people = t(spark, base, "people")
    secret = spark.conf.get("spark.docketry.surrogate.key", None)
    return privacy.texts(people, t(spark, base, "cases"), t(spark, base, "messages")), privacy.given_names(people), bytes.fromhex(secret) if secret else secrets.token_bytes(32)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return privacy.found(*_free_texts(spark, base))


def p5_redacted(spark: SparkSession, base: str) -> DataFrame:
    return privacy.redacted(*_free_texts(spark, base))


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode(t(spark, base, "documents"))


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.shares(mixing.counted(t(spark, base, "documents")), t(spark, base, "mix_targets"), t(spark, base, "mix_runs"))


def p7_draws(spark: SparkSession, base: str) -> DataFrame:
    return mixing.draws(mixing.counted(t(spark, base, "documents")), t(spark, base, "mix_targets"), t(spark, base, "mix_runs"))


def p7_invariants(spark: SparkSession, base: str) -> DataFrame:
    """Per run, over its draws: how many documents go beyond max_repeats or stand twice, whether the budget is kept, how many sources within reach miss their target by more than their longest document, and the same of sources at their limit."""
    documents = mixing.counted(t(spark, base, "documents"))
    targets, runs = t(spark, base, "mix_targets"), t(spark, base, "mix_runs")
    drawn = mixing.draws(documents, targets, runs)
    sources = documents.groupBy("source").agg(F.sum("n_tokens").alias("has"), F.max("n_tokens").alias("longest"))
    per = drawn.join(targets, "source").groupBy("run_id", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count_if(F.col("uses") > F.col("max_repeats")).alias("over"), (F.count("*") - F.count_distinct("doc_id")).alias("twice"))
    full = runs.crossJoin(F.broadcast(targets.join(sources, "source"))).join(per, ["run_id", "source"], "left").fillna(0, ["tokens", "over", "twice"])  # a row per run and source
    limit, wanted = F.col("has") * F.col("max_repeats"), F.floor(F.col("budget_tokens") * F.col("target_share"))
    short = F.when(limit <= wanted, F.col("tokens") != limit).otherwise(F.col("tokens") < wanted - F.col("longest") - 1)
    return full.groupBy("run_id").agg(F.sum("over").alias("over_repeats"), F.sum("twice").alias("twice"), (F.sum("tokens") <= F.max("budget_tokens")).alias("in_budget"), F.count_if(short).alias("short_sources"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.same_look(t(spark, base, "documents"))


def p8_canonical(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.canonical(t(spark, base, "documents"))


def queries() -> dict:
    found = (p1_found, p2_found, p2_turns, p3_found, p3_pieces, p3_cover, p4_found, p4_restored, p5_found, p5_redacted, p6_ids, p7_draws, p7_shares, p7_invariants, p8_found, p8_canonical)
    return {f.__name__: f for f in found}
