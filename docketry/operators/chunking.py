"""Cut texts into overlapping passages for retrieval: paragraphs, sentences, greedy packing by bytes.

Paragraphs and sentences are split by Spark's own functions. Packing looks at one document's list of unit lengths in order,
so it is a map over documents in Arrow batches that returns unit ranges; texts and offsets are put together by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import token_estimate

TARGET, OVERLAP = 1400, 220


def units(text: Column, target: int = TARGET) -> Column:
    """Paragraphs (split at blank lines, trimmed, empty ones dropped); those above the target as sentences.

    A sentence ends at a terminator that white space and a capital, digit or quote follow. The space before a sentence stays with it.
    """
    edge = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, edge, "")), lambda p: p != "")
    sentences = lambda p: F.split(p, r"(?<=[.!?])(?=\s+[\p{Lu}0-9\"'])")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.octet_length(p) <= target, F.array(p)).otherwise(sentences(p))))


def _pack(target: int, overlap: int):
    def ranges(sizes: list[int]) -> list[tuple[int, int]]:
        out, i, n = [], 0, len(sizes)
        while i < n:
            j, size = i + 1, sizes[i]
            while j < n and size < target and size + sizes[j] + 1 <= target:
                size += sizes[j] + 1
                j += 1
            out.append((i, j))
            if j == n:
                break
            back, kept = j, 0
            while back > i and kept + sizes[back - 1] < overlap:
                back -= 1
                kept += sizes[back]
            i = j if back == j or back <= i else back
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("i", "j", "a", "b")]))
        for batch in batches:
            packed = []
            for sizes in batch.column("sizes").to_pylist():
                before = [0, *accumulate(s + 1 for s in sizes or [])]
                packed.append([{"i": i, "j": j, "a": before[i], "b": before[j] - 1} for i, j in ranges(sizes or [])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, kind)], names=[*batch.schema.names, "ranges"])

    return run


def _packed(extracted: DataFrame, target: int, overlap: int) -> DataFrame:
    """document_id, units, ranges: the units of each document with the passages as ranges of units and bytes."""
    once = extracted.select("document_id", "text", "pages").dropDuplicates(["document_id"])
    kind = "array<struct<u:string,page:int>>"
    paged = F.flatten(F.transform(F.coalesce("pages", F.array().cast("array<string>")), lambda p, k: F.transform(F.coalesce(units(p, target), F.array().cast("array<string>")), lambda u: F.struct(u.alias("u"), (k + 1).cast("int").alias("page")))))
    plain = F.transform(F.coalesce(units(F.col("text"), target), F.array().cast("array<string>")), lambda u: F.struct(u.alias("u"), F.lit(None).cast("int").alias("page")))
    cut = once.select("document_id", F.when(F.size(paged) > 0, paged).otherwise(plain).cast(kind).alias("units")).filter(F.size("units") > 0)
    sized = cut.withColumn("sizes", F.transform("units", lambda x: F.octet_length(x["u"])))
    return sized.mapInArrow(_pack(target, overlap), f"document_id string, units {kind}, sizes array<int>, ranges array<struct<i:bigint,j:bigint,a:bigint,b:bigint>>").drop("sizes")


def chunks(extracted: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Passages of documents (document_id, text, pages): chunk_id `document:n`, ordinal, start_off, end_off (bytes of the joined units), page, text, token_estimate.

    Pages are cut one by one and packed together, the page of a passage is that of its first unit; documents without pages, or
    whose pages hold nothing, are cut from their text with no page. NULL and blank documents have no passages. Repeated rows count once.
    """
    def passage(r):
        own = F.slice("units", (r["i"] + 1).cast("int"), (r["j"] - r["i"]).cast("int"))
        return F.struct(r["a"].alias("start_off"), r["b"].alias("end_off"), F.get(F.col("units"), r["i"].cast("int"))["page"].alias("page"), F.array_join(F.transform(own, lambda x: x["u"]), " ").alias("text"))

    # Passages are put together inside the row; only they are exploded, never the units with each of them.
    each = _packed(extracted, target, overlap).select("document_id", F.posexplode(F.transform("ranges", passage)).alias("ordinal", "p"))
    return each.select(
        F.concat("document_id", F.lit(":"), F.col("ordinal").cast("string")).alias("chunk_id"), "document_id", "ordinal", "p.start_off", "p.end_off", "p.page", "p.text", token_estimate(F.col("p.text")).alias("token_estimate"),
    )


def chunk_sizes(extracted: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """document_id, n_chunks, n_tokens (estimate): passages counted from their ranges, without building a text."""
    size = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + F.ceil((r["b"] - r["a"]) / 4.0) + 1)
    return _packed(extracted, target, overlap).select("document_id", F.size("ranges").cast("long").alias("n_chunks"), size.alias("n_tokens"))


def document_chunks(passages: DataFrame, document_ids: DataFrame) -> DataFrame:
    """The passages of documents asked for (`document_ids`: document_id), in order: document_id, ordinal, chunk_id, page, text."""
    return passages.join(document_ids.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "ordinal", "chunk_id", "page", "text")
