"""Vector search by cosine: exact for many questions at once, and a kept inverted-file index for large stores.

Questions and vectors are rows all the way. Questions are spread over blocks and vectors over shards; a block meets a shard in
one task as two Arrow tables, whose product is one matrix; only the k best per question leave the task. Nothing but counts
reaches the driver, and the sample the cells of the index are fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.session import cut

#: Questions of a block and vectors of a shard, on average; questions scored at a time.
BLOCK, SHARD, AT_ONCE = 16_384, 20_000, 128
#: When an index is due: live vectors to build one, newer ones to take in, share of dead ones to build it anew.
BUILD_AT, EXTEND_AT, DEAD_SHARE = 20_000, 4_000, 0.25


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: str | Column) -> Column:
    """Unit vector; NULL for a zero or non-finite one, or one with a NULL in it."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 for vectors of different width or without length."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def distance(a: str | Column, b: str | Column) -> Column:
    """1 - dot product of two unit vectors, never below 0."""
    return F.greatest(F.lit(0.0), 1 - dot(a, b))


def widths(vectors: DataFrame) -> DataFrame:
    """Vectors per width, and which width is the main one (most vectors, the larger among equals)."""
    n = vectors.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    return n.withColumn("main", F.row_number().over(W.orderBy(F.desc("n"), F.desc("width"))) == 1)  # one row per width: few


def _unit_rows(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Width: (positions, unit vectors) of the usable rows of a list column: not NULL, no NULL inside, of finite length above 0."""
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows
    if isinstance(rows, pa.ChunkedArray) or not len(rows):
        return {}
    sizes = np.where(np.asarray(rows.is_valid()), np.asarray(rows.value_lengths().fill_null(0)), 0)
    flat = rows.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a NULL inside becomes NaN, which is not finite
    ends = np.cumsum(sizes)
    out = {}
    for w in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == w)
        m = values[(ends[at] - w)[:, None] + np.arange(w)]
        n = np.linalg.norm(m, axis=1)
        ok = (n > 0) & np.isfinite(n)
        if ok.any():
            out[int(w)] = at[ok], m[ok] / n[ok, None]
    return out


def _codes(values: list) -> tuple[np.ndarray, dict]:
    """Every value as a number, -1 for NULL, and the numbers by value."""
    seen: dict = {}
    return np.asarray([-1 if v is None else seen.setdefault(v, len(seen)) for v in values], int), seen


def _limits(left: pa.Table, right: pa.Table) -> list[tuple[np.ndarray, dict, list, bool]]:
    """What narrows the questions of a table: the codes of the vectors, their numbers by value, what each question wants, whether that is a list."""
    out = []
    for have, want, several in (("label", "want_label", False), ("document_id", "want_documents", True), ("case_id", "want_case", False)):
        wanted = right.column(want).to_pylist()
        if any(x is not None and x != [] for x in wanted):
            out.append((*_codes(left.column(have).to_pylist()), wanted, several))
    return out


def _fits(limits: list[tuple[np.ndarray, dict, list, bool]], rows: np.ndarray, asked: np.ndarray) -> np.ndarray | None:
    """Which vectors each question may find: NULL wants all, a list with nothing in it, too; a NULL label or case of a vector fits no wanted one."""
    keep = None
    for codes, seen, wanted, several in limits:
        codes = codes[rows]
        one = np.ones((len(rows), len(asked)), bool)
        for j, q in enumerate(asked):
            if wanted[q] is not None and wanted[q] != []:
                one[:, j] = np.isin(codes, [seen.get(v, -2) for v in (wanted[q] if several else [wanted[q]])])
        keep = one if keep is None else keep & one
    return keep


def _meet(k: int):
    """The k best vectors of one table for each question of the other, as (query_id, vec_id, score)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found_q, found_v, found_s = [], [], []
        if left.num_rows and right.num_rows:
            store, asked = _unit_rows(left.column("embedding")), _unit_rows(right.column("embedding"))
            limits = _limits(left, right)
            for w in store.keys() & asked.keys():
                rows, m = store[w]
                n = len(rows)
                for qs, q in ((asked[w][0][a : a + AT_ONCE], asked[w][1][a : a + AT_ONCE]) for a in range(0, len(asked[w][0]), AT_ONCE)):
                    scores = q @ m.T
                    np.round(scores, 9, out=scores)
                    may = _fits(limits, rows, qs)
                    if may is not None:
                        scores = np.where(may.T, scores, 0.0)
                    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(qs))
                    j, at = np.nonzero((scores > 0) & (scores >= least[:, None]))
                    found_v.append(rows[at])
                    found_q.append(qs[j])
                    found_s.append(scores[j, at])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        v, q, s = join(found_v, int), join(found_q, int), join(found_s, float)
        return pa.table({"query_id": right.column("query_id").take(pa.array(q)), "vec_id": left.column("vec_id").take(pa.array(v)), "score": pa.array(s)})

    return run


def _prepared(vectors: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    return vectors.select("vec_id", "embedding", *[F.col(c).cast("string").alias(c) if c in vectors.columns else null.alias(c) for c in ("label", "document_id", "case_id")])


def _wanted(questions: DataFrame, label: str | None, documents: str | None, case: str | None) -> DataFrame:
    null = F.lit(None).cast("string")
    return questions.select(
        "query_id", "embedding", (F.col(label).cast("string") if label else null).alias("want_label"), (F.col(documents).cast("array<string>") if documents else F.lit(None).cast("array<string>")).alias("want_documents"),
        (F.col(case).cast("string") if case else null).alias("want_case"),
    )


def _best(store: DataFrame, asked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each question over all groups of `keys` in which it meets vectors; ties by vec_id."""
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {store.schema['vec_id'].dataType.simpleString()}, score double"
    met = store.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_meet(k), kind)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(vectors: DataFrame, questions: DataFrame, k: int = 10, label: str | None = None, documents: str | None = None, case: str | None = None) -> DataFrame:
    """The k nearest of each question: query_id, vec_id, score, rank. `vectors`: vec_id, embedding, and label, document_id, case_id where wanted; `questions`: query_id, embedding.

    Cosine above 0 only; ties by vec_id. Zero, non-finite and NULL vectors, and vectors of another width, are invisible.
    `label`, `documents` (a list) and `case` name columns of the questions that narrow what each may find, all of them at once;
    NULL and an empty list mean no limit, and a vector without a case or label fits no wanted one.
    """
    sc = vectors.sparkSession.sparkContext
    asked = cut(_wanted(questions, label, documents, case))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    shards = max(math.ceil(vectors.count() / SHARD), math.ceil(sc.defaultParallelism / blocks), 1)
    store = _prepared(vectors).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    return _best(store, spread, ["block", "shard"], k)


# --- the index ---------------------------------------------------------------------------------------------------------


def ivf_fit(vectors: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of an inverted file (spherical k-means) from a random sample of exactly `sample` vectors of the main width, or all where there are fewer."""
    main = widths(vectors).filter("main").select("width")
    usable = vectors.filter("embedding IS NOT NULL").withColumn("width", F.size("embedding")).join(F.broadcast(main), "width")
    rows = usable.select("embedding", F.xxhash64("vec_id", F.lit(seed)).alias("h")).orderBy("h").limit(sample).select("embedding").collect()
    m = np.asarray([r.embedding for r in rows], float)
    m = m[np.linalg.norm(m, axis=1) > 0]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        near = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(n > 0, sums / np.maximum(n, 1e-12), centres)
    return centres


def _cells(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near: list = [None] * batch.num_rows
            usable = _unit_rows(pa.chunked_array([batch.column("embedding")]))
            if centres.shape[1] in usable:
                rows, m = usable[centres.shape[1]]
                for i, cells in zip(rows.tolist(), np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes].tolist()):
                    near[i] = cells
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def ivf_assign(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """Every vector with its `probes` nearest cells, one row each. Vectors of another width, and NULL ones, have none."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(_cells(centres, probes), f"{kind}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def ivf_search(store: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each question among the vectors of its cells (`store`, `asked`: with `cell`); scores are exact.

    A cell may hold a third of all vectors: it is spread over as many parts as its size asks for, and its questions visit all.
    """
    sizes = store.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    spread = store.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")  # one row a cell
    visits = asked.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return _best(spread, visits, ["cell", "part"], k)


def build_index(vectors: DataFrame, folder: str, cells: int = 64, sample: int = 20_000) -> None:
    """Write an index of all usable vectors of the main width: `points` (with their cell, ordered by it, so that a scan for few cells skips the rest) and `centres`."""
    centres = ivf_fit(vectors, cells, sample)
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]  # as many as there are cells
    vectors.sparkSession.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    ivf_assign(_prepared(vectors), centres).repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{folder}/points")


def _centres(spark: SparkSession, folder: str) -> np.ndarray:
    return np.asarray([r.centre for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()])


def extend_index(vectors: DataFrame, folder: str) -> None:
    """Take the vectors the index lacks into their nearest cells."""
    spark = vectors.sparkSession
    known = spark.read.parquet(f"{folder}/points").select("vec_id")
    ivf_assign(_prepared(vectors).join(known, "vec_id", "left_anti"), _centres(spark, folder)).write.mode("append").parquet(f"{folder}/points")


def index_state(vectors: DataFrame, folder: str | None) -> DataFrame:
    """One row: live, indexed, tail (live vectors the index lacks), dead (indexed vectors that are gone), main_width, index_width, and what is due: `build`, `extend`, `rebuild` or `none`."""
    spark = vectors.sparkSession
    live = vectors.filter("embedding IS NOT NULL").select("vec_id", F.size("embedding").alias("width"))
    points = spark.read.parquet(f"{folder}/points").select("vec_id", F.size("embedding").alias("index_width")) if folder else live.select("vec_id", F.col("width").alias("index_width")).limit(0)
    both = live.join(points, "vec_id", "full_outer")
    counts = both.agg(F.count("width").alias("live"), F.count("index_width").alias("indexed"), F.count_if(F.col("index_width").isNull()).alias("tail"), F.count_if(F.col("width").isNull()).alias("dead"), F.max("index_width").alias("index_width"))
    main = widths(vectors).filter("main").agg(F.max("width").alias("main_width"))
    due = (
        F.when(F.col("live") < BUILD_AT, "none").when(F.col("indexed") == 0, "build").when((F.col("dead") > DEAD_SHARE * F.col("indexed")) | (F.col("index_width") != F.col("main_width")), "rebuild")
        .when(F.col("tail") > EXTEND_AT, "extend").otherwise("none")
    )
    return counts.crossJoin(F.broadcast(main)).withColumn("due", due)  # one row each


def maintain(vectors: DataFrame, folder: str, cells: int = 64) -> str:
    """Do what is due to the index in `folder` and say what it was."""
    spark = vectors.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/points")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    due = index_state(vectors, folder if there else None).first().due
    if due in ("build", "rebuild"):
        build_index(vectors, folder, cells)
    elif due == "extend":
        extend_index(vectors, folder)
    return due


def search(vectors: DataFrame, questions: DataFrame, k: int = 10, index: str | None = None, probes: int = 6) -> DataFrame:
    """The k nearest by the index in the folder `index`, or by exact search without one: an argument, no matter of size.

    With an index: the live vectors of the `probes` nearest cells of each question, and all live vectors the index lacks (the
    tail, newer ones and those of other widths) exactly. A question that finds fewer than k this way is searched exactly.
    """
    if index is None:
        return knn(vectors, questions, k)
    spark = vectors.sparkSession
    points = spark.read.parquet(f"{index}/points")
    live = points.join(vectors.select("vec_id"), "vec_id", "left_semi")
    asked = cut(_wanted(questions, None, None, None))
    near = ivf_search(live, ivf_assign(asked, _centres(spark, index), probes), k)
    tail = vectors.join(points.select("vec_id"), "vec_id", "left_anti")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lists = [x.select("query_id", "vec_id", "score") for x in (near, knn(tail, asked, k))]
    found = cut(reduce(DataFrame.unionByName, lists).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    rest = cut(asked.join(full, "query_id", "left_anti"))
    if rest.isEmpty():
        return found
    return found.join(rest.select("query_id"), "query_id", "left_anti").unionByName(knn(vectors, rest, k))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: of the exact hits (query_id, vec_id) the share that was found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
