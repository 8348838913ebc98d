"""Folding of event feeds, in batch and as streams, and ingestion of documents as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.operators.chunking import chunks
from docketry.session import cut

# The steps of an answer, in order.
STEPS = ["mentions", "embed", "search", "context", "answer"]


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last event of each key: a max_by, combined on the map side, so a hot key costs one row per task."""
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, "v.*")


def progress(events: DataFrame, key: str, order: list[str], status: str, running: tuple[str, ...]) -> DataFrame:
    """Keys whose last event is still of a running status."""
    return latest(events, key, order, [status, *[c for c in order if c != status]]).filter(F.col(status).isin(*running))


def step_states(events: DataFrame, key: str, step: str, state: str, order: list[str]) -> DataFrame:
    """key, step_no, step, state of every known step: the last reported state; a step before the furthest reported one that never was reported counts as done; steps after it are pending. Unknown steps are left out."""
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.col(step))
    known = events.withColumn("step_no", place.cast("int")).filter("step_no > 0")
    own = known.groupBy(key, "step_no").agg(F.max_by(state, F.struct(*order)).alias("own"))
    far = own.groupBy(key).agg(F.max("step_no").alias("far"))
    grid = far.select(key, "far", F.explode(F.sequence(F.lit(1), F.lit(len(STEPS)))).alias("step_no"))
    full = grid.join(own, [key, "step_no"], "left")
    done = F.when(F.col("step_no") < F.col("far"), F.when(F.col("own") == "skipped", "skipped").otherwise("done")).when(F.col("step_no") == F.col("far"), F.col("own")).otherwise("pending")
    return full.select(key, "step_no", F.element_at(F.array(*map(F.lit, STEPS)), F.col("step_no")).alias("step"), done.alias("state"))


def lines(parts: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """key, place, line: byte chunks of a feed put together in order and cut at line ends; the last unfinished line counts. NULL parts hold nothing.

    Breaks are counted in each range partition of the feeds and shifted by those of the partitions before it, which numbers
    the line of every part; parts meet per line only, so a feed may be of any length.
    """
    named = parts.select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.coalesce(column, F.lit("")).alias("__text"))
    ranged = cut(named.repartitionByRange("__key", "__order", "__text").withColumn("__part", F.spark_partition_id()).withColumn("__breaks", F.length("__text") - F.length(F.replace("__text", F.lit("\n"), F.lit("")))))
    sums = ranged.groupBy("__key", "__part").agg(F.sum("__breaks").alias("n"))
    before = sums.select(F.col("__key").alias("k"), F.col("__part").alias("p"), F.coalesce(F.sum("n").over(W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = W.partitionBy("__key", "__part").orderBy("__order", "__text").rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumn("__i", F.row_number().over(run)).withColumn("__off", F.sum("__breaks").over(run) - F.col("__breaks"))
    placed = local.join(before, F.col("__key").eqNullSafe(F.col("k")) & (F.col("__part") == F.col("p")))
    pieces = placed.select("__key", "__part", "__i", "__breaks", (F.col("before") + F.col("__off")).alias("first"), F.posexplode(F.split("__text", "\n")).alias("j", "piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__part", "__i", "piece"))), lambda x: x["piece"]), "")
    line = pieces.groupBy("__key", (F.col("first") + F.col("j")).cast("int").alias("place")).agg(whole.alias("w"), F.max(F.col("j") < F.col("__breaks")).alias("ended"))
    bare = F.when(F.col("ended") & F.endswith("w", F.lit("\r")), F.left("w", F.length("w") - 1)).otherwise(F.col("w"))
    return line.select(F.col("__key").alias(key), "place", bare.alias("line")).filter("line <> ''")


def sse_data(framed: DataFrame, key: str) -> DataFrame:
    """key, place, data: what the `data:` lines of event streams carry; the closing `[DONE]` carries nothing."""
    data = F.ltrim(F.substring("line", 6, 1 << 30))
    return framed.filter(F.startswith("line", F.lit("data:"))).select(key, "place", data.alias("data")).filter("data <> '[DONE]'")


def step_counts(events: DataFrame, key: str, step: str, order: list[str], *counts: str) -> DataFrame:
    """key, step and the last known value of each count: a count, once reported, stays until another is."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in counts]
    return events.filter(F.col(key).isNotNull()).groupBy(key, step).agg(*last)


def index_progress(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """key, status, done, total: the last status of each document of an index run, with how many of its batches are embedded (`embedding` events) of how many it has (`total`)."""
    n = events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count_if(F.col(status) == "Embedding").alias("done"), F.max("total").alias("total"))
    return n.withColumn("done", F.least("done", F.coalesce("total", "done")))


def micro_batches(stream: DataFrame, folder: str, checkpoint: str, every: str = "40 milliseconds"):
    """Deltas of a stream appended as Parquet at most once every `every`; what has come in by then goes out together, the rest when the stream is stopped."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def windowed_counts(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts per time window and keys; rows later than `late` behind the newest are left out when run as a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def ingest(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Cut documents that arrive (document_id, text, pages) into passages, appended as Parquet; each input file is taken exactly once."""

    def write(batch: DataFrame, epoch: int) -> None:
        chunks(batch).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()
