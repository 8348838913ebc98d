"""Problem 2: rebuild conversations from message rows.

Messages are range-partitioned by (conversation, instant, seq), so a conversation that holds a third of all rows is
spread over many tasks. Each task runs the automaton over its sorted share and keeps, per conversation, a summary of four
facts: turns seen, first role, last role, and whether a role order was broken inside. Summaries of the (few) shares of
one conversation are then chained in order, which gives the same verdict as one pass over the whole conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import cut

ROLES = ("user", "assistant", "system")
#: An RFC 3339 instant: date, time to the second or finer, and an offset.
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
BLANK = r"^[\s\x{85}\p{Z}\x{200b}\x{2060}\x{feff}]*$"


def clean_role(role: Column) -> Column:
    """The role in lower case without surrounding spaces; NULL when it is none of the three known ones."""
    low = F.lower(F.regexp_replace(role, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.when(low.isin(*ROLES), low)


def instant(text: Column) -> Column:
    """The instant of an RFC 3339 text; NULL when it cannot be read."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(INSTANT), F.upper(trimmed).try_cast("timestamp"))


def prepared(messages: DataFrame, keep_content: bool) -> DataFrame:
    """One row per message id: conversation, role, instant, seq, and `turn` (takes part in the exchange).

    Repeated rows with one id count once (any of the copies; they are identical). A NULL id is a message of its own.
    """
    rows = messages.select(
        "id", "conversation_id", clean_role(F.col("role")).alias("role"), instant(F.col("created_at")).alias("at"), F.col("seq").cast("long").alias("seq"),
        (F.col("content").isNull() | F.col("content").rlike(BLANK)).alias("blank"), (F.coalesce(F.col("error"), F.lit("")) != "").alias("failed"),
        *([F.col("content")] if keep_content else []),
    )
    named = rows.filter("id IS NOT NULL").dropDuplicates(["id"])
    rows = named.unionByName(rows.filter("id IS NULL"))
    return rows.withColumn("turn", F.coalesce(F.col("role") != "system", F.lit(False)) & ~F.col("blank") & ~F.col("failed") & F.col("at").isNotNull())


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summary per (conversation, run of consecutive rows): n, first, last, broken. Input is sorted within the partition."""
    prev_conv, prev_role, first, n, broken, out = None, None, None, 0, False, []

    def flush():
        if prev_conv is not None:
            out.append((prev_conv, first, prev_role, n, broken))

    part = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        convs, is_reply = batch.column(0).to_pylist(), np.asarray(batch.column(1).to_pylist(), dtype=bool)
        part = batch.column(2)[0].as_py()
        starts = [0, *[i for i in range(1, len(convs)) if convs[i] != convs[i - 1]], len(convs)]
        for a, b in zip(starts, starts[1:]):
            roles = is_reply[a:b]
            if convs[a] != prev_conv:
                flush()
                prev_conv, prev_role, first, n, broken = convs[a], None, bool(roles[0]), 0, False
            broken = broken or bool(prev_role and roles[0]) or bool((roles[1:] & roles[:-1]).any())
            prev_role, n = bool(roles[-1]), n + (b - a)
    flush()
    if out:
        c, f, l, k, x = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string()), pa.array([part] * len(out), pa.int32()), pa.array(f, pa.bool_()), pa.array(l, pa.bool_()), pa.array(k, pa.int64()), pa.array(x, pa.bool_())],
            names=["conversation_id", "part", "first", "last", "n", "broken"],
        )


def automaton(turns: DataFrame) -> DataFrame:
    """Verdict per conversation over its turns (user and assistant only): conversation_id, n_turns, ok.

    Accepts user+ (assistant user+)* assistant: an assistant never first and never after an assistant, and last of all.
    """
    narrow = turns.select("conversation_id", (F.col("role") == "assistant").alias("reply"), "at", "seq", F.xxhash64("id").alias("tie"))
    sorted_rows = narrow.repartitionByRange("conversation_id", "at", "seq", "tie").sortWithinPartitions("conversation_id", "at", "seq", "tie")
    shares = sorted_rows.select("conversation_id", "reply", F.spark_partition_id().alias("part")).mapInArrow(
        _walk, "conversation_id string, part int, first boolean, last boolean, n bigint, broken boolean"
    )
    chained = shares.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("part", "first", "last", "n", "broken"))).alias("s"))
    joint = F.exists(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get(F.col("s"), i - 1)["last"] & F.get(F.col("s"), i)["first"])
    broken = F.exists("s", lambda x: x["broken"]) | (F.when(F.size("s") > 1, joint).otherwise(F.lit(False)))
    return chained.select(
        "conversation_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_turns"),
        (~broken & ~F.element_at("s", 1)["first"] & F.element_at("s", -1)["last"]).alias("ok"),
    )


def verdicts(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation id of either table: conversation_id, n_turns, reason (NULL: keep).

    Reasons, first that holds: `no conversation` (no row in conversations), `bad role`, `bad time`, `empty` (no turn left),
    `broken order` (starts with a reply, reply after reply, or no reply at the end). Messages without a conversation id are
    no conversation and give no row. Empty tables give no rows.
    """
    rows = cut(prepared(messages.filter("conversation_id IS NOT NULL"), keep_content=False))  # narrow, and read twice
    flags = rows.groupBy("conversation_id").agg(F.max(F.col("role").isNull()).alias("bad_role"), F.max(F.col("at").isNull()).alias("bad_time"))
    known = conversations.select(F.col("id").alias("conversation_id")).filter("conversation_id IS NOT NULL").distinct().withColumn("known", F.lit(True))
    judged = automaton(rows.filter("turn"))
    joined = known.join(flags, "conversation_id", "full_outer").join(judged, "conversation_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(~no("known"), "no conversation").when(no("bad_role"), "bad role").when(no("bad_time"), "bad time")
        .when(F.coalesce("n_turns", F.lit(0)) == 0, "empty").when(~no("ok"), "broken order")
    )
    return joined.select("conversation_id", F.coalesce("n_turns", F.lit(0)).cast("long").alias("n_turns"), reason.alias("reason"))


def turns(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The kept conversations as ordered turns: conversation_id, turn (from 1), role, at, seq, content.

    Turn numbers come from positions inside each range partition plus the counts of the partitions before it, so no task
    holds a whole conversation. Ties in time and seq are broken by a hash of the id.
    """
    kept = verdicts(messages, conversations).filter("reason IS NULL").select("conversation_id")
    rows = prepared(messages.filter("conversation_id IS NOT NULL"), keep_content=True).filter("turn").join(kept, "conversation_id", "left_semi")
    rows = rows.select("conversation_id", "role", "at", "seq", "content", F.xxhash64("id").alias("tie"))
    placed = cut(rows.repartitionByRange("conversation_id", "at", "seq", "tie").withColumn("part", F.spark_partition_id()))
    from pyspark.sql import Window as W

    counts = placed.groupBy("conversation_id", "part").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("conversation_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    local = placed.withColumn("k", F.row_number().over(W.partitionBy("conversation_id", "part").orderBy("at", "seq", "tie")))
    return local.join(before.drop("count"), ["conversation_id", "part"]).select("conversation_id", (F.col("before") + F.col("k")).cast("long").alias("turn"), "role", "at", "seq", "content")
