"""Problem 7: mix sources to target weights.

Temperature mixing. The token shares p of the sources that can give anything are raised to one exponent and normalised,
w = p ** a / sum. The exponent is found by bisection: entropy falls as it rises, so there is one at which the tempered weights
have the entropy of the targets; if a source would then have to be repeated beyond its limit, the exponent is raised until none
is, or to 1 (natural shares) where that never happens. One temperature cannot meet every target by itself, so a correction per
source, reported as target / w, brings the weights to the targets in a second step: every source draws its target share, up to
its limit, and what limited sources give up goes to the others in the proportion of the tempered weights, again up to their limits.

Budgets become documents by block permutations: a keyed hash sends every document of a source to one of so many blocks as its
size asks for, per run, and orders it inside. Whole passes, then whole blocks are taken while they fit; only inside the last
block are documents summed one by one. Tables with one row per source, or per source and block, are the only ones that are
brought together, so a source that holds a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.tokens import BYTE_BPE_50K, token_counts
from docketry.session import cut, few

#: Documents of a block, on average.
BLOCK = 2048
SEED = 20240229
STEPS = 80


def tempered(shares: list[float], exponent: float) -> list[float]:
    """The shares raised to the exponent and normalised; shares of 0 stay 0."""
    top = max(shares)
    raised = [math.exp(exponent * math.log(p / top)) if p > 0 else 0.0 for p in shares]
    total = sum(raised)
    return [x / total for x in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def temperature(shares: list[float], target: list[float], most: list[float]) -> tuple[float, str]:
    """(exponent, what it was bisected to): `entropy` of the targets, else the `limit` of repetitions (`most`, as weights), else `natural` shares."""
    low, high = 0.0, 1.0
    wanted = entropy([t / sum(target) for t in target])
    while entropy(tempered(shares, high)) > wanted and high < 64:
        high *= 2
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tempered(shares, mid)) > wanted else (low, mid)
    fits = lambda a: all(w <= m * (1 + 1e-12) for w, m in zip(tempered(shares, a), most))
    if fits(high):
        return high, "entropy"
    if high >= 1 or not fits(1.0):
        return 1.0, "natural"
    low, high = high, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high, "limit"


def weights(budget: int, target: list[float], tokens: list[int], repeats: list[int]) -> tuple[list[float], float, str, list[float]]:
    """(tokens to draw per source, exponent, what it was bisected to, tempered weights). Sources without tokens, target or repeats draw nothing; a limited source draws its limit to the last token."""
    limit = [k * max(r, 0) for k, r in zip(tokens, repeats)]
    live = [i for i, t in enumerate(target) if t > 0 and limit[i] > 0]
    draw, tilt = [0.0] * len(target), [0.0] * len(target)
    if not live or budget <= 0:
        return draw, 1.0, "natural", tilt
    total = sum(tokens[i] for i in live)
    exponent, how = temperature([tokens[i] / total for i in live], [target[i] for i in live], [limit[i] / budget for i in live])
    for i, w in zip(live, tempered([tokens[i] / total for i in live], exponent)):
        tilt[i] = w
    for i in live:
        draw[i] = min(float(limit[i]), budget * target[i])
    open_, left = {i for i in live if draw[i] < limit[i]}, budget - sum(draw)
    while open_ and left > 1e-6:
        part = sum(tilt[i] for i in open_)
        full = [i for i in open_ if draw[i] + left * tilt[i] / part >= limit[i]]
        for i in full or list(open_):
            draw[i] = float(limit[i]) if full else draw[i] + left * tilt[i] / part
        open_ -= set(full or open_)
        left = budget - sum(draw)
    return draw, exponent, how, tilt


def _plans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per run with the lists of all its sources in; one row per run and source out."""
    names = ["run_id", "source", "budget_tokens", "target_share", "max_repeats", "source_tokens", "planned_tokens", "exponent", "bisected_to", "tempered_share", "correction", "passes", "rest"]
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            draws_, exponent, how, tilt = weights(int(r.budget_tokens), [x["target_share"] for x in r.sources], [x["tokens"] for x in r.sources], [x["max_repeats"] for x in r.sources])
            for x, draw, w in zip(r.sources, draws_, tilt):
                planned = int(math.floor(draw + 1e-6))
                full, rest = divmod(planned, x["tokens"]) if x["tokens"] else (0, 0)
                out.append((r.run_id, x["source"], r.budget_tokens, x["target_share"], x["max_repeats"], x["tokens"], planned, exponent, how, w, x["target_share"] / w if w else None, full, rest))
        yield pd.DataFrame(out, columns=names)


_PLAN = "run_id int, source string, budget_tokens bigint, target_share double, max_repeats int, source_tokens bigint, planned_tokens bigint, exponent double, bisected_to string, tempered_share double, correction double, passes bigint, rest bigint"


def counted(documents: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id, source, n_tokens, counted once and written to the shared folder. Documents without a source belong to no target."""
    return cut(token_counts(documents, ["doc_id", "source"], path).filter("source IS NOT NULL"))


def plan(sizes: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """What each run draws from each source: whole passes and a rest in tokens. `targets` and `runs` are small by nature: one row per source and per run."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").cast("long").alias("tokens"))
    known = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left")
    one = known.agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))).alias("sources"))
    return runs.filter("budget_tokens >= 0").select(F.lit(1).alias("k"), "run_id", "budget_tokens").distinct().join(one.withColumn("k", F.lit(1)), "k").select("run_id", "budget_tokens", "sources").mapInPandas(_plans, _PLAN)


def draws(sizes: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, source, doc_id, uses, n_tokens: how often each run takes each document (rows with 0 uses are left out).

    A document is used once per whole pass and once more if the last, partial pass reaches it: never more than max_repeats.
    Empty documents (0 tokens) are never drawn.
    """
    return _draws(sizes, cut(plan(sizes, targets, runs)))


def _draws(sizes: DataFrame, plan_: DataFrame) -> DataFrame:
    docs = sizes.filter("n_tokens > 0")
    blocks_of = docs.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    todo = few(cut(plan_.filter("planned_tokens > 0").select("run_id", "source", "passes", "rest").join(blocks_of, "source")))  # one row per run and source
    order = F.xxhash64(F.lit(SEED), "run_id", "doc_id")
    placed = docs.join(todo, "source").withColumn("h", order).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))
    sums = placed.groupBy("run_id", "source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    w = W.partitionBy("run_id", "source").orderBy("block")  # one row per block
    before = few(cut(sums.withColumn("before", F.sum("block_tokens").over(w) - F.col("block_tokens"))))
    joined = placed.join(before, ["run_id", "source", "block"])
    sure = joined.filter("before + block_tokens <= rest OR before >= rest").withColumn("last", F.when(F.col("before") < F.col("rest"), 1).otherwise(0))
    inside = W.partitionBy("run_id", "source", "block").orderBy("h", "doc_id")
    edge = joined.filter("before < rest AND before + block_tokens > rest").withColumn("sum", F.sum("n_tokens").over(inside)).withColumn("last", F.when(F.col("before") + F.col("sum") <= F.col("rest"), 1).otherwise(0)).drop("sum")
    return sure.unionByName(edge).withColumn("uses", (F.col("passes") + F.col("last")).cast("int")).filter("uses > 0").select("run_id", "source", "doc_id", "uses", "n_tokens")


def shares(sizes: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run and source what was wanted and what was reached: documents, uses, tokens, share of the run, largest repetition, and whether the target was within reach."""
    plan_ = cut(plan(sizes, targets, runs))
    taken = _draws(sizes, plan_).groupBy("run_id", "source").agg(
        F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).cast("long").alias("tokens"), F.max("uses").alias("most_uses")
    )
    full = plan_.join(taken, ["run_id", "source"], "left").fillna(0, ["documents", "uses", "tokens", "most_uses"])
    run_tokens = F.sum("tokens").over(W.partitionBy("run_id"))  # one row per source
    return full.select(
        "run_id", "source", "budget_tokens", "target_share", "max_repeats", "source_tokens", "exponent", "bisected_to", "tempered_share", "correction", "planned_tokens", "documents", "uses", "tokens", "most_uses",
        F.round(F.try_divide(F.col("tokens").cast("double"), run_tokens), 6).alias("reached_share"),
        (F.col("planned_tokens") >= F.floor(F.col("budget_tokens") * F.col("target_share")) - 1).alias("in_reach"),
    )
