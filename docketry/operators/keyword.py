"""Keyword search: query analysis, tokenising, postings, BM25 over prefix terms, and the search view.

Prefixes are matched against the distinct vocabulary, so the join with the postings is an equi-join on tokens. Many
questions are answered at once; corpus statistics stay those of the whole corpus whatever the filters. `search` gives the best
of each question without ever holding all pairs of a question and a passage, `bm25` all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.session import cut, few

K1, B, FLOOR, MOST_TERMS = 1.2, 0.75, 1e-6, 16
#: Passages of a shard, on average; lines counted at a time; how far apart two scores may lie that count as one.
SHARD, LINES, NEAR = 20_000, 2_000, 2e-9
# Words without weight in a question, English and Portuguese.
STOPWORDS = (
    "a an and are as at be by can did do does for from had has have how i in is it its me my of on or our please that the their there this to was we were what when "
    "where which who why will with you your about any all tell show list give find "
    "o os as um uma uns umas de da do das dos em na no nas nos e ou que se por para com sem ao aos à às é foi ser são qual quais quando onde como quem porque isso "
    "isto esse essa este esta meu minha seu sua me nos há tem sobre todos todas mostre liste"
).split()
# Letters with accents and the letters they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňőōřśşšťūůűźżžάέήίόύώϊϋΐΰйё"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssstuuuzzzαεηιουωιυιυие"


def folded(text: str | Column) -> Column:
    """Lower case, accents folded, combining marks dropped."""
    c = F.col(text) if isinstance(text, str) else text
    ascii_ = F.octet_length(c) == F.length(c)  # nothing to fold
    return F.when(ascii_, F.lower(c)).otherwise(F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), ACCENTED, FOLDED))


def terms(question: str | Column) -> Column:
    """The terms of a question in order: split on signs that are no letters or digits, lower case, no stopwords and single letters (numbers stay), each once, at most 16."""
    words = F.split(F.lower(question), r"[^\p{IsAlphabetic}\p{N}]+")
    keep = lambda w: (w != "") & (w.rlike(r"^[0-9]+$") | ((F.length(w) > 1) & ~F.array_contains(F.lit(sorted(set(STOPWORDS))), w)))
    return F.slice(F.array_distinct(F.filter(words, keep)), 1, MOST_TERMS)


def tokens(text: str | Column) -> Column:
    return F.filter(F.split(folded(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def postings(passages: DataFrame) -> DataFrame:
    """chunk_id, token, tf, size (tokens of the passage). NULL and empty texts have none."""
    split = passages.select("chunk_id", tokens("text").alias("words"))
    return split.select("chunk_id", F.size("words").alias("size"), F.explode("words").alias("token")).groupBy("chunk_id", "size", "token").agg(F.count("*").alias("tf"))


def bm25(passages: DataFrame, questions: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score of every passage that holds a token starting with a term of the question.

    `passages`: chunk_id, text; `questions`: query_id, text; `allowed` (query_id, chunk_id or just chunk_id) narrows what may be
    found, never the statistics. score = sum of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean size)).
    Terms that fold to the same prefix count each. Questions without terms find nothing.

    Prefixes meet the vocabulary, cut to the lengths asked for, by equality. Postings of the prefixes are counted per passage,
    weighed once per prefix, and put where their passage is; there they meet the questions, so adding up needs no further
    shuffle and `best` keeps k rows per question and task.
    """
    words = cut(passages.select("chunk_id", tokens("text").alias("words")))  # texts are split once
    stats = words.agg(F.count("*").alias("n_all"), F.avg(F.coalesce(F.size("words"), F.lit(0))).alias("mean_size"))
    asked = cut(questions.select("query_id", F.explode(terms("text")).alias("term")).select("query_id", folded("term").alias("prefix")))
    prefixes = asked.select("prefix").distinct()
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row: the different lengths of terms
    vocabulary = words.select(F.explode("words").alias("token")).distinct()
    cuts = F.transform(F.filter("lengths", lambda n: n <= F.length("token")), lambda n: F.substring(F.col("token"), F.lit(1), n))
    met = cut(vocabulary.crossJoin(F.broadcast(lengths)).select("token", F.explode(cuts).alias("prefix")).join(prefixes, "prefix", "left_semi"))
    posts = words.select("chunk_id", F.size("words").alias("size"), F.explode("words").alias("token"))
    found = cut(posts.join(few(met), "token").groupBy("chunk_id", "size", "prefix").agg(F.count("*").cast("double").alias("tf")))
    df = found.groupBy("prefix").agg(F.count("*").cast("double").alias("df"))
    idf = F.ln((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut(df.crossJoin(F.broadcast(stats)).select("prefix", F.when(idf > 0, idf).otherwise(F.lit(FLOOR)).alias("weight"), "mean_size"))  # one row of statistics
    open_ = found if allowed is None or "query_id" in allowed.columns else found.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    scored = open_.join(few(weights), "prefix").select("prefix", "chunk_id", part.alias("part")).repartition("chunk_id")
    hits = scored.join(few(asked), "prefix").groupBy("chunk_id", "query_id").agg(F.sum("part").alias("score"))
    if allowed is not None and "query_id" in allowed.columns:
        hits = hits.join(allowed, ["query_id", "chunk_id"], "left_semi")
    return hits.select("query_id", "chunk_id", "score")


def _counted(prefixes: dict[str, int]):
    """Lines of words to the numbers of the prefixes in them (ascending) and how often each is there; `size`: words of the line."""
    lengths = sorted({len(p) for p in prefixes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {"": []}
        for batch in (b.slice(a, LINES) for b in batches for a in range(0, b.num_rows, LINES)):
            words = pc.split_pattern(batch.column("line").fill_null(""), " ")
            rows = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
            coded = words.flatten().dictionary_encode()
            codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            size = np.bincount(rows, weights=np.asarray([w != "" for w in vocabulary], float)[codes], minlength=batch.num_rows)
            for w in vocabulary:
                if w not in known:
                    known[w] = [i for n in lengths if n <= len(w) and (i := prefixes.get(w[:n])) is not None]
            met = [known[w] for w in vocabulary]
            many = np.asarray([len(x) for x in met], np.int64)
            numbers, starts = np.asarray([i for x in met for i in x], np.int64), np.cumsum(many) - many
            times = many[codes]
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pairs, tf = np.unique(np.repeat(rows, times) * len(prefixes) + numbers[np.repeat(starts[codes], times) + inside], return_counts=True)
            row, number = np.divmod(pairs, max(1, len(prefixes)))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (number, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(size.astype(np.int32)), *lists], names=["chunk_id", "size", "numbers", "tfs"])

    return run


def _passages_of(n: int):
    """In how many passages each of the n prefixes is: number, df, as partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("numbers").flatten().to_numpy(zero_copy_only=False), minlength=n)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["number", "df"])

    return run


def _leaders(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0, and of those that lie too near to the last of them to be told apart by a sum of floats; of exactly equal ones the first k."""
    at = np.flatnonzero(scores)
    if len(at) <= k:
        return at
    s = scores[at]
    at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - NEAR]
    if len(at) > 2 * k:
        at = at[np.lexsort((at, -scores[at]))]
        s = scores[at]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        place = np.arange(len(at))
        at = at[place - np.maximum.accumulate(np.where(new, place, 0)) < k]
    return at


def _weigh(k: int, weights, mean_size: float, narrowed: bool):
    """The k best passages of a shard (`left`; rows without a size name those that may be found) for each list of prefixes (`right`)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("chunk_id")
        real = pc.is_valid(left.column("size"))
        keep = pc.and_(real, pc.is_in(ids, value_set=ids.filter(pc.invert(real)), skip_nulls=True)) if narrowed else real
        left = left.filter(keep)
        left = left.take(pc.sort_indices(left.column("chunk_id"))).combine_chunks()  # places then order as chunk_id does
        n, found_a, found_c, found_s = left.num_rows, [], [], []
        if n and right.num_rows:
            w = weights.value
            lists = left.column("numbers").combine_chunks()
            rows = np.repeat(np.arange(n, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
            numbers = lists.flatten().to_numpy(zero_copy_only=False)
            tf = left.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            level = K1 * (1 - B + B * left.column("size").to_numpy() / mean_size) if mean_size else np.ones(n)
            order = np.argsort(numbers, kind="stable")
            numbers, rows, tf = numbers[order], rows[order], tf[order]
            parts = w[numbers] * tf * (K1 + 1) / (tf + level[rows])
            there, starts = np.unique(numbers, return_index=True)
            ends = np.append(starts[1:], len(numbers))
            posts = {}
            for number, a, z in zip(there.tolist(), starts.tolist(), ends.tolist()):
                if (z - a) * 5 > n:  # adding a whole column is cheaper than its places one by one
                    whole = np.zeros(n)
                    whole[rows[a:z]] = parts[a:z]
                    posts[number] = None, whole
                else:
                    posts[number] = rows[a:z], parts[a:z]
            asked = right.column("numbers").combine_chunks()
            flat, upto = asked.flatten().to_pylist(), np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            scores, a = np.zeros(n), 0
            for i, z in enumerate(upto):
                scores[:] = 0
                for number in flat[a:z]:
                    at, part = posts.get(number, (None, None))
                    if at is not None:
                        scores[at] += part
                    elif part is not None:
                        scores += part
                a = z
                at = _leaders(scores, k)
                found_a.append(np.full(len(at), i))
                found_c.append(at)
                found_s.append(scores[at])
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return pa.table({"ask": right.column("ask").take(pa.array(join(found_a, int))), "chunk_id": left.column("chunk_id").take(pa.array(join(found_c, int))), "score": pa.array(join(found_s, float))})

    return run


def search(passages: DataFrame, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k best per question of `bm25`, the same scores and ties: query_id, chunk_id, score, rank. `passages` has each chunk_id once; `allowed`: chunk_id.

    Every pair of a question and a passage would be questions times passages. So passages become the numbers of the prefixes in
    them, in the task that reads their text, and are spread over shards; questions with the same terms are one, and visit every
    shard. There the sums of a question stand in one array, and its k best leave the task. The driver and the workers hold the
    different words of all questions with their weights, never the questions.
    """
    spark = passages.sparkSession
    sc = spark.sparkContext
    asked = cut(questions.select("query_id", F.explode(terms("text")).alias("term")).select("query_id", folded("term").alias("prefix")))
    numbered = cut(asked.select("prefix").distinct().coalesce(1).withColumn("number", F.monotonically_increasing_id().cast("int")))
    prefixes = {r.prefix: r.number for r in numbered.collect()}
    kind = passages.schema["chunk_id"].dataType.simpleString()
    line = F.regexp_replace(folded("text"), r"[^\p{IsAlphabetic}\p{N}]+", " ").alias("line")
    posts = cut(passages.select("chunk_id", line).mapInArrow(_counted(prefixes), f"chunk_id {kind}, size int, numbers array<int>, tfs array<int>"))
    n, mean = posts.agg(F.count("*"), F.avg("size")).first()
    df = posts.select("numbers").mapInArrow(_passages_of(len(prefixes)), "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(prefixes))
    for r in df.collect():  # one row for each different word of the questions
        idf = math.log((n - r.df + 0.5) / (r.df + 0.5))
        weights[r.number] = idf if idf > 0 else FLOOR
    each = cut(asked.join(few(numbered), "prefix").groupBy("query_id").agg(F.sort_array(F.collect_list("number")).alias("numbers")))
    asks = cut(each.select("numbers").distinct().withColumn("ask", F.monotonically_increasing_id()))
    shards = max(math.ceil(n / SHARD), 2 * sc.defaultParallelism)
    shard = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).alias("shard")
    spread = posts.filter(F.size("numbers") > 0).select(shard, "chunk_id", "size", "numbers", "tfs")
    if allowed is not None:
        spread = spread.unionByName(allowed.select(F.col("chunk_id").cast(kind).alias("chunk_id")).distinct().select(shard, "chunk_id"), allowMissingColumns=True)
    visits = asks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "ask", "numbers")
    met = spread.groupBy("shard").cogroup(visits.groupBy("shard")).applyInArrow(_weigh(k, sc.broadcast(weights), float(mean or 0), allowed is not None), f"ask long, chunk_id {kind}, score double")
    top = best(met.withColumnRenamed("ask", "query_id"), k).withColumnRenamed("query_id", "ask")
    return each.join(asks, "numbers").select("query_id", "ask").join(top, "ask").select("query_id", "chunk_id", "score", "rank")


def ready(passages: DataFrame, files: DataFrame, key: str = "document_id") -> DataFrame:
    """chunk_id of the passages whose document is `Ready` in the catalogue: what a search may show (`allowed` of `bm25`)."""
    done = files.filter("index_status = 'Ready'").select(F.col("id").alias(key)).distinct()
    return passages.join(done, key, "left_semi").select("chunk_id")


def view(hits: DataFrame, passages: DataFrame, documents: DataFrame, cases: DataFrame, limit: int = 12) -> DataFrame:
    """The search view: at most `limit` hits a question (brought into 1..50), scores scaled by the best, with text, document and case; hits whose passage is gone are left out."""
    from docketry.operators.hybrid import hydrate

    return hydrate(scaled(best(hits, min(max(limit, 1), 50))), passages, documents, cases)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best per question: query_id, chunk_id, score, rank (from 1); ties by chunk_id."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def scaled(hits: DataFrame) -> DataFrame:
    """Scores divided by the best of the question."""
    top = F.max("score").over(W.partitionBy("query_id"))
    return hits.withColumn("score", F.col("score") / F.greatest(top, F.lit(1e-12)))


def highlight(text: Column, words: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Words of more than two letters marked wherever they occur, case aside."""
    import re

    kept = sorted({w for w in words if len(w) > 2}, key=lambda w: (-len(w), w))
    return F.regexp_replace(text, "(?i)(" + "|".join(map(re.escape, kept)) + ")", f"{before}$1{after}") if kept else text


def snippet_around(text: Column, words: list[str], size: int = 280, lead: int = 93, from_: int = 140) -> Column:
    """At most `size` characters: all of a short text; else its head, or a window from `lead` characters before the first word found at `from_` or later."""
    places = [F.locate(w.lower(), F.lower(text)) for w in words if len(w) > 2]
    first = F.least(*[F.when(p > 0, p) for p in places], F.lit(None)) if places else F.lit(None).cast("int")
    at = first - 1
    start = F.greatest(at - lead, F.lit(0))
    window = F.concat(F.lit("…"), F.substring(text, start + 1, F.lit(size)), F.when(start + size < F.length(text), F.lit("…")).otherwise(F.lit("")))
    return F.when(F.length(text) <= size, text).when(at >= from_, window).otherwise(F.concat(F.substring(text, 1, size), F.lit("…")))
