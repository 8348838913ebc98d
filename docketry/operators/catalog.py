"""Relational reads over the catalogue: listings, joins, counts, history.

Identical repeated rows count once (`once`). A blank or missing argument means no filter. Every ordering ends in a unique
key, so results are deterministic. NULL keys join nothing; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.session import cut

#: Capital and small ASCII letters, for orderings and searches that fold only those.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows with repeated keys once. Copies are identical, so a filter goes before it and reaches the scan."""
    return df.dropDuplicates([key])


def nocase(c: str | Column) -> Column:
    """ASCII-folded text."""
    return F.translate(c, UPPER, LOWER)


def contains_any(term: str | None, *columns: str) -> Column:
    """True where any column contains the trimmed term, ASCII case aside; wildcards in the term are ordinary signs. A blank term fits all rows."""
    term = (term or "").strip()
    if not term:
        return F.lit(True)
    low = term.translate(str.maketrans(UPPER, LOWER))
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(nocase(c), F.lit(low)), F.lit(False)) for c in columns])


def equal_or_all(column: str, value: str | None) -> Column:
    return F.lit(True) if value is None else F.col(column) == value


def counted(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per key, for a left join; map-side combined, so a hot key costs one row per task."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def with_count(df: DataFrame, key: str, many: DataFrame, many_key: str, name: str) -> DataFrame:
    """`df` with the number of its rows in `many`; 0 where there are none."""
    n = counted(many, many_key, name).withColumnRenamed(many_key, f"__{name}")
    return df.join(n, F.col(key) == F.col(f"__{name}"), "left").drop(f"__{name}").withColumn(name, F.coalesce(name, F.lit(0)))


def case_list(cases: DataFrame, categories: DataFrame, files: DataFrame, case_people: DataFrame, search: str | None = None, category: str | None = None, status: str | None = None) -> DataFrame:
    """Cases with their category and the numbers of documents and people, newest change first. Filters are a real WHERE."""
    kept = once(cases.filter(contains_any(search, "title", "reference", "description") & equal_or_all("category_id", category) & equal_or_all("status", status)))
    named = kept.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"), F.col("color").alias("category_color")), "category_id", "left")
    full = with_count(with_count(named, "id", once(files), "case_id", "document_count"), "id", case_people.dropDuplicates(["case_id", "person_id"]), "case_id", "person_count")
    return full.select("id", "reference", "title", "status", "category_name", "category_color", "updated_at", "document_count", "person_count")


def category_list(categories: DataFrame, cases: DataFrame) -> DataFrame:
    """Categories by name, with their number of cases."""
    return with_count(once(categories), "id", once(cases), "category_id", "case_count").select("id", "name", "practice_area", "color", "case_count")


def category_breakdown(cases: DataFrame, categories: DataFrame) -> DataFrame:
    """Cases per category, those without one as `Uncategorised`; categories without cases do not appear."""
    n = once(cases).groupBy("category_id").agg(F.count("*").alias("case_count"))
    named = n.join(once(categories).select(F.col("id").alias("category_id"), "name", "color"), "category_id", "left")
    return named.select(F.coalesce("name", F.lit("Uncategorised")).alias("name"), F.coalesce("color", F.lit("#64748b")).alias("color"), "case_count")


def people_list(people: DataFrame, case_people: DataFrame, search: str | None = None, role: str | None = None) -> DataFrame:
    """People with their number of cases, by name."""
    kept = once(people.filter(contains_any(search, "full_name", "organization", "email") & equal_or_all("role", role)))
    return with_count(kept, "id", case_people.dropDuplicates(["case_id", "person_id"]), "person_id", "case_count").select("id", "full_name", "role", "organization", "email", "case_count")


def roster(case_people: DataFrame, people: DataFrame, case_id: str | None = None) -> DataFrame:
    """Who takes part in which case, with the role in the case. `place` gives the order inside a case."""
    links = case_people.filter(equal_or_all("case_id", case_id)).dropDuplicates(["case_id", "person_id"])
    joined = links.join(once(people).select(F.col("id").alias("person_id"), "full_name", "role"), "person_id")
    return joined.select("case_id", "person_id", "role_in_case", "full_name", "role")


def placed_roster(case_people: DataFrame, people: DataFrame, case_id: str | None = None) -> DataFrame:
    """The roster with `place` from 1 in the order of each case: role in the case, then name, both without ASCII case, then id."""
    from docketry.operators.ordering import numbered

    # One dense number over all cases, less where each case starts: a case with very many people is spread over tasks.
    all_ = cut(numbered(roster(case_people, people, case_id), [F.col("case_id"), nocase("role_in_case"), nocase("full_name"), F.col("person_id")], "__n"))
    starts = all_.groupBy("case_id").agg(F.min("__n").alias("__start"))
    return all_.join(starts, "case_id").withColumn("place", F.col("__n") - F.col("__start") + 1).drop("__n", "__start")


def prompts(conversations: DataFrame, messages: DataFrame, questions: DataFrame, system: str, n: int = 12) -> DataFrame:
    """conversation_id, place, role, content: what a model is asked in each conversation with a question (`questions`: conversation_id, question): the system text, the last n turns that did not fail, oldest first, the question."""
    asked = questions.join(conversations.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi")
    first = asked.select("conversation_id", F.lit(0).alias("place"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    turns = history(messages, n).join(asked.select("conversation_id"), "conversation_id", "left_semi").select("conversation_id", (n + 1 - F.col("back")).cast("int").alias("place"), "role", "content")
    last = asked.select("conversation_id", F.lit(n + 1).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content"))
    return first.unionByName(turns).unionByName(last)


def lookup(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows for keys asked for (`keys`: column `key`), one row per key: `found` says whether there is one, else all columns are NULL. A NULL key finds nothing."""
    asked = keys.select(F.col(key).alias("__asked")).distinct()
    rows = once(df, key).join(asked.select(F.col("__asked").alias(key)), key, "left_semi").withColumn("found", F.lit(True))
    out = asked.join(rows, F.col("__asked") == F.col(key), "left")
    return out.select(F.col("__asked").alias(key), *[c for c in df.columns if c != key], F.coalesce("found", F.lit(False)).alias("found"))


def with_case(df: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows (sheets, events, ...) with reference and title of their case; rows without a case keep NULLs."""
    named = once(cases).select(F.col("id").alias("__case"), F.col("reference").alias("case_reference"), F.col("title").alias("case_title"))
    return df.join(named, F.col(key) == F.col("__case"), "left").drop("__case")


def file_list(files: DataFrame, cases: DataFrame, case_id: str | None = None, search: str | None = None) -> DataFrame:
    """Documents of the catalogue with reference and title of their case; both filters at once if both are given."""
    kept = once(files.filter(equal_or_all("case_id", case_id) & contains_any(search, "file_name")))
    return kept.join(once(cases).select(F.col("id").alias("case_id"), F.col("reference").alias("case_reference"), F.col("title").alias("case_title")), "case_id", "left").select(
        "id", "file_name", "mime", "size_bytes", "index_status", "case_id", "case_reference", "case_title", "created_at"
    )


def recent(df: DataFrame, column: str, n: int, key: str = "id") -> DataFrame:
    """The n newest rows; NULL times last."""
    return df.orderBy(F.desc_nulls_last(column), key).limit(n)


def dashboard(cases: DataFrame, people: DataFrame, files: DataFrame, conversations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row of counters, one aggregate per table."""
    c = once(cases).agg(F.count("*").alias("cases"), F.count_if(nocase("status") == "open").alias("open_cases"))
    f = once(files).agg(F.count("*").alias("documents"), F.count_if(F.col("index_status") == "Ready").alias("indexed_documents"))
    parts = [c, once(people).agg(F.count("*").alias("people")), f, once(conversations).agg(F.count("*").alias("conversations")), once(categories).agg(F.count("*").alias("categories"))]
    return reduce(lambda a, b: a.join(b, "one").select("one", *[x for x in a.columns if x != "one"], *[x for x in b.columns if x != "one"]), [p.withColumn("one", F.lit(1)) for p in parts]).drop("one")


def by_status(df: DataFrame, column: str = "status") -> DataFrame:
    return once(df).groupBy(column).agg(F.count("*").alias("n"))


def next_reference(cases: DataFrame, tag: str = "CV") -> DataFrame:
    """Per year, the next free reference `YYYY-<tag>-<number>`: one more than the largest number in use; numbers keep at least four digits."""
    part = lambda g: F.regexp_extract("reference", rf"^(\d{{4}})-{tag}-(\d+)", g)
    used = cases.filter(F.col("reference").rlike(rf"^\d{{4}}-{tag}-\d+")).groupBy(part(1).alias("year")).agg(F.max(part(2).cast("long")).alias("top"))
    return used.select("year", F.format_string(f"%s-{tag}-%04d", "year", F.col("top") + 1).alias("next_reference"))


def smallest_free(cases: DataFrame, tag: str = "CV") -> DataFrame:
    """Per year in use, the smallest number from 1 that no reference has."""
    number = F.regexp_extract("reference", rf"^(\d{{4}})-{tag}-0*(\d+)$", 2)
    found = cases.filter(F.col("reference").rlike(rf"^\d{{4}}-{tag}-\d+$")).select(F.substring("reference", 1, 4).alias("year"), number.cast("long").alias("n"))
    used = found.unionByName(found.select("year", F.lit(0).cast("long").alias("n"))).distinct()
    after = used.select("year", (F.col("n") + 1).alias("n"))
    return after.join(used, ["year", "n"], "left_anti").groupBy("year").agg(F.min("n").alias("free_number"))


def conversation_list(conversations: DataFrame, messages: DataFrame, case_id: str | None = None) -> DataFrame:
    """Conversations with the number of their messages (each id once)."""
    kept = once(conversations.filter(equal_or_all("case_id", case_id)))
    return with_count(kept, "id", once(messages), "conversation_id", "message_count").select("id", "title", "case_id", "updated_at", "message_count")


def history(messages: DataFrame, n: int = 12) -> DataFrame:
    """The last n turns of every conversation, oldest first by `place`: user and assistant messages that did not fail; order of arrival.

    A per-key top n: Spark keeps n rows per key and task before the shuffle, so a hot conversation does not pile up.
    """
    told = once(messages.filter("role IN ('user', 'assistant') AND coalesce(error, '') = ''"))
    newest = W.partitionBy("conversation_id").orderBy(F.desc("seq"), F.desc("id"))
    top = told.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)
    return top.select("conversation_id", "id", "role", "content", "back")


def auto_title(conversations: DataFrame, messages: DataFrame, default: tuple[str, ...] = ("", "New conversation", "Untitled"), size: int = 60) -> DataFrame:
    """Conversations whose title is a default one, with the start of their first user message as title; without one they keep theirs."""
    first = once(messages.filter(F.lower(F.trim("role")) == "user")).groupBy(F.col("conversation_id").alias("id")).agg(F.min_by("content", F.struct("seq", F.col("id"))).alias("first"))
    plain = once(conversations.filter(F.coalesce("title", F.lit("")).isin(*default)))
    return plain.join(first, "id", "left").select("id", F.coalesce(F.trim(F.substring("first", 1, size)), "title").alias("title"))


def citations(messages: DataFrame) -> DataFrame:
    """Citations of every message, one row each; broken JSON counts as no citation."""
    kind = "array<struct<chunkId:string,documentId:string,page:bigint,score:double>>"
    return once(messages).select("id", F.posexplode(F.from_json("citations", kind)).alias("place", "c")).filter("c IS NOT NULL").select("id", (F.col("place") + 1).alias("n"), F.col("c.chunkId").alias("chunk_id"), F.col("c.documentId").alias("document_id"), "c.page", "c.score")


def repeated(df: DataFrame, column: str) -> DataFrame:
    """Values that several ids share, with the number of ids and the least of them."""
    return once(df).filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def table_search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which any column, as text, contains `text`, case aside."""
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.strip().lower())), F.lit(False)) for c in columns]))


def page(df: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """Rows first..last-1 of an ordering."""
    return df.orderBy(*order).offset(max(first, 0)).limit(max(last - max(first, 0), 0))


def upcoming(events: DataFrame, now: str, n: int = 40) -> DataFrame:
    """The next n events from the start of the day of `now`."""
    return events.filter(F.col("ts") >= F.date_trunc("day", F.lit(now).cast("timestamp_ntz"))).orderBy("ts", "event_id").limit(n)


def between(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events of a span of time, both ends included; compared as times, not as text."""
    return events.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def month_grid(events: DataFrame) -> DataFrame:
    """The six Monday-first weeks around every month that has events, with the events of each day."""
    months = events.select(F.trunc("ts", "month").alias("month")).distinct()
    cells = months.select("month", F.posexplode(F.expr("sequence(to_date(date_trunc('week', month)), date_add(to_date(date_trunc('week', month)), 41))")).alias("cell", "day"))
    n = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return cells.join(n, "day", "left").select("month", "cell", "day", F.coalesce("n", F.lit(0)).alias("n"))
