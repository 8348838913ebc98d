import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry import plans
from docketry.functions import formula as m
from docketry.functions import text as x
from docketry.operators import catalog, chunking, consistency, embedding, graph, hybrid, keyword, ordering, sheet, tree, vectors
from docketry.streaming import folds


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lcg(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dim))


# --- catalogue -----------------------------------------------------------------------------------------------------


def test_search_takes_wildcards_literally_and_blank_as_no_filter(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), (None,)], "t string")
    assert df.filter(catalog.contains_any("0% O", "t")).count() == 1
    assert df.filter(catalog.contains_any("  ", "t")).count() == 3


def test_listing_filters_are_a_real_where(spark):
    cases = spark.createDataFrame([("1", "R1", "A", "k", "Open", None), ("2", "R2", "B", None, "Closed", None), ("2", "R2", "B", None, "Closed", None)], "id string, reference string, title string, category_id string, status string, description string").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    cats = spark.createDataFrame([("k", "Kind", "#fff")], "id string, name string, color string")
    files = spark.createDataFrame([("f", "1"), ("g", None)], "id string, case_id string")
    links = spark.createDataFrame([("1", "p"), ("1", "p")], "case_id string, person_id string")
    rows = catalog.case_list(cases, cats, files, links, status="Closed").collect()
    assert [(r.id, r.category_name, r.document_count, r.person_count) for r in rows] == [("2", None, 0, 0)]
    both = catalog.case_list(cases, cats, files, links).orderBy("id").collect()
    assert [(r.id, r.document_count, r.person_count) for r in both] == [("1", 1, 1), ("2", 0, 0)]
    empty = catalog.case_list(cases.limit(0), cats, files, links)
    assert empty.count() == 0


def test_upsert_walks_the_closing_states(spark):
    ts = "timestamp_ntz"
    old = spark.createDataFrame([("a", "r", "A", None, "Open", None), ("b", "r", "B", None, "Closed", None), ("c", "r", "C", "k", "Closed", "d")], "id string, reference string, title string, category_id string, status string, description string")
    old = old.withColumn("opened_at", F.lit("2020-01-01").cast(ts)).withColumn("closed_at", F.when(F.col("status") == "Closed", F.lit("2020-02-02").cast(ts))).withColumn("created_at", F.lit("2020-01-01").cast(ts)).withColumn("updated_at", F.lit("2020-01-01").cast(ts))
    edits = spark.createDataFrame([("a", None, "A", None, "Closed", None), ("b", None, "B2", None, "Closed", None), ("c", None, "C", None, "Open", None), ("n", "new", "N", None, "Closed", None), ("x", None, "  ", None, "Open", None)], "id string, reference string, title string, category_id string, status string, description string")
    rows = {r.id: r for r in consistency.upsert_cases(old, edits, "2021-01-01 00:00:00").collect()}
    assert str(rows["a"].closed_at).startswith("2021") and str(rows["b"].closed_at).startswith("2020-02") and rows["c"].closed_at is None
    assert rows["c"].category_id == "k" and rows["c"].description == "d" and rows["c"].reference == "r"
    assert str(rows["n"].closed_at).startswith("2021") and "x" not in rows


def test_deletes_keep_documents_and_drop_links(spark):
    cases = spark.createDataFrame([("1",), ("2",)], "id string")
    files = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", None)], "id string, case_id string")
    conv = spark.createDataFrame([("c", "1")], "id string, case_id string")
    links = spark.createDataFrame([("1", "p"), ("2", "p")], "case_id string, person_id string")
    out = consistency.delete_cases(spark.createDataFrame([("1",), ("1",)], "id string"), cases, files, conv, links)
    assert {(r.id, r.case_id) for r in out["files"].collect()} == {("f", None), ("g", "2"), ("h", None)}
    assert out["conversations"].first().case_id is None
    assert [r.case_id for r in out["case_people"].collect()] == ["2"] and out["cases"].count() == 1


def test_merge_keeps_old_values_where_a_change_is_null(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "id string, n int, t string")
    assert sorted(map(tuple, consistency.merge(old, new).collect())) == [("a", 1, "z"), ("b", 2, "y"), ("c", 3, None)]


def test_numbering_is_dense_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(k % 5 if k % 7 else None, k) for k in range(200)], "a int, b int")
    out = ordering.numbered(df, [ordering.Desc(F.col("a")), F.col("b")]).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(200))
    want = sorted(((r.a, r.b) for r in out), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in out] == want


# --- keyword -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "question, want",
    [
        ("Which broker was at the auction, and did it pay?", ["broker", "auction", "pay"]),
        ("quem assinou o contrato da garagem em março", ["assinou", "contrato", "garagem", "março"]),
        ("room 7, floor 12 b", ["room", "7", "floor", "12"]),
        ("Keys KEYS; keys!", ["keys"]),
        ("where are they and how", ["they"]),
        ("who will you tell", []),
        ("órgão orgao", ["órgão", "orgao"]),
    ],
)
def test_question_terms(spark, question, want):
    assert one(spark, keyword.terms(F.lit(question))) == want


def test_terms_stop_at_sixteen(spark):
    assert len(one(spark, keyword.terms(F.lit(" ".join(f"word{i}" for i in range(40)))))) == 16


def test_bm25_against_plain_python(spark):
    texts = {1: "Acórdão do réu", 2: "the lease was broken, the lease ended", 3: "leases and rents", 4: "", 5: "nothing here"}
    docs = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "acordao lease"), (2, "the of"), (3, "")], "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in keyword.bm25(docs, asked).collect()}
    words = {k: [w for w in t.lower().replace(",", "").replace("ó", "o").replace("ã", "a").replace("é", "e").split()] for k, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for prefix in ("acordao", "lease"):
        tf = {k: sum(w.startswith(prefix) for w in ws) for k, ws in words.items()}
        df = sum(v > 0 for v in tf.values())
        idf = math.log((5 - df + 0.5) / (df + 0.5))
        for k, v in tf.items():
            if v:
                want[1, k] = want.get((1, k), 0) + max(idf, 1e-6 if idf <= 0 else idf) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(words[k]) / mean))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_filters_do_not_change_statistics(spark):
    docs = spark.createDataFrame([(1, "red lease"), (2, "blue lease"), (3, "green")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "lease red")], "query_id long, text string")
    full = {r.chunk_id: r.score for r in keyword.bm25(docs, asked).collect()}
    part = {r.chunk_id: r.score for r in keyword.bm25(docs, asked, spark.createDataFrame([(2,)], "chunk_id long")).collect()}
    assert part == {2: full[2]}


def test_search_has_the_best_of_bm25(spark, monkeypatch):
    monkeypatch.setattr(keyword, "SHARD", 40)
    rng = np.random.default_rng(3)
    words = ["lease", "leases", "lea", "réu", "reu", "court", "courts", "12", "123", "x\u0301y", "ημέρα", "the"]
    texts = [(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(300)] + [(i, "lease court") for i in range(300, 330)] + [(330, ""), (331, None)]
    passages = spark.createDataFrame(texts, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "lease court"), (2, "court, lease!"), (3, "réu reu 12"), (4, "the of"), (5, "nowhere"), (6, "ΗΜΈΡΑ 1"), (7, None)], "query_id long, text string")
    some = spark.createDataFrame([(i,) for i in range(0, 400, 3)] + [(None,)], "chunk_id long")
    for allowed in (None, some):
        want = keyword.best(keyword.bm25(passages, asked, allowed), 7)
        got = keyword.search(passages, asked, 7, allowed)
        key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())
        assert key(got) == key(want) and got.count() > 20


def test_search_without_words_finds_nothing(spark):
    none = spark.createDataFrame([(1, ""), (2, "the")], "query_id long, text string")
    passages = spark.createDataFrame([("a", "lease"), ("b", None)], "chunk_id string, text string")
    assert keyword.search(passages, none, 3).count() == 0
    assert keyword.search(passages.limit(0), none.withColumn("text", F.lit("lease")), 3).count() == 0


def test_of_passages_alike_only_k_leave_a_shard():
    held = type("Held", (), {"value": np.asarray([1.5])})
    n = 1000
    left = pa.table({"chunk_id": pa.array(range(n)), "size": pa.array([3] * n, pa.int32()), "numbers": pa.array([[0]] * n, pa.list_(pa.int32())), "tfs": pa.array([[1]] * n, pa.list_(pa.int32()))})
    right = pa.table({"ask": pa.array([5, 6]), "numbers": pa.array([[0], [0, 0]], pa.list_(pa.int32()))})
    got = keyword._weigh(10, held, 3.0, False)(left, right).to_pydict()
    assert got["ask"] == [5] * 10 + [6] * 10 and got["chunk_id"] == [*range(10)] * 2


@pytest.mark.parametrize("name", ["bm25_search", "ready_search", "bm25_filtered", "search_view", "hybrid_rrf", "citations", "context_blocks", "hit_documents", "keyword_view"])
def test_query_lists_no_pairs_of_question_and_passage(spark, data, monkeypatch, name):
    monkeypatch.setattr(keyword, "bm25", lambda *_: pytest.fail("every pair is listed"))
    assert plans.queries()[name](spark, data).count() > 0


def test_questions_of_one_block_do_not_copy_the_vectors(spark, monkeypatch):
    held = []
    monkeypatch.setattr(vectors, "_best", lambda store, asked, keys, k: held.append(store.count()))
    some = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    vectors.knn(some, some.withColumnRenamed("vec_id", "query_id"), 3)
    assert held == [5000]


def test_slices_of_questions_find_what_all_at_once_find(spark, monkeypatch):
    def table(n, key, seed, **more):
        return pa.table({key: pa.array(range(n)), "embedding": pa.array(lcg(n, 4, seed).tolist(), pa.list_(pa.float64()))} | more)

    left = table(60, "vec_id", 1, label=pa.array([str(i % 3) for i in range(60)]), document_id=pa.nulls(60, pa.string()), case_id=pa.nulls(60, pa.string()))
    right = table(11, "query_id", 2, want_label=pa.array([None if i % 4 == 0 else str(i % 3) for i in range(11)]), want_documents=pa.nulls(11, pa.list_(pa.string())), want_case=pa.nulls(11, pa.string()))
    rows = lambda t: sorted(zip(*t.to_pydict().values(), strict=True))
    whole = rows(vectors._meet(5)(left, right))
    monkeypatch.setattr(vectors, "AT_ONCE", 2)
    assert rows(vectors._meet(5)(left, right)) == whole and len({q for q, _, _ in whole}) == 11


def test_texts_stay_where_they_are_when_hits_are_few(spark):
    hits = spark.createDataFrame([(1, 7, 1.0, 1)], "query_id long, chunk_id long, score double, rank int")
    passages = spark.range(20).select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit("text").alias("text"), F.lit(None).cast("int").alias("page"))
    documents = spark.range(20).select(F.col("id").alias("document_id"), F.lit("d").alias("document_name"), F.lit("c").alias("case_id"))
    cases = spark.createDataFrame([("c", "C-1")], "id string, reference string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = hybrid.hydrate(hits, passages, documents, cases)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert [(r.chunk_id, r.text, r.case_reference) for r in got.collect()] == [(7, "text", "C-1")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_snippet_and_highlight(spark):
    text = "x" * 200 + " lease " + "y" * 300
    got = one(spark, keyword.snippet_around(F.lit(text), ["lease"]))
    assert got.startswith("…") and got.endswith("…") and "lease" in got and len(got) == 282
    assert one(spark, keyword.snippet_around(F.lit("short"), ["lease"])) == "short"
    assert one(spark, keyword.highlight(F.lit("The Lease (a.b)"), ["lease", "a.b", "it"])) == "The <b>Lease</b> (<b>a.b</b>)"


# --- vectors -------------------------------------------------------------------------------------------------------


def test_exact_search_against_numpy_with_bad_vectors(spark):
    v = lcg(300, 8)
    rows = [(i, [float(y) for y in r], i % 3) for i, r in enumerate(v)] + [(900, [0.0] * 8, 0), (901, None, 0), (902, [1.0] * 5, 1), (903, [float("nan")] * 8, 1)]
    rows.append((904, [float(y) for y in v[3]], 0))  # a tie
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = store.filter("vec_id IN (3, 17, 900)").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    got = [(r.query_id, r["rank"], r.vec_id) for r in vectors.knn(store, asked, 5).collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (3, 17):
        s = sorted([(-round(float(u[q] @ u[i]), 6), i) for i in range(300)] + [(-round(float(u[q] @ u[3]), 6), 904)])[:5]
        assert [i for a, r, i in sorted(got) if a == q] == [i for _, i in s]
    assert not [g for g in got if g[0] == 900]
    narrow = vectors.knn(store, asked, 50, label="label")
    assert narrow.join(store, "vec_id").filter("query_id = 17 AND label <> 2").count() == 0


def test_inverted_file_reaches_its_recall(spark, tmp_path):
    v = lcg(4000, 16)
    store = spark.createDataFrame([(i, [float(y) for y in r], 0) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(4).cache()
    asked = store.filter("vec_id % 200 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    folder = f"file://{tmp_path}/index"
    vectors.build_index(store, folder, cells=24)
    near = vectors.search(store, asked, 10, folder, probes=12)
    assert vectors.recall(near, vectors.knn(store, asked, 10)).first().recall >= 0.9
    assert near.groupBy("query_id").count().filter("count <> 10").count() == 0


def test_index_takes_in_new_vectors_and_forgets_gone_ones(spark, tmp_path):
    v = lcg(900, 8)
    rows = [(i, [float(y) for y in r]) for i, r in enumerate(v)] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0, 2.0])]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    folder = f"file://{tmp_path}/index"
    vectors.build_index(store.filter("vec_id < 600"), folder, cells=6)
    live = store.filter("vec_id >= 100")
    asked = store.filter("vec_id IN (700, 800, 150, 1002)").select(F.col("vec_id").alias("query_id"), "embedding")
    all_cells = {(r.query_id, r.vec_id, r.rank) for r in vectors.search(live, asked, 10, folder, probes=6).collect()}
    assert all_cells == {(r.query_id, r.vec_id, r.rank) for r in vectors.knn(live, asked, 10).collect()}
    state = vectors.index_state(live, folder).first()
    assert (state.live, state.indexed, state.tail, state.dead, state.due) == (802, 600, 302, 100, "none")
    vectors.extend_index(live, folder)
    assert vectors.index_state(live, folder).first().tail == 2  # a zero vector and one of another width stay outside


def test_index_maintenance(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BUILD_AT", 200)
    monkeypatch.setattr(vectors, "EXTEND_AT", 50)
    store = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(lcg(600, 8))], "vec_id long, embedding array<float>")
    folder = f"file://{tmp_path}/index"
    assert vectors.maintain(store.filter("vec_id < 100"), folder, 4) == "none"
    assert vectors.maintain(store.filter("vec_id < 400"), folder, 4) == "build"
    assert vectors.maintain(store.filter("vec_id < 440"), folder, 4) == "none"
    assert vectors.maintain(store.filter("vec_id < 500"), folder, 4) == "extend"
    assert vectors.maintain(store.filter("vec_id >= 200"), folder, 4) == "rebuild"


def test_search_of_documents_and_case(spark):
    rows = [(i, [1.0, i / 10], f"d{i % 3}", None if i == 4 else f"c{i % 2}") for i in range(8)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>, document_id string, case_id string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], [], None), (2, [1.0, 0.0], ["d0", "d2"], "c0"), (3, [1.0, 0.0], None, "c9"), (4, [1.0, 0.0], ["d1"], None)], "query_id long, embedding array<double>, docs array<string>, own string")
    got = {q: sorted(r.vec_id for r in vectors.knn(store, asked, 10, documents="docs", case="own").filter(F.col("query_id") == q).collect()) for q in (1, 2, 3, 4)}
    assert got == {1: list(range(8)), 2: [0, 2, 6], 3: [], 4: [1, 4, 7]}
    assert vectors.knn(store.limit(0), asked, 3).count() == 0 and vectors.knn(store, asked.limit(0), 3).count() == 0


def test_distance_is_never_negative(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0000001, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert [r.d for r in df.select(vectors.distance("a", "b").alias("d")).collect()] == [0.0, 1.0]


def test_cosine_of_odd_pairs(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, F.array(F.lit(1.0)))) == 0.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(2.0), F.lit(0.0)))) == 1.0


# --- fusion and evaluation -----------------------------------------------------------------------------------------


def test_fusion_adds_reciprocal_ranks_and_survives_an_empty_list(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    got = [(r.chunk_id, round(r.score, 6)) for r in hybrid.rrf([a, b]).orderBy("rank").collect()]
    best = 1 / 61 + 1 / 62
    assert got == [("y", 1.0), ("x", round((1 / 61) / best, 6)), ("z", round((1 / 62) / best, 6))]
    alone = hybrid.rrf([a, b.limit(0)]).orderBy("rank").collect()
    assert [r.chunk_id for r in alone] == ["x", "y"]


def test_hits_without_a_document_fall_away_after_ranking(spark):
    hits = spark.createDataFrame([(1, "c1", 1.0, 1), (1, "gone", 0.9, 2)], "query_id int, chunk_id string, score double, rank int")
    passages = spark.createDataFrame([("c1", "d", "text", 4)], "chunk_id string, document_id string, text string, page int")
    docs = spark.createDataFrame([("d", "file.pdf", "k")], "document_id string, document_name string, case_id string")
    cases = spark.createDataFrame([("k", "R-1")], "id string, reference string")
    out = hybrid.hydrate(hits, passages, docs, cases)
    assert out.count() == 1
    assert hybrid.context_blocks(out).first().context == "[1] file.pdf (R-1, p. 4)\ntext"


def test_headers_help_the_hashed_embedder(spark):
    passages = [("a", "case one", "The notice period is thirty days."), ("b", "case two", "The notice period is sixty days."), ("c", "case three", "The notice period is ninety days.")]
    questions = [("a", "notice period in case one"), ("b", "notice period in case two"), ("c", "notice period in case three")]

    def mrr(with_header):
        p = spark.createDataFrame([(i, f"{h} {t}" if with_header else t) for i, h, t in passages], "id string, text string")
        q = spark.createDataFrame(questions, "id string, text string")
        ids = {"a": 1, "b": 2, "c": 3}
        num = F.element_at(F.create_map(*[F.lit(y) for kv in ids.items() for y in kv]), F.col("id")).cast("long")
        store = embedding.embed(p, "id", "text").select(num.alias("vec_id"), "embedding")
        asked = embedding.embed(q, "id", "text").select(num.alias("query_id"), "embedding")
        ranked = vectors.knn(store, asked, 3).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")
        return hybrid.metrics(ranked, asked.select("query_id", F.col("query_id").alias("chunk_id")), 1).first().recall

    assert mrr(True) == 1.0 and mrr(True) > mrr(False)


def test_hash_values():
    assert embedding.fnv1a(b"") == 0xCBF29CE484222325 and embedding.fnv1a(b"a") == 0xAF63DC4C8601EC8C


# --- passages ------------------------------------------------------------------------------------------------------


def _chunks(spark, rows):
    return chunking.chunks(spark.createDataFrame(rows, "document_id string, text string, pages array<string>")).orderBy("document_id", "ordinal").collect()


def test_passages_of_pages_text_and_nothing(spark):
    sentence = "This is a sentence that fills the page. "
    rows = [("a", None, [None, "", sentence * 60, " last page "]), ("b", "first paragraph\n\n second", None), ("c", "  \n ", []), ("d", None, None), ("e", "text", ["", None]), ("b", "first paragraph\n\n second", None)]
    got = _chunks(spark, rows)
    assert {r.document_id for r in got} == {"a", "b", "e"}
    assert [r.text for r in got if r.document_id == "b"] == ["first paragraph second"]
    a = [r for r in got if r.document_id == "a"]
    assert a[0].page == 3 and all(len(r.text.encode()) <= 1400 for r in a) and [r.ordinal for r in a] == list(range(len(a)))
    assert [r.page for r in got if r.document_id == "e"] == [None]


def test_passages_overlap_by_whole_units(spark):
    text = " ".join(f"Sentence number {i} says something about the matter at hand." for i in range(200))
    got = _chunks(spark, [("x", text, None)])
    for a, b in zip(got, got[1:]):
        assert b.start_off < a.end_off and a.end_off - b.start_off < 300
    assert "Sentence number 199" in got[-1].text


# --- tree, graph, sheets -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("case:1", "case-01", "case", "Lease dispute", None, 0, 0, "Open", "case-01", "1", None),
        ("case:2", "case-02", "case", "Other", None, 0, 1, "Open", "case-02", "2", None),
        ("document:a", "case-01/lease.pdf", "document", "lease.pdf", "case:1", 1, 2, "Ready", "pdf", "1", "a"),
        ("document:b", "loose.txt", "document", "loose.txt", None, 0, 3, "Ready", "txt", None, "b"),
        ("person:p:1", "case-01/p", "person", "Ann", "case:1", 1, 4, "Witness", None, "1", None),
    ]
    return spark.createDataFrame(rows, "id string, node_key string, kind string, label string, parent_id string, depth int, ordinal long, status string, detail string, case_id string, document_id string").cache()


def test_mentions_and_what_is_none(spark, nodes):
    t = spark.createDataFrame([(1, "see @Case-01/Lease.pdf and @case-01, mail a@b.c"), (2, None), (3, "@"), (4, "@loose.txt @loose.txt")], "k int, t string")
    got = tree.mentions(t, "k", "t")
    assert sorted((r.k, r.place, r.handle) for r in got.collect()) == [(1, 1, "case-01/lease.pdf"), (1, 2, "case-01"), (4, 1, "loose.txt"), (4, 2, "loose.txt")]
    assert sorted((r.k, r.document_id, r.first_place) for r in tree.mentioned_documents(got, nodes, "k").collect()) == [(1, "a", 1), (4, "b", 1)]
    parts = tree.segments(t, "k", "t").orderBy("k", "place").collect()
    assert "".join(r.value for r in parts if r.k == 1) == "see @Case-01/Lease.pdf and @case-01, mail a@b.c"
    assert [r.kind for r in parts if r.k == 1] == ["text", "mention", "text", "mention", "text"]


def test_hidden_cases_hide_their_children(spark, nodes):
    none = spark.createDataFrame([], "id string")
    assert {r.id for r in tree.visible(nodes, none, ["case"]).collect()} == {"document:b"}
    closed = spark.createDataFrame([("case:1",)], "id string")
    assert {r.id for r in tree.visible(nodes, closed).collect()} == {"case:1", "case:2", "document:b"}


def test_ranking_and_lookup(spark, nodes):
    assert [r.id for r in tree.rank_mentions(nodes, "lease").collect()] == ["document:a", "case:1"]
    assert tree.rank_mentions(nodes, " ").count() == 0 and tree.rank_mentions(nodes, "a", 0).count() == 0
    f = spark.createDataFrame([("case-01",), ("lea",), ("zz",), ("  ",)], "fragment string")
    assert {(r.fragment, r.id, r.more) for r in tree.resolve(nodes, f).collect()} == {("case-01", "case:1", 2), ("lea", "document:a", 0)}


def test_filter_keeps_parents(spark, nodes):
    assert {r.id for r in tree.filter_tree(nodes, "witness").collect()} == {"person:p:1", "case:1"}


def test_graph_rows_do_not_overlap(spark, nodes):
    items = graph.items(nodes).orderBy("y").collect()
    assert [(r.id, r.y) for r in items] == [("document:a", 0.0), ("person:p:1", 56.0)]
    root = graph.roots(nodes).first()
    assert (root.y, root.connections) == (28.0, 2)
    assert graph.edges(nodes).count() == 4


def test_circles_of_any_length_are_found(spark):
    f = [(1, 0, 0, "=B1+1"), (1, 0, 1, "=A1+1"), (1, 0, 2, "=A1"), (1, 5, 0, "=SUM(D1:E2)"), (1, 6, 0, "=A6*2"), (1, 7, 0, "=A8")]
    got = {(r.r, r.c): r.level for r in sheet.calculation_levels(spark.createDataFrame(f, "sheet_id int, r int, c int, f string")).collect()}
    assert got == {(0, 0): None, (0, 1): None, (0, 2): None, (5, 0): 1, (6, 0): 2, (7, 0): None}


def test_lines_span_parts_and_no_task_sees_a_whole_feed(spark, data):
    rows = [("a", 1, "on"), ("a", 2, "e\r"), ("a", 3, "\ntw"), ("a", 4, "o\n\n"), ("a", 5, None), ("a", 6, "three\r"), (None, 1, "x\ny"), (None, 2, "z\n"), ("b", 1, "\n")]
    got = sorted((r.k or "", r.place, r.line) for r in folds.lines(spark.createDataFrame(rows, "k string, n int, t string"), "k", "n", "t").collect())
    assert got == [("", 0, "x"), ("", 1, "yz"), ("a", 0, "one"), ("a", 1, "two"), ("a", 3, "three\r")]

    props = spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_id", F.concat(F.substring("props", 1, 5), F.lit("\r\n"), F.expr("substring(props, 6)")).alias("part"))
    feeds: dict = {}
    for r in sorted(props.collect(), key=lambda r: r.event_id):
        feeds[r.user_id] = feeds.get(r.user_id, "") + (r.part or "")
    want = sorted((u, i, line) for u, w in feeds.items() for i, line in enumerate(re.split(r"\r?\n", w)) if line)
    assert sorted(map(tuple, folds.lines(props, "user_id", "event_id", "part").collect())) == want

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are brought together again
    try:
        hot = folds.lines(spark.range(4000).select(F.lit(1).alias("k"), "id", F.concat(F.col("id").cast("string"), F.lit("\n")).alias("t")), "k", "id", "t")
        assert hot.groupBy(F.spark_partition_id()).count().count() > 1
        assert hot.filter("place <> CAST(line AS int)").isEmpty() and hot.count() == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_long_chains_get_their_levels(spark):
    f = [(1, r, 0, "=1" if r == 0 else f"=A{r}+B1") for r in range(450)] + [(1, 0, 3, "=A450+A7+E1"), (1, 0, 4, "=D1"), (2, 0, 0, "=A2"), (2, 1, 0, "=A3+A4"), (2, 2, 0, "=A4"), (2, 3, 0, "=5")]
    f += [(3, r, 0, f"=A{(r + 1) % 90 + 1}") for r in range(90)] + [(3, 0, 1, "=A1")]
    got = {(r.sheet_id, r.r, r.c): r.level for r in sheet.calculation_levels(spark.createDataFrame(f, "sheet_id int, r int, c int, f string")).collect()}
    assert all(got[1, r, 0] == r + 1 for r in range(450)) and got[1, 0, 3] is None and got[1, 0, 4] is None
    assert [got[2, r, 0] for r in range(4)] == [4, 3, 2, 1]
    assert {got[3, r, 0] for r in range(90)} | {got[3, 0, 1]} == {None} and len(got) == len(f)


def test_ancestors_of_deep_trees_and_circles(spark):
    deep = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)], "id string, parent_id string")
    got = {(r.id, r.ancestor): r.steps for r in tree.ancestors(deep).collect()}
    assert got == {(f"n{i}", f"n{j}"): i - j for i in range(40) for j in range(i)}
    with pytest.raises(ValueError):
        tree.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, parent_id string"))


def test_formula_corners(spark):
    r = F.array(F.lit("1"), F.lit("x"), F.lit(""), F.lit("$2,000"))
    assert one(spark, m.sum_(r)) == 2001.0 and one(spark, m.average(F.array().cast("array<string>"))) is None
    assert one(spark, m.round_(F.lit(-2.5), F.lit(0))) == -2.0 and one(spark, m.round_(F.lit(2.5), F.lit(0))) == 3.0
    assert one(spark, m.number(F.lit("3 days"))) == 3.0 and one(spark, m.number(F.lit(""))) == 0.0 and one(spark, m.number(F.lit("abc"))) is None
    assert one(spark, m.textjoin(",", True, F.array(F.lit("a"), F.lit(""), F.lit("b")))) == "a,b"
    assert one(spark, m.sumproduct(F.array(F.lit("2")), F.array(F.lit("3"), F.lit("4")))) is None
    assert one(spark, m.find(F.lit("z"), F.lit("abc"))) is None and one(spark, m.mod(F.lit(-7), F.lit(3))) == -1.0
    assert one(spark, m.display(F.lit(0.1) + F.lit(0.2))) == "0.3"
    assert [one(spark, m.column_name(F.lit(i))) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


# --- text ----------------------------------------------------------------------------------------------------------


def test_text_corners(spark):
    html = "<html><head><title>x</title></head><body><script>var a='<p>';</script><p>A &amp;lt; B&nbsp;</p></body></html>"
    assert one(spark, x.strip_html(F.lit(html))) == "A < B"
    assert one(spark, x.collapse(F.lit(" a\u00a0\u3000 b\n"))) == "a b"
    assert one(spark, x.word_count(F.lit("  "))) == 0
    assert [one(spark, x.format_bytes(F.lit(n))) for n in (0, 512, 1536, 5 * 1024**4)] == ["0 B", "512 B", "1.5 KB", "5120.0 GB"]
    assert one(spark, x.snippet(F.lit("ab cd"), 3)) == "ab..."
    assert one(spark, x.csv_field(F.lit('a"b'))) == '"a""b"' and one(spark, x.csv_field(F.lit(None).cast("string"))) == ""
    assert one(spark, x.context_header(F.lit(" "), F.lit("f.pdf"), F.lit(None).cast("int"))) == "f.pdf"
    assert one(spark, x.task_prefix(F.lit("intfloat/multilingual-e5-large"), True)) == "query: "
    assert one(spark, x.diagnosis(F.lit("HTTP 3"))) is None


# --- what must not be cut off --------------------------------------------------------------------------------------


def test_a_year_with_large_numbers_only_has_a_free_one(spark):
    df = spark.createDataFrame([(f"2020-CV-{n}",) for n in (1500, 1501)] + [(f"2021-CV-{n:04}",) for n in range(1, 1202)] + [("2022-CV-0001",), ("2022-CV-0003",), ("2023-CV-0",), ("x",), (None,)], "reference string")
    assert {r.year: r.free_number for r in catalog.smallest_free(df).collect()} == {"2020": 1, "2021": 1202, "2022": 2, "2023": 1}


def test_long_documents_are_cut_without_copies_of_all_units(spark):
    text = "\n\n".join(f"Paragraph {i} of a very long deed. " * 12 for i in range(24_000))
    assert len(text) > 10_000_000
    df = spark.createDataFrame([("a", text, None)], "document_id string, text string, pages array<string>")
    n = chunking.chunk_sizes(df).first()
    got = chunking.chunks(df).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size"), F.sum("token_estimate").alias("tokens")).first()
    assert (got.n, got.tokens) == (n.n_chunks, n.n_tokens) and got.size <= 1400


def test_filters_reach_the_scan(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    plan = catalog.case_list(t("cases"), t("categories"), t("files"), t("case_people"), status="Open")._jdf.queryExecution().toString()
    assert "EqualTo(status,Open)" in plan


def test_segments_give_any_text_back(spark):
    texts = ["a@b.c @case-1/x, \u0001 and @Y!", "@only", "", None, "none", "@a@b @c\n@d "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = tree.segments(df, "id", "text").orderBy("id", "place").collect()
    for i, want in enumerate(texts):
        assert "".join(r.value for r in rows if r.id == i) == (want or "")
    spans = {(r.id, r.handle, r.start, r.end) for r in tree.mention_spans(df, "id", "text").collect()}
    assert spans == {(0, "case-1/x", 6, 15), (0, "y", 23, 25), (1, "only", 0, 5), (5, "a", 0, 2), (5, "c", 5, 7), (5, "d", 8, 10)}


def test_fragments_at_the_caret(spark):
    df = spark.createDataFrame([("see @ca now", 7), ("see @", 5), ("see @ca now", 11), ("a@ca", 4), (None, 1)], "t string, at int")
    assert [r.f for r in df.select(tree.fragment_at(F.col("t"), F.col("at")).alias("f")).collect()] == ["ca", "", None, None, None]


def test_references_outside_texts_and_words_only(spark):
    df = spark.createDataFrame([("s", 0, 0, '=B1&"see C3 "" D4"+XYZZ9+SUM(A2:A3)')], "sheet_id string, r int, c int, f string")
    assert {(r.rr, r.rc) for r in sheet.references(df).collect()} == {(0, 1), (1, 0), (2, 0)}


def test_errors_are_named(spark):
    df = spark.createDataFrame([("1", "0"), ("x", "1"), ("#REF!", "2"), ("-4", "0.5"), ("6", "3")], "a string, b string")
    e = lambda op: m.error_code(op, F.col("a"), F.col("b")).alias(op)
    got = df.select(e("/"), e("^"), m.error_code("SQRT", F.col("a")).alias("SQRT"), m.error_code("AVERAGE", F.array("a")).alias("AVERAGE")).collect()
    assert [r["/"] for r in got] == ["#DIV/0!", "#VALUE!", "#REF!", None, None]
    assert [r["^"] for r in got] == [None, "#VALUE!", "#REF!", "#NUM!", None] and got[3]["SQRT"] == "#NUM!"
    assert [r["AVERAGE"] for r in got] == [None, "#DIV/0!", "#DIV/0!", None, None]


def test_new_cases_without_a_reference_get_the_next_ones(spark):
    kind = "id string, reference string, title string, category_id string, status string, description string, opened_at timestamp_ntz, closed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
    cases = spark.createDataFrame([("a", "2022-CV-0007", "A", *[None] * 7), ("b", "2021-CV-0009", "B", *[None] * 7)], kind)
    edits = spark.createDataFrame([("n2", None, "N", None, None, None), ("n1", " ", "M", None, None, None), ("n3", "own", "O", None, None, None)], "id string, reference string, title string, category_id string, status string, description string")
    got = {r.id: r.reference for r in consistency.upsert_cases(cases, edits, "2022-06-15 12:00:00").collect()}
    assert got == {"a": "2022-CV-0007", "b": "2021-CV-0009", "n1": "2022-CV-0008", "n2": "2022-CV-0009", "n3": "own"}


def test_default_categories_and_new_vectors(spark):
    none = spark.createDataFrame([], "id string, name string, practice_area string, color string, created_at timestamp_ntz")
    some = consistency.seeded(none, "2022-01-01 00:00:00")
    assert some.count() == 5 and consistency.seeded(some, "2023-01-01 00:00:00").count() == 5
    store = spark.createDataFrame([("d", "d:0", [1.0]), ("e", "e:0", [2.0]), ("d", "d:1", [3.0])], "document_id string, chunk_id string, embedding array<double>")
    texts = spark.createDataFrame([("d", "d:0", "x"), ("d", "d:1", None), ("e", "e:0", "y")], "document_id string, chunk_id string, text string")
    stale = spark.createDataFrame([("d",)], "document_id string")
    out = consistency.re_embedded(store, stale, texts, lambda p: p.select("chunk_id", F.when(F.col("text").isNotNull(), F.array(F.lit(9.0))).alias("embedding")))
    assert {r.chunk_id: r.embedding for r in out.collect()} == {"d:0": [9.0], "e:0": [2.0], "d:1": [3.0]}


def test_context_only_recall(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, "c", 2)], "query_id int, chunk_id string, rank int")
    targets = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True), (4, "z", False)], "query_id int, chunk_id string, in_text boolean")
    assert abs(hybrid.context_only_recall(ranked, targets).first().recall - 1 / 3) < 1e-9


def test_formats_and_service_errors(spark):
    df = spark.createDataFrame([("2024-01-05T10:00:00Z", "dial: connection refused"), ("soon", "HTTP 429"), (None, " ")], "d string, e string")
    got = df.select(x.format_date("d").alias("d"), x.service_error("e").alias("e")).collect()
    assert [tuple(r) for r in got] == [("Jan 5, 2024", "unreachable"), ("soon", "rate limit"), (None, None)]
    assert one(spark, x.same_model(F.lit("bge"), F.lit("bge:latest"))) and not one(spark, x.same_model(F.lit("bge"), F.lit("bge:v2")))


def test_an_embedder_must_give_a_row_for_a_row(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string").coalesce(1)
    with pytest.raises(Exception, match="embedder gave"):
        embedding.embed(df, "id", "text", embedder=lambda batches: (b.slice(0, 1).select(["id"]).append_column("embedding", pa.array([[1.0]], pa.list_(pa.float32()))) for b in batches)).collect()


def test_scratch_goes_with_its_block(spark):
    from docketry.session import cut, scratch

    with scratch(spark) as folder:
        df = cut(spark.range(5).toDF("x"))
        assert df.count() == 5
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert fs.exists(path)
    assert not fs.exists(path)


def test_event_streams_and_counts(spark):
    rows = [("a", 1, "data: one\r\nda"), ("a", 2, "ta: two\n\ndata: [DONE]\n"), ("a", 3, ": note")]
    got = folds.sse_data(folds.lines(spark.createDataFrame(rows, "k string, o int, t string"), "k", "o", "t"), "k").orderBy("place").collect()
    assert [r.data for r in got] == ["one", "two"]
    steps = spark.createDataFrame([("a", "search", 1, 4, None), ("a", "search", 2, None, 7), ("a", "search", 3, None, None)], "k string, step string, o int, found int, used int")
    assert [tuple(r) for r in folds.step_counts(steps, "k", "step", ["o"], "found", "used").collect()] == [("a", "search", 4, 7)]
    run = spark.createDataFrame([("d", "Extracting", 1, None), ("d", "Embedding", 2, 3), ("d", "Embedding", 3, 3), ("e", "Complete", 1, None)], "doc string, status string, o int, total int")
    assert {tuple(r) for r in folds.index_progress(run, "doc", "status", ["o"]).collect()} == {("d", "Embedding", 2, 3), ("e", "Complete", 0, None)}
