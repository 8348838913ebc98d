"""Queries over keyword, vector and hybrid search. Questions are all rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.operators import hybrid, keyword, vectors
from docketry.operators.catalog import once
from docketry.session import cut, shared_dir
from docketry.session import read_table as t

EVERY = 50


def _passages(s, b):
    return t(s, b, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), "text")


def _questions(s, b):
    return _passages(s, b).filter(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "text")


def _keyword(s, b, k):
    return keyword.search(_passages(s, b), _questions(s, b), k)


def _vector_questions(s, b):
    return t(s, b, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _document_vectors(s, b):
    """Documents with the vector number doc_id modulo the number of vectors: a convention of ours, as the tables have no link."""
    v = t(s, b, "embeddings")
    n = v.count()
    return t(s, b, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("vid"), (F.col("doc_id") % n).alias("vec_id")).join(v, "vec_id").select(F.col("vid").alias("vec_id"), "embedding", "label")


def _hybrid(s, b, limit=8):
    k = hybrid.over_fetch(limit)
    store = cut(_document_vectors(s, b))
    asked = store.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    near = vectors.knn(store, asked, k).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")
    return hybrid.rrf([near, _keyword(s, b, k)], limit)


def _hits(s, b):
    d = t(s, b, "documents")
    passages = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text", F.lit(None).cast("int").alias("page"))
    named = d.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("document_name"), "case_id")
    return hybrid.hydrate(_hybrid(s, b), passages, named, once(t(s, b, "cases")))


def _metrics(s, b):
    v, q = t(s, b, "embeddings"), _vector_questions(s, b)
    labels = v.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("its"))
    found = vectors.knn(v, q, 40).filter("vec_id <> query_id").select("query_id", F.col("vec_id").alias("chunk_id"), "rank")
    relevant = found.join(labels, "chunk_id").join(q.select("query_id", "label"), "query_id").filter("its = label").select("query_id", "chunk_id")
    asked = q.join(v.groupBy("label").count().filter(F.col("count") > 1), "label", "left_semi").select("query_id")
    m = hybrid.metrics(found, relevant, asked=asked)
    return m.select("questions", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


CELLS, PROBES = 16, 12


def _index(s, b):
    """An index of the vectors in the shared folder, built for this run."""
    folder = f"{shared_dir(s)}/docketry-index-{uuid.uuid4().hex}"
    vectors.build_index(t(s, b, "embeddings"), folder, cells=CELLS)
    return folder


def _ivf(s, b):
    return vectors.search(t(s, b, "embeddings"), _vector_questions(s, b).select("query_id", "embedding"), 10, _index(s, b), PROBES)


def _ivf_recall(s, b):
    """Whether the index finds nine tenths of the true neighbours, with the parameters of `knn_ivf`."""
    exact = vectors.knn(t(s, b, "embeddings"), _vector_questions(s, b), 10)
    return vectors.recall(_ivf(s, b), exact).select((F.col("recall") >= 0.9).alias("enough"))


def _index_state(s, b):
    """What the index needs after a tenth of the vectors went and another tenth came in since it was built."""
    v = t(s, b, "embeddings")
    folder = f"{shared_dir(s)}/docketry-index-{uuid.uuid4().hex}"
    vectors.build_index(v.filter("vec_id % 10 <> 0"), folder, cells=CELLS)
    return vectors.index_state(v.filter("vec_id % 10 <> 1"), folder).drop("index_width", "main_width")


def _scoped(s, b):
    """Documents' vectors; each question wants its own case and, where its number is even, some documents by their type."""
    d = t(s, b, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("doc_type", F.lit("none")).alias("document_id"), "case_id")
    store = cut(_document_vectors(s, b).drop("label").join(d, "vec_id"))
    wants = F.when(F.col("vec_id") % 100 == 0, F.array(F.col("document_id"), F.lit("letter"))).otherwise(F.array().cast("array<string>"))
    asked = store.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding", wants.alias("types"), F.col("case_id").alias("own"))
    return vectors.knn(store, asked, 10, documents="types", case="own").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _ready(s, b):
    """Keyword search over the extracted texts, with every fiftieth document's title as a question; only documents that are Ready may come out."""
    files = once(t(s, b, "files"))
    passages = t(s, b, "extracted").filter("text IS NOT NULL").dropDuplicates(["document_id"]).select(F.col("document_id").alias("chunk_id"), "document_id", "text")
    asked = files.select(F.col("id").alias("query_id"), F.col("file_name").alias("text"))
    return keyword.search(passages, asked, 10, keyword.ready(passages, files)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _view(s, b):
    d = t(s, b, "documents")
    named = d.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("document_name"), "case_id")
    passages = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(None).cast("int").alias("page"))
    return keyword.view(keyword.search(_passages(s, b), _questions(s, b), 50), passages, named, once(t(s, b, "cases")), 60).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "document_name", "case_reference")


WORDS = ["warehouse", "lease", "the", "of", "contract"]

QUERIES = {
    "query_terms": lambda s, b: once(t(s, b, "messages")).filter("content IS NOT NULL").select("id", F.array_join(keyword.terms("content"), " ").alias("terms")),
    "bm25_search": lambda s, b: _keyword(s, b, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
    "keyword_view": lambda s, b: keyword.scaled(_keyword(s, b, 10)).select("query_id", "chunk_id", F.round("score", 6).alias("score")),
    "bm25_filtered": lambda s, b: keyword.search(_passages(s, b), _questions(s, b), 10, t(s, b, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
    "ready_search": _ready,
    "search_view": _view,
    "knn_scoped": _scoped,
    "knn_recall": _ivf_recall,
    "index_state": _index_state,
    "hit_documents": lambda s, b: hybrid.distinct_documents(_hits(s, b).withColumn("document_id", F.col("case_id"))).withColumnRenamed("n_documents", "n_cases"),
    "recipe_inputs": lambda s, b: hybrid.recipe_inputs(t(s, b, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.coalesce("source", F.lit("")).alias("header")), "nomic-embed-text").select("chunk_id", "recipe", F.md5("input").alias("input")),
    "highlight": lambda s, b: t(s, b, "documents").select("doc_id", keyword.highlight(F.col("text"), WORDS).alias("marked")),
    "snippet_around": lambda s, b: t(s, b, "documents").select("doc_id", keyword.snippet_around(F.col("text"), ["warehouse", "lease"]).alias("snippet")),
    "knn_exact": lambda s, b: vectors.knn(t(s, b, "embeddings"), _vector_questions(s, b), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank"),
    "knn_filtered": lambda s, b: vectors.knn(t(s, b, "embeddings"), _vector_questions(s, b), 10, label="label").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank"),
    "knn_ivf": _ivf,
    "vector_norms": lambda s, b: t(s, b, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 5).alias("norm"), F.round(vectors.cosine(F.col("embedding"), F.reverse("embedding")), 5).alias("mirror")),
    "dim_histogram": lambda s, b: vectors.widths(t(s, b, "embeddings")),
    "hybrid_rrf": lambda s, b: _hybrid(s, b).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
    "retrieval_metrics": _metrics,
    "citations": lambda s, b: hybrid.citations(_hits(s, b)).select("query_id", "n", "chunk_id", "document_id", F.round("score", 6).alias("score"), "snippet"),
    "context_blocks": lambda s, b: hybrid.context_blocks(_hits(s, b)).select("query_id", F.sha2("context", 256).alias("context")),
}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(keyword.STOPWORDS)))


def _terms(c: str) -> str:
    words = f"regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')"
    return f"list_distinct_in_order({words})".replace(
        f"list_distinct_in_order({words})",
        f"(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter({words}, lambda w: w <> '' AND (regexp_full_match(w, '[0-9]+') OR (length(w) > 1 AND w NOT IN ({_STOP})))), lambda w: [w])), lambda a, w: CASE WHEN list_contains(a, w[1]) THEN a ELSE list_concat(a, w) END))[1:16]",
    )


def _fold(c: str) -> str:
    return f"translate(regexp_replace(lower({c}), '\\p{{Mn}}+', '', 'g'), '{keyword.ACCENTED}', '{keyword.FOLDED}')"


def _bm25(k: int, allowed: str = "TRUE") -> str:
    return f"""
WITH p AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array({_fold('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n_all, avg(len(words)) AS mean_size FROM p),
po AS (SELECT chunk_id, len(words) AS size, unnest(words) AS token FROM p),
pt AS (SELECT chunk_id, size, token, count(*) AS tf FROM po GROUP BY ALL),
q AS (SELECT query_id, unnest(terms) AS term FROM (SELECT doc_id AS query_id, {_terms('text')} AS terms FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL)),
a AS (SELECT query_id, {_fold('term')} AS prefix FROM q),
v AS (SELECT x.token, y.prefix FROM (SELECT DISTINCT token FROM pt) x JOIN (SELECT DISTINCT prefix FROM a) y ON starts_with(x.token, y.prefix)),
f AS (SELECT prefix, chunk_id, size, CAST(sum(tf) AS DOUBLE) AS tf FROM pt JOIN v USING (token) GROUP BY ALL),
df AS (SELECT prefix, count(*) AS df FROM f GROUP BY prefix),
sc AS (SELECT prefix, chunk_id, CASE WHEN ln((n_all - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_all - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size)) AS part FROM f JOIN df USING (prefix), st),
h AS (SELECT query_id, chunk_id, sum(part) AS score FROM a JOIN sc USING (prefix) WHERE {allowed} GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM h) WHERE rank <= {k}"""


def _knn(k: int, where: str = "TRUE", store: str = "embeddings", asked: str = "(SELECT * FROM embeddings WHERE vec_id % 50 = 0)") -> str:
    unit = "list_transform(e, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(e, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"
    u = unit.replace("list_transform(e", "list_transform(embedding").replace("(e,", "(embedding,")
    return f"""
WITH v AS (SELECT vec_id, label, {u} AS u FROM {store}), q AS (SELECT vec_id AS query_id, label AS want, {u} AS w FROM {asked}),
s AS (SELECT query_id, vec_id, round(list_inner_product(u, w), 9) AS score FROM v, q WHERE {where})
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


_STORE = "(SELECT d.doc_id AS vec_id, e.embedding, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) WHERE d.text IS NOT NULL)"
_HYBRID = f"""
WITH kw AS ({_bm25(32)}), kn AS ({_knn(32, store=_STORE, asked=f"(SELECT * FROM {_STORE} WHERE vec_id % 50 = 0)")}),
parts AS (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS part FROM kw UNION ALL SELECT query_id, vec_id, 1.0 / (60 + rank) FROM kn),
f AS (SELECT query_id, chunk_id, CAST(sum(part) AS DOUBLE) AS score FROM parts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM f)
SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS score, rank FROM r WHERE rank <= 8"""
_HITS = f"""(SELECT h.query_id, h.chunk_id, h.score, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS n, d.text, 'document ' || d.doc_id AS document_name, c.reference
    FROM ({_HYBRID}) h JOIN documents d ON d.doc_id = h.chunk_id LEFT JOIN (SELECT DISTINCT * FROM cases) c ON c.id = d.case_id)"""

def _bm25_of(passages: str, questions: str, k: int, allowed: str) -> str:
    """BM25 over other tables: the same statement with its two sources exchanged."""
    base = _bm25(k, allowed)
    return base.replace("SELECT doc_id AS chunk_id, list_filter", "SELECT chunk_id, list_filter").replace("FROM documents WHERE text IS NOT NULL),\nst", f"FROM {passages}),\nst").replace("SELECT doc_id AS query_id,", "SELECT query_id,").replace("FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL", f"FROM {questions}")


_READY = _bm25_of(
    "(SELECT DISTINCT document_id AS chunk_id, text FROM extracted WHERE text IS NOT NULL)", "(SELECT DISTINCT id AS query_id, file_name AS text FROM files)", 10, "chunk_id IN (SELECT id FROM files WHERE index_status = 'Ready')"
)
_SCOPED_STORE = "(SELECT d.doc_id AS vec_id, e.embedding, CAST(NULL AS INTEGER) AS label, coalesce(d.doc_type, 'none') AS document_id, d.case_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) WHERE d.text IS NOT NULL)"

SQL = {
    "ready_search": f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_READY})",
    "search_view": f"""SELECT query_id, chunk_id, round(score / greatest(m, 1e-12), 6) AS score, 'document ' || d.doc_id AS document_name, c.reference AS case_reference
        FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM ({_bm25(50)})) h JOIN documents d ON d.doc_id = h.chunk_id LEFT JOIN (SELECT DISTINCT * FROM cases) c ON c.id = d.case_id""",
    "knn_scoped": f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_knn(10, "(own IS NULL OR own = case_id) AND (query_id % 100 <> 0 OR document_id IN (own_type, 'letter'))", store=_SCOPED_STORE, asked=f"(SELECT * FROM {_SCOPED_STORE} WHERE vec_id % 50 = 0)").replace("label, list_transform", "document_id, case_id, list_transform", 1).replace("label AS want, list_transform", "document_id AS own_type, case_id AS own, list_transform")})""",
    "knn_recall": "SELECT TRUE AS enough",
    "index_state": """SELECT count(*) FILTER (vec_id % 10 <> 1) AS live, count(*) FILTER (vec_id % 10 <> 0) AS indexed, count(*) FILTER (vec_id % 10 = 0) AS tail, count(*) FILTER (vec_id % 10 = 1) AS dead,
        CASE WHEN count(*) FILTER (vec_id % 10 <> 1) >= 20000 AND count(*) FILTER (vec_id % 10 = 0) > 4000 THEN 'extend' ELSE 'none' END AS due FROM embeddings""",
    "hit_documents": f"SELECT query_id, count(DISTINCT d.case_id) AS n_cases FROM ({_HYBRID}) h JOIN documents d ON d.doc_id = h.chunk_id GROUP BY query_id",
    "recipe_inputs": """SELECT doc_id AS chunk_id, recipe, md5(CASE WHEN recipe IN ('prefix', 'both') THEN 'search_document: ' ELSE '' END || CASE WHEN recipe IN ('header', 'both') AND coalesce(source, '') <> '' THEN source || chr(10) || chr(10) ELSE '' END || text) AS input
        FROM documents, unnest(['plain', 'prefix', 'header', 'both']) r(recipe)""",
    "query_terms": f"SELECT id, array_to_string({_terms('content')}, ' ') AS terms FROM (SELECT DISTINCT ON (id) * FROM messages) WHERE content IS NOT NULL",
    "bm25_search": f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_bm25(10)})",
    "bm25_filtered": f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_bm25(10, 'chunk_id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')})",
    "keyword_view": f"SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM ({_bm25(10)})",
    "highlight": "SELECT doc_id, regexp_replace(text, '(contract|warehouse|lease|the)', '<b>\\1</b>', 'gi') AS marked FROM documents",
    "snippet_around": """WITH d AS (SELECT doc_id, text, least(nullif(strpos(lower(text), 'warehouse'), 0), nullif(strpos(lower(text), 'lease'), 0)) - 1 AS a FROM documents)
        SELECT doc_id, CASE WHEN length(text) <= 280 THEN text WHEN a >= 140 THEN '…' || substring(text, a - 93 + 1, 280) || CASE WHEN a - 93 + 280 < length(text) THEN '…' ELSE '' END ELSE text[1:280] || '…' END AS snippet FROM d""",
    "knn_exact": f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_knn(10)})",
    "knn_filtered": f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_knn(10, 'label = want')})",
    "vector_norms": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
        SELECT vec_id, round(sqrt(list_inner_product(v, v)), 5) AS norm, round(list_inner_product(v, list_reverse(v)) / list_inner_product(v, v), 5) AS mirror FROM e""",
    "dim_histogram": "SELECT width, n, row_number() OVER (ORDER BY n DESC, width DESC) = 1 AS main FROM (SELECT len(embedding) AS width, count(*) AS n FROM embeddings GROUP BY 1)",
    "hybrid_rrf": f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_HYBRID})",
    "retrieval_metrics": f"""WITH k AS (SELECT * FROM ({_knn(40)}) WHERE vec_id <> query_id), b AS (SELECT k.query_id, min(rank) AS rank FROM k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings e ON e.vec_id = k.vec_id WHERE a.label = e.label GROUP BY 1),
        q AS (SELECT vec_id FROM embeddings x WHERE vec_id % 50 = 0 AND EXISTS (SELECT 1 FROM embeddings y WHERE y.label = x.label AND y.vec_id <> x.vec_id))
        SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM q LEFT JOIN b ON b.query_id = q.vec_id""",
    "citations": f"SELECT query_id, n, chunk_id, chunk_id AS document_id, round(score, 6) AS score, CASE WHEN length(text) <= 320 THEN text ELSE regexp_replace(text[1:320], '[\\s\\x0b\\p{{Z}}]+$', '') || '...' END AS snippet FROM {_HITS}",
    "context_blocks": f"SELECT query_id, sha256(string_agg('[' || n || '] ' || document_name || ' (' || coalesce(reference, 'page unknown') || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS context FROM {_HITS} GROUP BY query_id",
}
