"""Lexical, dense and hybrid retrieval. Every fiftieth row asks, all rows answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.vectors import stub_digest, stub_rows, truncate_norm
from lorekeep.operators import chunking, evaluate, fusion, lexical, vector, verify
from lorekeep.sources.tables import materialise, table

TOP = 10
#: Components of the deterministic embeddings of texts.
DIM = 16


def _title(text):
    """First line of a text."""
    return F.split(text, "\n").getItem(0)


def _queries(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 50 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), _title(F.col("text")).alias("query"))


def _lexical(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    docs = table(spark, d, "documents")
    return lexical.bm25_top(docs, asked or _queries(docs), TOP)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.boosts(_lexical(spark, d), ["query_id"]).select("query_id", "doc_id", "score", "boost", "rank")


def bm25_by_project(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    q = docs.where("doc_id % 50 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), "project", _title(F.col("text")).alias("query"))
    scored = lexical.bm25_scores(docs.where("project is not null"), q.where("project is not null"), scope=["project"])
    return lexical.top_k(scored, TOP, ["query_id"]).select("query_id", "project", "doc_id", "score", "rank")


def doc_term_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    stats = lexical.term_stats(lexical.postings(docs, "doc_id", "text"), docs.agg(F.count(F.lit(1)).alias("n")))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return lexical.doc_lengths(table(spark, d, "documents"), "doc_id", "text")


def _dense(spark: SparkSession, d: str, scope: list[str] | None = None) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), *(scope or []))
    return vector.search_batch(e, q, TOP, scope=scope)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d)


def vector_topk_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, ["label"])


def centroid_classify(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.classify(e, vector.centroids(e, "label"), "label")


def planner_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.classify(e, vector.centroids(e, "label"), "label", threshold=0.15)


def truncated_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(truncate_norm(F.col("embedding"), 16)).alias("pos", "x"))
    return e.select("vec_id", "pos", F.round("x", 6).alias("x"))


def _dense_texts(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, rank): documents nearest to each title by the embeddings of their texts."""
    docs = table(spark, d, "documents").where("text is not null")
    known = docs.select("doc_id", stub_digest(F.col("text")).alias("embedding"))
    few = (asked or _queries(docs)).select("query_id", stub_digest(F.col("query")).alias("qvec"))
    return vector.search_batch(known, few, TOP, "doc_id", decode=stub_rows(DIM))


def _fused(dense: DataFrame, lexical_arm: DataFrame) -> DataFrame:
    arms = [a.select("query_id", "doc_id", "rank") for a in (dense, lexical_arm)]
    fused = fusion.reciprocal_rank_fusion(arms, ["query_id"], "doc_id")
    return fused.where(F.col("rank") <= TOP).select("query_id", "doc_id", "score", "rank")


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The fused list, and the questions, which are read from the texts once."""
    asked = materialise(_queries(table(spark, d, "documents")), "questions")
    return _fused(_dense_texts(spark, d, asked), _lexical(spark, d, asked)), asked


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)[0]


def hybrid_verified(spark: SparkSession, d: str) -> DataFrame:
    dense = materialise(_dense_texts(spark, d), "dense")  # it ranks and it verifies
    fused = _fused(dense, _lexical(spark, d))
    sim = dense.select("query_id", "doc_id", "similarity")
    return verify.bucket_chunks(fused.join(sim, ["query_id", "doc_id"], "left")).select("query_id", "doc_id", "rank", "similarity", "bucket")


def search_context(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    few = hybrid_search(spark, d).where("rank <= 3")
    ranked = few.hint("shuffle_hash").join(docs, "doc_id")  # the texts are then not sorted
    return chunking.build_context(ranked, ["query_id"])


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Known-item search: each title should find its own document. ``retrieval_ablation`` has independent gold."""
    fused, asked = _hybrid(spark, d)
    ranked = fused.select("query_id", F.col("doc_id").alias("doc"), "rank")
    return evaluate.rank_metrics(ranked, asked.select("query_id", F.col("query_id").alias("doc")))


QUERIES = {
    f.__name__: f
    for f in (bm25_topk, bm25_by_project, doc_term_stats, doc_lengths, vector_topk, vector_topk_by_label, centroid_classify, planner_threshold, truncated_vectors, hybrid_search, hybrid_verified, search_context, retrieval_metrics)
}

_TOK = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_BM25 = f"""
tok AS (SELECT doc_id, project, coalesce(len({_TOK.format(x="text")}), 0) AS dl, {_TOK.format(x="text")} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tok),
q AS (SELECT doc_id AS query_id, unnest({_TOK.format(x="split_part(text, chr(10), 1)")}) AS term FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times), 6) AS score
       FROM post JOIN qt USING (term) JOIN df USING (term), corpus GROUP BY query_id, doc_id),
lex AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10)"""
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_DENSE = f"""
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
dense AS (SELECT * FROM (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, v.vec_id, round({_COS.format(a="v.e", b="q.e")}, 6) AS similarity FROM v, v q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10)"""
_STUB = "list_transform(range(16), lambda i: (CAST('0x' || substr(sha256({x}), CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) - 128) / 128.0::DOUBLE)"
_DENSE_TEXTS = f"""
ev AS (SELECT doc_id, {_STUB.format(x="text")} AS e FROM documents WHERE text IS NOT NULL),
qv AS (SELECT doc_id AS query_id, {_STUB.format(x="split_part(text, chr(10), 1)")} AS e FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
dense AS (SELECT * FROM (SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM
  (SELECT query_id, doc_id, round({_COS.format(a="ev.e", b="qv.e")}, 6) AS similarity FROM ev, qv)) WHERE rank <= 10)"""
_FUSED = f"""{_BM25}, {_DENSE_TEXTS},
arms AS (SELECT query_id, doc_id, rank, 0 AS arm FROM dense UNION ALL SELECT query_id, doc_id, rank, 1 FROM lex),
fused AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arm, first, doc_id) AS rank FROM
  (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(arm) AS arm, arg_min(rank, arm) AS first FROM arms GROUP BY query_id, doc_id)) WHERE rank <= 10)"""
_CLASS = f"""
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS pos FROM v) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, c.label AS l, round({_COS.format(a="e", b="c")}, 6) AS s FROM v, c),
b AS (SELECT vec_id, l, s FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, l) = 1)"""

SQL = {
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, score, round(score / max(score) OVER (PARTITION BY query_id), 4) AS boost, CAST(rank AS INTEGER) AS rank FROM lex",
    "bm25_by_project": f"""WITH tok AS (SELECT doc_id, project, coalesce(len({_TOK.format(x="text")}), 0) AS dl, {_TOK.format(x="text")} AS t FROM documents WHERE project IS NOT NULL),
corpus AS (SELECT project, count(*) AS n, avg(dl) AS avgdl FROM tok GROUP BY project),
q AS (SELECT doc_id AS query_id, project, unnest({_TOK.format(x="split_part(text, chr(10), 1)")}) AS term FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL AND project IS NOT NULL),
qt AS (SELECT query_id, project, term, count(*) AS times FROM q GROUP BY ALL),
post AS (SELECT doc_id, project, dl, term, count(*) AS tf FROM (SELECT doc_id, project, dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT project, term, count(*) AS df FROM post GROUP BY ALL),
sc AS (SELECT query_id, project, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times), 6) AS score
       FROM post JOIN qt USING (project, term) JOIN df USING (project, term) JOIN corpus USING (project) GROUP BY query_id, project, doc_id)
SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM (SELECT query_id, project, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10""",
    "doc_term_stats": f"WITH {_BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, corpus",
    "doc_lengths": f"SELECT doc_id, CAST(coalesce(len({_TOK.format(x='text')}), 0) AS INTEGER) AS dl FROM documents",
    "vector_topk": f"WITH {_DENSE} SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM dense",
    "vector_topk_by_label": f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM (SELECT query_id, label, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, v.label, v.vec_id, round({_COS.format(a="v.e", b="q.e")}, 6) AS similarity FROM v JOIN v q ON v.label = q.label AND q.vec_id % 50 = 0)) WHERE rank <= 10""",
    "centroid_classify": f"WITH {_CLASS} SELECT vec_id, l AS predicted, s AS similarity FROM b",
    "planner_threshold": f"WITH {_CLASS} SELECT vec_id, CASE WHEN s >= 0.15 THEN l END AS predicted, s AS similarity FROM b",
    "truncated_vectors": """WITH v AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, unnest(range(len(e)))::INTEGER AS pos, round(unnest(e) / sqrt(list_dot_product(e, e)), 6) AS x FROM v""",
    "hybrid_search": f"WITH {_FUSED} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM fused",
    "hybrid_verified": f"""WITH {_FUSED} SELECT f.query_id, f.doc_id, CAST(f.rank AS INTEGER) AS rank, similarity,
CASE WHEN similarity >= 0.7 THEN 'accept' WHEN similarity IS NULL OR similarity < 0.3 THEN 'reject' ELSE 'ask' END AS bucket
FROM fused f LEFT JOIN dense USING (query_id, doc_id)""",
    "search_context": f"""WITH {_FUSED} SELECT query_id, string_agg('[' || rank || '] Source: ' || coalesce(source, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM fused JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id""",
    "retrieval_metrics": f"""WITH {_FUSED}, g AS (SELECT doc_id FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
r AS (SELECT g.doc_id AS query_id, f.rank AS r FROM g LEFT JOIN fused f ON f.query_id = g.doc_id AND f.doc_id = g.doc_id)
SELECT query_id, CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit1, CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit3, CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit5, coalesce(round(1.0::DOUBLE / r, 6), 0) AS rr FROM r""",
}
