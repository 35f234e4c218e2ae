"""Queries: keyword, vector and fused search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.operators import retrieval as R
from strataloom.sources.tables import remove, scratch, table, versions

from . import sql as S

TERMS = ["ention", "elle", "heren", "ention"]
QUERY, K = 0, 10


_BUILT: dict[tuple, R.KeywordIndex] = {}


def _index(spark, sf):
    """The documents' keyword index, built once for an application and the files as they are."""
    docs = table(spark, sf, "documents")
    key, now = (spark.sparkContext.applicationId, sf), versions(docs)
    if key not in _BUILT or _BUILT[key].of != now:
        if key in _BUILT:
            remove(spark, _BUILT[key].path)
        _BUILT[key] = R.KeywordIndex(spark, f"{scratch(spark)}/keywords-{uuid.uuid4().hex}").append(docs)
        _BUILT[key].of = now
    return _BUILT[key]


def _keyword(spark, sf, k=2 * K):
    return _index(spark, sf).search(TERMS, k)


def bm25_scan(spark, sf):
    """The same search without an index: two passes over the texts."""
    return _out(R.bm25(table(spark, sf, "documents"), TERMS, k=K))


def bm25_index_terms(spark, sf):
    """The most frequent terms of the index."""
    terms = _index(spark, sf).terms().select("term", "documents", "uses")
    return terms.orderBy(F.desc("documents"), "term").limit(50)


def _vector(spark, sf, k=2 * K):
    """Nothing where the query vector is missing."""
    vectors = table(spark, sf, "embeddings")
    query = vectors.where((F.col("vec_id") == QUERY) & F.col("embedding").isNotNull()).select("embedding").first()
    return R.vector_search(vectors if query else vectors.limit(0), query["embedding"] if query else [0.0], k)


def _out(df):
    return df.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def bm25_topk(spark, sf):
    return _out(_keyword(spark, sf, K))


def vector_topk(spark, sf):
    return _out(_vector(spark, sf, K))


def hybrid_rrf(spark, sf):
    return _out(R.fuse_rrf(_keyword(spark, sf), _vector(spark, sf), K))


def hybrid_weighted(spark, sf):
    return _out(R.fuse_weighted(_keyword(spark, sf), _vector(spark, sf), K))


def hybrid_interleave(spark, sf):
    return _out(R.fuse_interleave(_keyword(spark, sf), _vector(spark, sf), K))


def hybrid_keyword_rerank(spark, sf):
    return _out(R.rerank_by_keyword(_keyword(spark, sf), _vector(spark, sf), K))


def hybrid_vector_rerank(spark, sf):
    return _out(R.rerank_by_vector(_keyword(spark, sf), _vector(spark, sf), K))


def fulltext_like(spark, sf):
    return R.contains_all(table(spark, sf, "documents"), ["Tion", "ELLE"], ["text", "source"]).select("doc_id", "source")


QUERIES = [bm25_topk, bm25_scan, bm25_index_terms, vector_topk, hybrid_rrf, hybrid_weighted, hybrid_interleave, hybrid_keyword_rerank, hybrid_vector_rerank, fulltext_like]

_BOTH = f"WITH RECURSIVE {S.keyword_list(TERMS, 2 * K)},{S.vector_list(QUERY, 2 * K)}"
_RANKED = f"SELECT doc_id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank FROM s QUALIFY rank <= {K}"
_BM25 = f"WITH {S.keyword_list(TERMS, K)} SELECT doc_id, round(score, 6) AS score, rank::INT AS rank FROM kw"
SQL = {
    "bm25_topk": _BM25,
    "bm25_scan": _BM25,
    "bm25_index_terms": f"WITH t AS (SELECT doc_id, unnest({S.tokens()}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "vector_topk": f"WITH {S.vector_list(QUERY, K)} SELECT doc_id, round(score, 6) AS score, rank::INT AS rank FROM vec",
    "hybrid_rrf": f"{_BOTH}, s AS (SELECT doc_id, coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + vec.rank), 0) AS score FROM kw FULL JOIN vec USING (doc_id)) {_RANKED}",
    "hybrid_weighted": f"{_BOTH}, s AS (SELECT doc_id, 0.5 * coalesce(kw.score / (SELECT max(score) FROM kw), 0) + 0.5 * coalesce(vec.score, 0) AS score FROM kw FULL JOIN vec USING (doc_id)) {_RANKED}",
    "hybrid_interleave": f"""{_BOTH},
l AS (SELECT (SELECT list(doc_id ORDER BY rank) FROM kw) AS a, (SELECT list(doc_id ORDER BY rank) FROM vec) AS b),
t AS (SELECT 1 AS i, a, b, a[1:0] AS o FROM l UNION ALL
 SELECT i + 1, a, b, list_concat(o, list_filter(CASE WHEN i % 2 = 1 THEN a ELSE b END, lambda x: NOT list_contains(o, x))[1:1]) FROM t WHERE i <= {2 * K}),
e AS (SELECT o[1:{K}] AS o FROM t WHERE i = {2 * K + 1}),
p AS (SELECT unnest(o) AS doc_id, generate_subscripts(o, 1) AS pos FROM e)
SELECT doc_id, round(1 - (pos - 1) / {K}.0, 6)::DOUBLE AS score, pos::INT AS rank FROM p""",
    "hybrid_keyword_rerank": f"{_BOTH}, s AS (SELECT vec.doc_id, vec.score * (1 + coalesce(kw.score / (SELECT max(score) FROM kw), 0)) AS score FROM vec LEFT JOIN kw USING (doc_id)) {_RANKED}",
    "hybrid_vector_rerank": f"{_BOTH}, s AS (SELECT kw.doc_id, kw.score * (1 + coalesce(vec.score, 0)) AS score FROM kw LEFT JOIN vec USING (doc_id)) {_RANKED}",
    "fulltext_like": "SELECT doc_id, source FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(source), 'tion')) AND (contains(lower(text), 'elle') OR contains(lower(source), 'elle'))",
}
