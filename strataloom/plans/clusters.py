"""Queries: linkage clusters of vectors, over the graph of the nearest or over all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import linkage as L
from strataloom.operators import vector_linkage as V
from strataloom.operators.vector_index import packed_rows
from strataloom.sources.tables import table

from .vectors import _index

NEAREST, LEAST = 5, 0.3


def _near(spark, sf):
    """(a, b, similarity): each vector and its five nearest."""
    found = _index(spark, sf).search(table(spark, sf, "embeddings"), NEAREST)
    return found.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), F.col("score").alias("similarity"))


def linkage_clusters(spark, sf):
    """Single linkage, cut at a similarity."""
    forest = L.spanning_forest(_near(spark, sf)).where(F.col("similarity") >= LEAST)
    return L.cut(table(spark, sf, "embeddings").select(F.col("vec_id").alias("node")), forest)


def linkage_forest(spark, sf):
    """The merges of single linkage over all pairs."""
    return V.vector_forest(_index(spark, sf), table(spark, sf, "embeddings")).withColumn("similarity", F.round("similarity", 6))


def linkage_average(spark, sf):
    """The merges of average linkage over all pairs up to a distance."""
    return V.average_merges(packed_rows(table(spark, sf, "embeddings").select("vec_id", "embedding")), 0.8).withColumn("distance", F.round("distance", 6))


QUERIES = [linkage_clusters, linkage_forest, linkage_average]

SQL = {
    "linkage_clusters": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS q, b.vec_id AS i, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= {NEAREST}),
e AS (SELECT q AS a, i AS b FROM s WHERE score >= {LEAST} UNION SELECT i, q FROM s WHERE score >= {LEAST}),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT node, min(seen) AS cluster FROM r GROUP BY 1""",
}
