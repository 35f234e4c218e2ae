"""Queries: the kept vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.operators.vector_index import VectorIndex
from strataloom.sources.tables import remove, scratch, table, versions

K = 10
_BUILT: dict[tuple, VectorIndex] = {}


def _index(spark, sf):
    """The index of all embeddings, in three batches (the last one tried twice) and split; built once for an application and its files as they are."""
    rows = table(spark, sf, "embeddings")
    key = (spark.sparkContext.applicationId, sf)
    now = versions(rows)
    if key not in _BUILT or _BUILT[key].of != now:
        if key in _BUILT:
            remove(spark, _BUILT[key].path)
        third = F.pmod(F.xxhash64("vec_id"), F.lit(3))
        index = VectorIndex.build(rows.where(third == 0), f"{scratch(spark)}/vectors-{uuid.uuid4().hex}")
        for name, part in (("second", 1), ("third", 2), ("third", 2)):
            index.append(rows.where(third == part), name)
        index.split(200)
        index.of = now
        _BUILT[key] = index
    return _BUILT[key]


def _out(df):
    return df.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def vector_index_topk(spark, sf):
    """The nearest of all vectors for each."""
    return _out(_index(spark, sf).search(table(spark, sf, "embeddings"), K))


def vector_index_where(spark, sf):
    """The nearest of label 3 for each vector."""
    return _out(_index(spark, sf).search(table(spark, sf, "embeddings"), K, F.col("label") == 3))


def vector_index_cells(spark, sf):
    """Where each vector is kept: how many times, and whether its cell's radius covers it."""
    index = _index(spark, sf)
    radius = F.broadcast(spark.createDataFrame([(r["cell"], r["radius"]) for r in index.manifest() if r["cell"] >= 0], "cell int, radius double"))
    rows = index.rows().join(radius, "cell").groupBy(F.col("id").alias("vec_id")).agg(F.count("*").alias("copies"), F.min(F.col("far") <= F.col("radius")).alias("covered"))
    return rows


def vector_index_deleted(spark, sf):
    """The nearest that are left for each vector once all of labels 0 to 4 are removed."""
    rows = table(spark, sf, "embeddings")
    index = VectorIndex.build(rows, f"{scratch(spark)}/vectors-{uuid.uuid4().hex}")
    found = _out(index.delete(rows.where("label <= 4").select(F.col("vec_id").alias("id"))).search(rows, K))
    remove(spark, index.path)
    return found


QUERIES = [vector_index_topk, vector_index_where, vector_index_cells, vector_index_deleted]


def _nearest(which: str) -> str:
    return f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND {which})
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= {K}"""


SQL = {
    "vector_index_topk": _nearest("TRUE"),
    "vector_index_where": _nearest("b.label = 3"),
    "vector_index_cells": "SELECT vec_id, count(*) AS copies, TRUE AS covered FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1",
    "vector_index_deleted": _nearest("NOT coalesce(b.label <= 4, FALSE)"),
}
