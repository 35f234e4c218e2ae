"""Queries: consolidation of memory items in deltas, and by graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.operators import consolidation as C
from strataloom.operators.vector_index import VectorIndex
from strataloom.sources.tables import remove, scratch, table, versions

from .items import _NEAR

DISTANCE = 0.7
_BUILT: dict[tuple, C.Consolidation] = {}


def _items(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit("v").alias("kind"), F.concat(F.lit("L"), "label").alias("first_tag"), "embedding", F.concat(F.lit("vector "), "vec_id").alias("content"),
        F.array(F.concat(F.lit("t"), (F.col("vec_id") % 4).cast("string"))).alias("tags"), ((F.col("vec_id") % 100) / 100).alias("confidence"), F.lit("stm").alias("tier"), (F.col("vec_id") % 7).cast("long").alias("usage"),
        F.lit(None).cast("string").alias("validation"), (F.col("vec_id") % 3 > 0).alias("has_source"), F.lit(False).alias("archived"),
    )


def _consolidated(spark, sf):
    """All vectors as items, in three deltas by id (the second one tried twice); once for an application and its files as they are."""
    key, now = (spark.sparkContext.applicationId, sf), versions(table(spark, sf, "embeddings"))
    if key not in _BUILT or _BUILT[key].of != now:
        if key in _BUILT:
            remove(spark, _BUILT[key].path)
        items, done = _items(spark, sf), C.Consolidation(spark, f"{scratch(spark)}/consolidation-{uuid.uuid4().hex}", DISTANCE)
        low, high = items.agg(F.percentile_approx("id", 0.33), F.percentile_approx("id", 0.66)).first()
        for name, part in (("a", items.where(F.col("id") <= low)), ("b", items.where((F.col("id") > low) & (F.col("id") <= high))), ("b", items), ("c", items)):
            done.apply(part, name)
        done.of = now
        _BUILT[key] = done
    return _BUILT[key]


def consolidated_members(spark, sf):
    return _consolidated(spark, sf).members().select("id", "cluster")


def consolidated_items(spark, sf):
    """The merged item of each cluster of two or more."""
    return _consolidated(spark, sf).current().select("cluster", "members", "id", "content", F.array_join("tags", ",").alias("tags"), F.round("confidence", 6).alias("confidence"))


def consolidated_links(spark, sf):
    return _consolidated(spark, sf).links().select("src", "dst", "rel")


def graph_clusters(spark, sf):
    """Parts as items on the graph of parts, orders and suppliers: components of one brand as document, one type as tag, or near by their vectors; and the clusters within each."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), F.col("p_type").alias("first_tag"), F.lit("part").alias("kind"))
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    items = part.join(vec, "id", "left")
    lines, own = table(spark, sf, "lineitem"), F.concat(F.lit("i"), "l_partkey").alias("src")
    edges = lines.select(own, F.concat(F.lit("o"), "l_orderkey").alias("dst")).unionByName(lines.select(own, F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct())
    index = VectorIndex.build(items.select("id", "embedding"), f"{scratch(spark)}/part-vectors-{uuid.uuid4().hex}", "id")
    near = index.near(items.select("id", "embedding"), 0.9, vec_id="id").select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    remove(spark, index.path)
    return C.clusters_by_graph(items, edges, near)


QUERIES = [consolidated_members, consolidated_items, consolidated_links, graph_clusters]

_CLUSTERS = f"""p AS ({_NEAR}), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
s(i, node, leader) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT UNION ALL
 (SELECT i + 1, node, leader FROM s WHERE i < (SELECT count(*) FROM o) UNION ALL
  SELECT o.i, o.vec_id, coalesce((SELECT min(s.node) FROM s JOIN p ON p.a = s.node WHERE p.b = o.vec_id AND s.node = s.leader), o.vec_id) FROM o JOIN (SELECT DISTINCT i FROM s) t ON o.i = t.i + 1)),
c AS (SELECT node AS id, leader AS cluster FROM s WHERE i = (SELECT count(*) FROM o) AND node IS NOT NULL),
m AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM c)"""
SQL = {
    "consolidated_members": f"WITH RECURSIVE {_CLUSTERS} SELECT id, cluster FROM c",
    "consolidated_links": f"WITH RECURSIVE {_CLUSTERS} SELECT cluster AS src, id AS dst, 'supersedes' AS rel FROM m WHERE n > 1",
    "consolidated_items": f"""WITH RECURSIVE {_CLUSTERS}, b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id % 100 DESC, length('vector ' || id) DESC, id) AS r FROM m WHERE n > 1)
SELECT cluster, n AS members, max(id) FILTER (r = 1) AS id, 'vector ' || max(id) FILTER (r = 1) AS content, string_agg(DISTINCT 't' || id % 4, ',' ORDER BY 't' || id % 4) AS tags, round(max(id % 100) / 100, 6) AS confidence FROM b GROUP BY 1, 2""",
}
