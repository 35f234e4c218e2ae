"""Queries: lists of items, tag search, recall, importance, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import items as I
from strataloom.sources.tables import table

from . import sql as S

TAGS = ["EN", "web", "de", "books"]


def _items(spark, sf):
    """Documents as items: language and source as tags, the label as validation, the vector of the same number."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars", F.array_compact(F.array("lang", "source")).alias("tags"), F.col("text").isNotNull().alias("hashed"))
    kind = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("id", F.lit(len(names))) + 1).cast("int"))
    label = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"))
    vector = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    state = F.when(F.col("q") == 1, "verified").when(F.col("q") == 0, "contested").otherwise("unverified")
    return d.withColumns({"kind": kind(["doc", "tool", "mixed", "chat", "web"]), "type": kind([*I.TYPES, "other"])}).join(label, "id", "left").join(vector, "id", "left").withColumn("validation", state).drop("q")


def list_items(spark, sf):
    rows = I.where_all(table(spark, sf, "documents"), among={"lang": ["en", "de"]}, least={"n_chars": 500}, most={"n_chars": 5000})
    return rows.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


def search_by_tags(spark, sf):
    return I.by_tags(_items(spark, sf), TAGS)


def recall_search(spark, sf):
    query = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()
    out = I.recall(_items(spark, sf), TAGS, query["embedding"] if query else None)
    return out.withColumns({c: F.round(c, 6) for c in ("tag_score", "vector_score", "provenance", "score")})


def item_importance(spark, sf):
    score = I.importance(F.col("type"), (F.col("n_chars") % 100) / 100.0, F.col("n_chars") % 7)
    return _items(spark, sf).select("id", "type", F.round(score, 6).alias("importance"))


def merge_confidence(spark, sf):
    rows = _items(spark, sf).where("source is not null").withColumns({"confidence": (F.col("n_chars") % 100) / 100.0, "updated": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(n_chars % 365 as int))")})
    return I.merge_confidence(rows, "source", "2025-01-01 00:00:00").withColumn("confidence", F.round("confidence", 6))


def _vector_items(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("v").alias("kind"), F.concat(F.lit("L"), "label").alias("first_tag"), "embedding")


def item_near_pairs(spark, sf):
    return I.near_pairs(_vector_items(spark, sf), 0.7)


def item_clusters(spark, sf):
    return I.clusters_by_type(_vector_items(spark, sf), 0.7)


QUERIES = [list_items, search_by_tags, recall_search, item_importance, merge_confidence, item_near_pairs, item_clusters]

_KIND = lambda names: "([" + ", ".join(map(S.q, names)) + f"])[doc_id % {len(names)} + 1]"
_ITEMS = f"""l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1),
i AS (SELECT d.doc_id AS id, source, n_chars, list_filter([lang, source], lambda x: x IS NOT NULL) AS tags, text IS NOT NULL AS hashed, {_KIND(["doc", "tool", "mixed", "chat", "web"]).replace("doc_id", "d.doc_id")} AS kind, {_KIND([*I.TYPES, "other"]).replace("doc_id", "d.doc_id")} AS type,
 CASE q WHEN 1 THEN 'verified' WHEN 0 THEN 'contested' ELSE 'unverified' END AS validation, embedding FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
_ASK = "[" + ", ".join(S.q(t.lower()) for t in sorted({t.lower() for t in TAGS})) + "]"
_NEAR = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 1.0::DOUBLE - 0.7::DOUBLE"
SQL = {
    "list_items": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 500 AND 5000 ORDER BY n_chars DESC, doc_id LIMIT 50",
    "search_by_tags": f"WITH {_ITEMS} SELECT id, len(list_intersect(list_transform(tags, lambda x: lower(x)), {_ASK}))::INT AS hits FROM i WHERE hits > 0",
    "recall_search": f"""WITH {_ITEMS}, s AS (SELECT id, CASE WHEN len(tags) > 0 THEN len(list_intersect(list_transform(tags, lambda x: lower(x)), {_ASK})) / len(list_distinct(list_concat(list_transform(tags, lambda x: lower(x)), {_ASK})))::DOUBLE ELSE 0 END AS t,
 coalesce(greatest(0, list_cosine_similarity(i.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0) AS v, 0.6::DOUBLE * CASE kind {" ".join(f"WHEN {S.q(k)} THEN CASE WHEN hashed THEN {I.PROVENANCE[k, True]} ELSE {I.PROVENANCE[k, False]} END" for k in ("doc", "tool", "mixed", "chat"))} ELSE 0.2 END::DOUBLE + 0.4::DOUBLE * CASE validation {" ".join(f"WHEN {S.q(k)} THEN {v}" for k, v in I.VALIDATION.items())} END::DOUBLE AS p
 FROM i, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), r AS (SELECT *, 0.3::DOUBLE * t + 0.5::DOUBLE * v + 0.2::DOUBLE * p AS score FROM s)
SELECT id, round(t, 6) AS tag_score, round(v, 6) AS vector_score, round(p, 6) AS provenance, round(score, 6) AS score FROM r ORDER BY round(r.score, 9) DESC, id LIMIT 20""",
    "item_importance": f"""WITH {_ITEMS} SELECT id, type, round(CASE type {" ".join(f"WHEN {S.q(k)} THEN {v}" for k, v in I.TYPES.items())} ELSE 0.3 END::DOUBLE * 0.5::DOUBLE + (n_chars % 100) / 100::DOUBLE * 0.3::DOUBLE + least(0.2::DOUBLE, (n_chars % 7) * 0.05::DOUBLE) + 0.1::DOUBLE, 6) AS importance FROM i""",
    "merge_confidence": f"""WITH {_ITEMS}, c AS (SELECT source, count(*) AS items, max((n_chars % 100) / 100::DOUBLE) AS most, max(n_chars % 365) AS day, bool_or(validation = 'verified') AS sure FROM i WHERE source IS NOT NULL GROUP BY 1),
g AS (SELECT source, tag, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_transform(tags, lambda x: lower(x)))) AS tag FROM i WHERE source IS NOT NULL) GROUP BY 1, 2), o AS (SELECT source, count(*) FILTER (n >= 2) / count(*)::DOUBLE AS overlap FROM g GROUP BY 1)
SELECT source, items, round(0.3::DOUBLE * most + 0.3::DOUBLE * overlap + 0.2::DOUBLE * exp(-0.01::DOUBLE * (366 - day)) + 0.2::DOUBLE * CASE WHEN sure THEN 1.0 ELSE 0.5 END::DOUBLE, 6) AS confidence FROM c JOIN o USING (source)""",
    "item_near_pairs": _NEAR,
    "item_clusters": f"""WITH RECURSIVE p AS ({_NEAR}), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
s(i, node, leader) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT UNION ALL
 (SELECT i + 1, node, leader FROM s WHERE i < (SELECT count(*) FROM o) UNION ALL
  SELECT o.i, o.vec_id, coalesce((SELECT min(s.node) FROM s JOIN p ON p.a = s.node WHERE p.b = o.vec_id AND s.node = s.leader), o.vec_id) FROM o JOIN (SELECT DISTINCT i FROM s) t ON o.i = t.i + 1))
SELECT node AS id, leader AS cluster FROM s WHERE i = (SELECT count(*) FROM o) AND node IS NOT NULL""",
}
