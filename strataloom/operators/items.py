"""Memory items as tables: filtered lists, tag search, recall scores, importance, confidence of merged items."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.measures import cosine, usable_vector
from strataloom.operators.linkage import ordered_clusters
from strataloom.operators.vector_index import VectorIndex
from strataloom.sources.tables import remove, scratch

#: How much a source is trusted, by its kind and by whether its contents are hashed.
PROVENANCE = {("doc", True): 1.0, ("doc", False): 0.7, ("tool", True): 0.8, ("tool", False): 0.5, ("mixed", True): 0.6, ("mixed", False): 0.4, ("chat", True): 0.5, ("chat", False): 0.2}
VALIDATION = {"verified": 1.0, "unverified": 0.3, "contested": 0.1, "retracted": 0.0}
#: How much an item's type weighs.
TYPES = {"constraint": 1.0, "decision": 0.9, "definition": 0.7, "pattern": 0.6, "fact": 0.5, "todo": 0.3, "note": 0.2, "pointer": 0.1}
#: Weights of tags, vectors and provenance in recall; of the four signs of a merged item's confidence; decay a day.
RECALL = {"tags": 0.3, "vector": 0.5, "provenance": 0.2}
MERGE = {"most": 0.3, "overlap": 0.3, "recency": 0.2, "validation": 0.2}
DECAY = 0.01


def _chosen(values: dict, key: Column, other: float) -> Column:
    return F.coalesce(reduce(lambda c, kv: c.when(key == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0.0)), F.lit(other))


def where_all(rows: DataFrame, equal: dict | None = None, among: dict | None = None, least: dict | None = None, most: dict | None = None) -> DataFrame:
    """Rows that meet every given predicate; each is a plain comparison, so it reaches the scan."""
    tests = [F.col(c) == v for c, v in (equal or {}).items()] + [F.col(c).isin(list(v)) for c, v in (among or {}).items()]
    tests += [F.col(c) >= v for c, v in (least or {}).items()] + [F.col(c) <= v for c, v in (most or {}).items()]
    return rows.where(reduce(Column.__and__, tests, F.lit(True)))


def by_tags(items: DataFrame, wanted: list[str], every: bool = False) -> DataFrame:
    """(id, hits): items (id, tags) with any, or every, of the wanted tags, whatever their case."""
    low = F.transform("tags", F.lower)
    ask = F.array(*[F.lit(t) for t in sorted({t.lower() for t in wanted})])
    hits = F.size(F.array_intersect(low, ask))
    return items.select("id", hits.alias("hits")).where(F.col("hits") == F.size(ask) if every else F.col("hits") > 0)


def tag_overlap(tags: Column, wanted: list[str]) -> Column:
    """Jaccard similarity of two sets of tags, 0 if one is empty."""
    a, b = F.array_distinct(F.transform(tags, F.lower)), F.array(*[F.lit(t) for t in sorted({t.lower() for t in wanted})])
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def provenance_score(kind: Column, hashed: Column, validation: Column) -> Column:
    source = F.coalesce(reduce(lambda c, kv: c.when((kind == kv[0][0]) & (hashed == kv[0][1]), kv[1]), PROVENANCE.items(), F.when(F.lit(False), 0.0)), F.lit(0.2))
    return 0.6 * source + 0.4 * _chosen(VALIDATION, validation, 0.3)


def recall(items: DataFrame, tags: list[str], vector: list[float] | None, k: int = 20) -> DataFrame:
    """(id, tag_score, vector_score, provenance, score): the ``k`` best of items (id, tags, embedding, kind, hashed, validation); ties go to the smaller id."""
    near = F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))) if vector else F.lit(0.0)
    near = F.when(F.col("embedding").isNotNull(), near).otherwise(0.0)
    rows = items.select("id", tag_overlap(F.col("tags"), tags).alias("tag_score"), near.alias("vector_score"), provenance_score(F.col("kind"), F.col("hashed"), F.col("validation")).alias("provenance"))
    score = RECALL["tags"] * F.col("tag_score") + RECALL["vector"] * F.col("vector_score") + RECALL["provenance"] * F.col("provenance")
    return rows.withColumn("score", score).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def importance(kind: Column, confidence: Column, used: Column) -> Column:
    """Half the type's weight, the confidence at 0.3, up to 0.2 for use, and 0.1."""
    return _chosen(TYPES, kind, 0.3) * 0.5 + confidence * 0.3 + F.least(F.lit(0.2), used * 0.05) + 0.1


def merge_confidence(items: DataFrame, cluster: str, now: str) -> DataFrame:
    """(cluster, items, confidence) of items (cluster, id, tags, confidence, validation, updated) that would be merged.

    The largest confidence, the share of different tags that two items or more have, the age of the newest (0.5 if unknown)
    and the validation states, weighted. Tags are counted in Spark's groups, never gathered.
    """
    one = items.groupBy(cluster).agg(
        F.count("*").alias("items"), F.max("confidence").alias("most"), F.max("updated").alias("newest"),
        F.bool_or(F.col("validation") == "retracted").alias("gone"), F.bool_or(F.col("validation") == "verified").alias("sure"),
    )
    tags = items.select(cluster, F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("tag")).groupBy(cluster, "tag").agg(F.count("*").alias("n"))
    tags = tags.groupBy(cluster).agg((F.count_if(F.col("n") >= 2) / F.count("*")).alias("overlap"))
    days = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp_ntz")) - F.unix_timestamp("newest")) / 86400.0)
    recency = F.when(F.col("newest").isNull(), 0.5).otherwise(F.exp(-DECAY * days))
    state = F.when(F.coalesce("gone", F.lit(False)), 0.0).when(F.coalesce("sure", F.lit(False)), 1.0).otherwise(0.5)
    blend = MERGE["most"] * F.col("most") + MERGE["overlap"] * F.coalesce("overlap", F.lit(0.0)) + MERGE["recency"] * recency + MERGE["validation"] * state
    return one.join(tags, cluster, "left").select(cluster, "items", F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)).alias("confidence"))


def near_pairs(items: DataFrame, most_distance: float = 0.3) -> DataFrame:
    """(a, b) of items (id, kind, first_tag, embedding) of one type and first tag whose vectors are at most ``most_distance`` apart; a < b.

    Near vectors come from a kept index, so no pairs are made but those that are near and of one type and tag.
    """
    spark = items.sparkSession
    rows = items.select(F.concat_ws(":", "kind", F.lower("first_tag")).alias("key"), F.col("id").cast("long").alias("id"), "embedding").where("id is not null")
    index = VectorIndex.build(rows, f"{scratch(spark)}/item-vectors-{uuid.uuid4().hex}", "id", "embedding")
    near = index.near(rows, 1.0 - most_distance, vec_id="id", same="key", later=True)
    remove(spark, index.path)
    key = lambda end: rows.select(F.col("id").alias(end), F.col("key").alias(f"k{end}")).distinct()
    pairs = near.select(F.col("query_id").alias("a"), F.col("id").alias("b")).where("a < b")
    return pairs.join(key("a"), "a").join(key("b"), "b").where("ka = kb").select("a", "b").distinct()


def clusters_by_type(items: DataFrame, most_distance: float = 0.3, bare: bool = True) -> DataFrame:
    """(id, cluster) of items (id, kind, first_tag, embedding), ``cluster`` being the item that founded it.

    Items of one type and first tag are taken by id; one that is in no cluster founds one and takes in all later free ones
    whose vectors are at most ``most_distance`` away. An item without a usable vector is alone, but with ``bare`` a type and
    tag of which no item has one is one cluster. Null ids take no part, rows that repeat an id are one item.
    """
    rows = items.select(F.concat_ws(":", "kind", F.lower("first_tag")).alias("key"), F.col("id").cast("long").alias("id"), "embedding").where("id is not null")
    found = ordered_clusters(rows.select(F.col("id").alias("node"), F.col("id").alias("place")).distinct(), near_pairs(items, most_distance))
    if not bare:
        return found.select(F.col("node").alias("id"), F.col("leader").alias("cluster"))
    keys = rows.groupBy("key").agg(F.count_if(usable_vector(F.col("embedding"))).alias("n"), F.min("id").alias("first")).where("n = 0")
    whole = rows.select("id", "key").join(keys, "key").groupBy("id").agg(F.min("first").alias("first"))
    return found.withColumnRenamed("node", "id").join(whole, "id", "left").select("id", F.coalesce("first", "leader").alias("cluster"))
