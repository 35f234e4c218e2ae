"""Linkage clustering and ordered clusters over sparse similarity graphs (a, b, similarity), without a matrix of all pairs.

Pairs that are not in the graph have similarity 0 (distance 1), pairs that repeat count with their largest; loops, nulls and
similarities that are not positive are left out. Every step is a join or a grouped aggregate and is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.graph import components
from strataloom.sources.tables import Cuts, written


def _edges(pairs: DataFrame) -> DataFrame:
    e = pairs.where("a is not null and b is not null and a != b and similarity > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("similarity").cast("double").alias("similarity"))
    return e.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _preferred(similarity: Column, a: Column, b: Column) -> Column:
    """The order of edges: the most similar first; of equal ones the order is that of a hash, so that many of a tie go at once."""
    return F.struct(similarity.alias("similarity"), F.xxhash64(a, b).alias("tie"), a.alias("a"), b.alias("b"))


def spanning_forest(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b, similarity): a forest of the most similar edges, which is single linkage: its edges by falling similarity are the merges.

    Every tree picks its best edge to another one, all at once, and what is joined is contracted; each round halves the number
    of trees that still have edges.
    """
    cuts = Cuts(pairs.sparkSession)
    e = _edges(pairs).select("a", "b", "similarity", F.col("a").alias("x"), F.col("b").alias("y"))
    e = cuts.written(e, "forest-edges")
    kinds, chosen = e.schema, []
    for _ in range(max_rounds):
        if e.isEmpty():
            out = cuts.spark.createDataFrame([], kinds)
            for c in chosen:
                out = out.unionByName(c)
            out = written(out.select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity"), "forest")
            cuts.clear()
            return out
        ends = e.select(F.explode(F.array("a", "b")).alias("node"), _preferred(F.col("similarity"), F.col("x"), F.col("y")).alias("p"), "a", "b")
        best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b", F.col("p.a").alias("x"), F.col("p.b").alias("y"), "p.similarity"), "p").alias("e")).select("e.*").distinct()
        chosen.append(cuts.written(best, "forest-chosen"))
        of = cuts.written(components(chosen[-1].select(F.col("a").alias("src"), F.col("b").alias("dst"))), "forest-trees")
        moved = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        e = e.join(moved("a"), "a").join(moved("b"), "b").where("ca != cb")
        e = e.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "similarity", "x", "y")
        best = F.max_by(F.struct("similarity", "x", "y"), _preferred(F.col("similarity"), F.col("x"), F.col("y"))).alias("e")
        e = cuts.written(e.groupBy("a", "b").agg(best).select("a", "b", "e.similarity", "e.x", "e.y"), "forest-edges")
    raise RuntimeError(f"the forest was still growing after {max_rounds} rounds")


def agglomerated(pairs: DataFrame, linkage: str = "average", most_distance: float = 0.7, max_rounds: int = 5000) -> DataFrame:
    """(round, a, b, distance, size): merges of clusters up to ``most_distance``, each named by its least member.

    Of every round all pairs of clusters merge that are each other's nearest. For average and complete linkage no merge brings
    another cluster nearer, so these are the merges of one at a time, in another order; ordered by distance they are the
    dendrogram. Ties are broken by a hash of the pair, anew in each round. ``single`` is better served by ``spanning_forest``.
    """
    if linkage not in ("average", "complete", "single"):
        raise ValueError(f"no such linkage: {linkage}")
    cuts, one = Cuts(pairs.sparkSession), F.lit(1).cast("long")
    e = cuts.written(_edges(pairs).select("a", "b", F.col("similarity").alias("total"), F.col("similarity").alias("least"), F.col("similarity").alias("most"), one.alias("n"), one.alias("na"), one.alias("nb")), "linkage-edges")
    whole = F.col("na") * F.col("nb")
    near = {"average": F.col("total") / whole, "complete": F.when(F.col("n") == whole, F.col("least")).otherwise(0.0), "single": F.col("most")}[linkage]
    merges: list[DataFrame] = []
    schema = e.select(F.lit(0).alias("round"), "a", "b", F.lit(0.0).alias("distance"), F.col("na").alias("size")).schema
    for r in range(1, max_rounds + 1):
        close = e.withColumn("s", near).where(F.col("s") >= 1.0 - most_distance - 1e-12)
        ends = close.select(F.explode(F.array("a", "b")).alias("node"), _preferred(F.col("s"), F.col("a"), F.col("b")).alias("p"), (F.col("na") + F.col("nb")).alias("size"))
        picked = ends.groupBy("node").agg(F.max(F.struct("p", "size")).alias("m"))
        both = picked.groupBy(F.col("m.p.a").alias("a"), F.col("m.p.b").alias("b")).agg(F.count("*").alias("k"), F.first("m.p.similarity").alias("s"), F.first("m.size").alias("size")).where("k = 2")
        merged = cuts.written(both.select(F.lit(r).alias("round"), "a", "b", (1.0 - F.col("s")).alias("distance"), "size"), "linkage-merges")
        if merged.isEmpty():
            break
        merges.append(merged)
        to = merged.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), F.col("size"))
        for end in ("a", "b"):
            here = to.select(F.col("old").alias(end), F.col("new").alias("new"), "size")
            e = e.join(here, end, "left").withColumn(end, F.coalesce("new", end)).withColumn(f"n{end}", F.coalesce("size", f"n{end}")).drop("new", "size")
        first = F.col("a") < F.col("b")
        e = e.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", "least", "most", "n", F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb"))
        e = cuts.written(e.groupBy("a", "b").agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"), F.max("na").alias("na"), F.max("nb").alias("nb")), "linkage-edges")
    else:
        raise RuntimeError(f"clusters were still merging after {max_rounds} rounds")
    out = cuts.spark.createDataFrame([], schema)
    for m in merges:
        out = out.unionByName(m)
    out = written(out, "linkage")
    cuts.clear()
    return out


def cut(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """(node, cluster): the least member of the cluster that each of ``nodes`` is in once ``merges`` (a, b) are made."""
    of = components(merges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return nodes.select("node").distinct().join(of, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def ordered_clusters(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, leader): as if nodes were taken in order, each without a cluster founding one with all its later free neighbours.

    ``nodes`` is (node, place) with places that differ, ``pairs`` (a, b) their neighbours. In rounds: a node all of whose
    earlier neighbours belong to others is a leader; a node with a leader before it belongs to the first of them, once all
    earlier neighbours are decided or that leader comes before the undecided ones.
    """
    cuts = Cuts(nodes.sparkSession)
    place = nodes.select("node", "place")
    e = pairs.where("a is not null and b is not null and a != b").select("a", "b")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e = e.join(place.select(F.col("node").alias("a"), F.col("place").alias("pa")), "a").join(place.select(F.col("node").alias("b"), F.col("place").alias("pb")), "b")
    e = cuts.written(e.where("pb < pa").select(F.col("a").alias("node"), F.col("b").alias("before"), F.col("pb").alias("at"), F.lit(False).alias("is_leader")), "ordered-edges")  # earlier neighbours only
    left = e.select("node").distinct()
    done = cuts.written(place.select("node", "place", F.col("node").alias("leader")).join(left, "node", "left_anti"), "ordered-done")
    parts = [done]
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        founders = parts[-1].where("node = leader").select(F.col("node").alias("before"), F.lit(True).alias("leads"))
        others = parts[-1].where("node != leader").select("node", F.lit(True).alias("gone"))
        # Leaders stay as neighbours, members fall away.
        known = e.join(founders, "before", "left").join(others.withColumnRenamed("node", "before"), "before", "left").where("gone is null")
        known = cuts.written(known.select("node", "before", "at", (F.col("leads").isNotNull() | F.col("is_leader")).alias("is_leader")), "ordered-known")
        first = known.groupBy("node").agg(F.min(F.struct("at", "is_leader", "before")).alias("f"))
        some = e.select("node").distinct()
        fresh = some.join(first, "node", "left").where("f is null or f.is_leader")
        fresh = cuts.written(fresh.join(place, "node").select("node", "place", F.coalesce("f.before", "node").alias("leader")), "ordered-done")
        parts.append(fresh)
        e = cuts.written(known.join(fresh.select("node"), "node", "left_anti"), "ordered-edges")
    else:
        raise RuntimeError(f"clusters were not settled in {max_rounds} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = written(out.select("node", "leader"), "ordered")
    cuts.clear()
    return out
