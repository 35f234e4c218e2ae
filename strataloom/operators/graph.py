"""Dependency and entity graphs as edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.sources.tables import Cuts, written


def coupling(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Afferent and efferent coupling, instability, abstractness, distance and zone of every node.

    ``edges`` (src, dst) count once each, loops as internal; ``classes`` is (node, total, abstract).
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    away = F.col("src") != F.col("dst")
    ends = e.select(F.col("src").alias("node"), away.cast("long").alias("ce"), F.lit(0).cast("long").alias("ca"), (~away).cast("long").alias("internal"))
    ends = ends.unionByName(e.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("ce"), away.cast("long").alias("ca"), F.lit(0).cast("long").alias("internal")))
    out = ends.groupBy("node").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"), F.sum("internal").alias("internal"))
    if classes is not None:
        out = out.join(classes.select("node", "total", "abstract"), "node", "left")
    else:
        out = out.withColumn("total", F.lit(0)).withColumn("abstract", F.lit(0))
    instability = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    out = out.withColumn("instability", instability).withColumn("abstractness", F.when(F.coalesce("total", F.lit(0)) > 0, F.col("abstract") / F.col("total")).otherwise(0.0))
    out = out.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1)).drop("total", "abstract")
    zone = F.when((F.col("abstractness") < 0.2) & (F.col("instability") < 0.2), "zone_of_pain").when((F.col("abstractness") > 0.8) & (F.col("instability") > 0.8), "zone_of_uselessness").when(F.col("distance") < 0.1, "main_sequence").otherwise("balanced")
    return out.withColumn("zone", zone)


def stability_violations(edges: DataFrame) -> DataFrame:
    """Edges from a stabler node to one of higher instability, with the difference and its severity."""
    i = coupling(edges).select("node", "instability")
    e = edges.select("src", "dst").where("src != dst").distinct()
    e = e.join(i.select(F.col("node").alias("src"), F.col("instability").alias("src_instability")), "src").join(i.select(F.col("node").alias("dst"), F.col("instability").alias("dst_instability")), "dst")
    delta = F.col("dst_instability") - F.col("src_instability")
    return e.where(delta > 0).select("src", "dst", "src_instability", "dst_instability", delta.alias("delta"), F.when(delta > 0.5, "high").when(delta > 0.25, "medium").otherwise("low").alias("severity"))


def reachable(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Transitive closure (src, dst) along the edges, by rounds of joins from the newest pairs; each round is written."""
    step = written(edges.select(F.col("src").alias("mid"), F.col("dst").alias("nxt")).where("mid is not null and nxt is not null").distinct(), "closure-edges")
    known = newest = written(step.select(F.col("mid").alias("src"), F.col("nxt").alias("dst")), "closure")
    for _ in range(max_rounds):
        fresh = newest.join(step, newest["dst"] == step["mid"]).select("src", F.col("nxt").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti")
        newest = written(fresh, "closure-new")
        if newest.isEmpty():
            return known
        known = written(known.unionByName(newest), "closure")
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")


def propagation_factor(edges: DataFrame) -> DataFrame:
    """Share of all nodes that each node reaches along the edges (itself not counted)."""
    from strataloom.operators.cycles import reach

    edges = written(edges.select("src", "dst").distinct(), "factor-edges")  # read several times: what they are made of is read once
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    total = nodes.count()
    far = F.coalesce("reached", F.lit(0))
    return nodes.join(reach(edges), "node", "left").select("node", far.alias("reached"), (far / F.lit(max(total, 1))).alias("factor"))


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, level) of all nodes up to ``depth`` undirected steps from the seeds (column node), which are left out."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = front = seeds.select("node").distinct().withColumn("level", F.lit(0))
    for d in range(1, depth + 1):
        front = both.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(d))
        seen = seen.unionByName(front)
    return seen.where("level > 0")


def cap_edges(edges: DataFrame, cap: int) -> DataFrame:
    """Edges (src, dst, weight) whose rank by weight is within ``cap`` at both ends; ties go to the smaller other end."""
    rank = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy(F.desc("weight"), other))
    # Filters on row_number let Spark limit each group before its shuffle, so a hub costs ``cap`` rows a task.
    out = edges.withColumn("r", rank("src", "dst")).where(F.col("r") <= cap).select("src", "dst")
    into = edges.withColumn("r", rank("dst", "src")).where(F.col("r") <= cap).select("src", "dst")
    return edges.join(out, ["src", "dst"], "left_semi").join(into, ["src", "dst"], "left_semi")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable without regard to direction.

    In each round every node points to its smallest neighbour, pointers are followed twice, and the edges are contracted to
    those between different targets, so they shrink from round to round; the pointers of all rounds together are the result.
    """
    cuts = Cuts(edges.sparkSession)
    e = edges.where("src is not null and dst is not null").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    e = cuts.written(e, "cc-edges")
    labels = e.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        e = e.where("hi != lo")
        if e.isEmpty():
            out = written(labels, "cc-labels")
            cuts.clear()
            return out
        ends = e.select(F.col("hi").alias("at"), F.col("lo").alias("to")).unionByName(e.select(F.col("lo").alias("at"), F.col("hi").alias("to")))
        point = cuts.written(ends.groupBy("at").agg(F.min("to").alias("to")).select("at", F.least("at", "to").alias("to")), "cc-points")
        for _ in range(2):
            point = point.join(point.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to"))
        point = cuts.written(point, "cc-points")
        labels = labels.join(point.withColumnRenamed("at", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = cuts.written(labels, "cc-labels")
        for end in ("hi", "lo"):
            e = e.join(point.withColumnRenamed("at", end), end).withColumn(end, F.col("to")).drop("to")
        e = cuts.written(e.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "cc-edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
