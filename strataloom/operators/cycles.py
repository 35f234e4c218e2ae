"""Strongly connected parts, cycles and reach of directed graphs (src, dst), in memory linear in the edges.

No closure is built: parts are found by trimming what has no way in or out, colouring every node with the smallest node that
reaches it, and walking back from the nodes that have their own colour. Each step is a join or a grouped minimum, written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.graph import reachable
from strataloom.sources.tables import Cuts, written


def _edges(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def strong_parts(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, part) of the nodes in strongly connected parts of two or more, ``part`` being the smallest of them.

    In each round the nodes left are coloured forward, the roots' parts are taken off, and only edges inside one colour stay:
    the two ends of any other are in different parts. A round takes as many steps as the longest of the shortest ways.
    """
    cuts = Cuts(edges.sparkSession)
    e = cuts.written(_edges(edges).where("src != dst"), "parts-edges")
    kind, found = e.schema["src"].dataType, []
    for _ in range(max_rounds):
        for _ in range(2):  # trim: a node on a cycle has a way in and a way out; the few others are taken off
            ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out")))).alias("x")).groupBy("x.node")
            idle = cuts.written(ends.agg(F.bool_and("x.out").alias("in_none"), F.bool_or("x.out").alias("out_some")).where("in_none or not out_some").select("node"), "parts-idle")
            if idle.isEmpty():
                break
            e = e.join(idle.withColumnRenamed("node", "src"), "src", "left_anti").join(idle.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
            e = cuts.written(e, "parts-edges")
        if e.isEmpty():
            break
        colour = cuts.written(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "parts-colour")
        newest = colour
        for _ in range(max_rounds):
            passed = newest.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("from"))
            both = cuts.written(colour.join(passed, "node", "left").select("node", F.least("colour", "from").alias("colour"), (F.col("from") < F.col("colour")).alias("new")), "parts-colour")
            colour, newest = both.select("node", "colour"), both.where("new").select("node", "colour")
            if newest.isEmpty():
                break
        else:
            raise RuntimeError(f"colours did not settle in {max_rounds} steps")
        tint = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"c{end}"))
        e = cuts.written(e.join(tint("src"), "src").join(tint("dst"), "dst").where("csrc = cdst").select("src", "dst", F.col("csrc").alias("colour")), "parts-inside")
        front = part = cuts.written(colour.where("node = colour").select("node", "colour"), "parts-back")
        for _ in range(max_rounds):
            back = front.select(F.col("node").alias("dst"), "colour").join(e, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = cuts.written(back.join(part, "node", "left_anti"), "parts-back")
            if front.isEmpty():
                break
            part = cuts.written(part.unionByName(front), "parts-part")
        else:
            raise RuntimeError(f"parts were still growing after {max_rounds} steps")
        sizes = part.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        found.append(cuts.written(part.join(sizes, "colour", "left_semi"), "parts-found"))
        gone = part.select("node")
        e = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        e = cuts.written(e.select("src", "dst"), "parts-edges")
    else:
        raise RuntimeError(f"edges were left after {max_rounds} rounds")
    out = edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, colour {kind.simpleString()}")
    for f in found:
        out = out.unionByName(f.select("node", "colour"))
    out = written(out.select("node", F.col("colour").alias("part")), "parts")
    cuts.clear()
    return out


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes on a directed cycle, loops too, and the smallest node of their part."""
    loops = _edges(edges).where("src = dst").select(F.col("src").alias("node"))
    parts = strong_parts(edges)
    return parts.select("node", F.col("part").alias("cycle")).unionByName(loops.join(parts, "node", "left_anti").select("node", F.col("node").alias("cycle")))


def witnesses(edges: DataFrame, parts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(part, place, node): of each part (node, part) a shortest cycle through its smallest node, from place 0 there.

    Of ways of one length that through the smallest nodes back from the end is taken. A part whose last steps lead back to its
    smallest node goes no further: longer ways are no shortest cycle.
    """
    cuts = Cuts(edges.sparkSession)
    own = lambda end: parts.select(F.col("node").alias(end), F.col("part").alias(f"p{end}"))
    e = _edges(edges).where("src != dst").join(own("src"), "src").join(own("dst"), "dst").where("psrc = pdst")
    e = cuts.written(e.select("src", "dst", F.col("psrc").alias("part")), "witness-edges")
    closing = cuts.written(e.where("dst = part").select("part", F.col("src").alias("node")), "witness-closing")
    seen = front = cuts.written(parts.where("node = part").select("part", "node", F.lit(0).alias("place"), F.lit(None).cast(parts.schema["node"].dataType).alias("before")), "witness-seen")
    for r in range(1, max_rounds):
        step = front.select("part", F.col("node").alias("src")).join(e, ["part", "src"]).groupBy("part", F.col("dst").alias("node")).agg(F.min("src").alias("before"))
        front = cuts.written(step.join(seen, ["part", "node"], "left_anti").select("part", "node", F.lit(r).alias("place"), "before"), "witness-front")
        if front.isEmpty():
            break
        seen = cuts.written(seen.unionByName(front), "witness-seen")
        front = front.join(front.join(closing, ["part", "node"], "left_semi").select("part").distinct(), "part", "left_anti")
    last = closing.join(seen, ["part", "node"]).groupBy("part").agg(F.min(F.struct("place", "node", "before")).alias("l"))
    at = cuts.written(last.select("part", "l.place", "l.node", "l.before"), "witness-way")
    way = [at]
    for _ in range(max_rounds):
        at = cuts.written(at.where("before is not null").select("part", F.col("before").alias("node")).join(seen, ["part", "node"]).select("part", "place", "node", "before"), "witness-way")
        if at.isEmpty():
            break
        way.append(at)
    out = way[0]
    for w in way[1:]:
        out = out.unionByName(w)
    out = written(out.select("part", "place", "node"), "witness")
    cuts.clear()
    return out


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, part) of all nodes, those outside larger parts being their own, and the edges (src, dst) between different parts."""
    e = _edges(edges)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    of = written(nodes.join(strong_parts(e), "node", "left").select("node", F.coalesce("part", "node").alias("part")), "condensed-nodes")
    to = lambda end: of.select(F.col("node").alias(end), F.col("part").alias(f"p{end}"))
    between = e.join(to("src"), "src").join(to("dst"), "dst").where("psrc != pdst").select(F.col("psrc").alias("src"), F.col("pdst").alias("dst")).distinct()
    return of, written(between, "condensed-edges")


def reach(edges: DataFrame) -> DataFrame:
    """(node, reached): how many other nodes each node reaches.

    Exact, from a closure of the condensed graph only: all nodes of a part reach the same, and each other.
    """
    of, between = condensed(edges)
    sizes = of.groupBy("part").agg(F.count("*").alias("n"))
    beyond = reachable(between).join(sizes.withColumnRenamed("part", "dst"), "dst").groupBy(F.col("src").alias("part")).agg(F.sum("n").alias("far"))
    return of.join(sizes, "part").join(beyond, "part", "left").select("node", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("reached"))
