"""Code metrics over tables of methods (project, file, name, complexity, cognitive, parameters, depth, loc) and of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.cycles import on_cycles
from strataloom.operators.graph import coupling

#: Upper ends of the complexity classes.
LEVELS = (("low", 5), ("moderate", 10), ("high", 20), ("very_high", None))


def debt_minutes(m: DataFrame) -> Column:
    """Minutes to mend: 5 for each point of complexity over 10, 3 of cognitive complexity over 15, 10 for each parameter over 5, 15 for each depth over 4."""
    over = lambda c, most, cost: F.greatest(F.col(c) - most, F.lit(0)) * cost
    return over("complexity", 10, 5) + over("cognitive", 15, 3) + over("parameters", 5, 10) + over("depth", 4, 15)


def maintainability(loc: Column, complexity: Column) -> Column:
    """Index from 0 to 100 of total lines and total complexity; 100 without lines."""
    safe = F.greatest(loc, F.lit(1)).cast("double")
    volume = F.greatest(loc * F.log2(safe), F.lit(1.0))
    index = (171 - 5.2 * F.log(volume) - 0.23 * complexity - 16.2 * F.log(safe)) * 100 / 171
    return F.when(loc == 0, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)), 1))


def project_metrics(methods: DataFrame) -> DataFrame:
    """(project, files, methods, loc, complexity, mean_complexity, debt_hours, maintainability) of each project."""
    out = methods.withColumn("debt", debt_minutes(methods)).groupBy("project").agg(F.countDistinct("file").alias("files"), F.count("*").alias("methods"), F.sum("loc").alias("loc"), F.sum("complexity").alias("complexity"), F.avg("complexity").alias("mean_complexity"), (F.sum("debt") / 60.0).alias("debt_hours"))
    return out.withColumn("maintainability", maintainability(F.col("loc"), F.col("complexity")))


def complexity_histogram(methods: DataFrame) -> DataFrame:
    """(level, methods, share) of each complexity class."""
    level = F.lit(LEVELS[-1][0])
    for name, top in reversed(LEVELS[:-1]):
        level = F.when(F.col("complexity") <= top, name).otherwise(level)
    n = methods.groupBy(level.alias("level")).agg(F.count("*").alias("methods"))
    total = n.agg(F.sum("methods").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("level", "methods", (F.col("methods") / F.col("total")).alias("share"))  # one row


def hotspots(methods: DataFrame, edges: DataFrame, complexity: int = 10, loc: int = 500, members: int = 20, coupled: int = 15, k: int = 50) -> DataFrame:
    """(name, type, value, severity, score): complex methods, large files, files of many methods and coupled nodes over their limits; the ``k`` with the highest scores."""
    over = lambda df, name, kind, value, limit, worse, mild, score: df.select(F.col(name).cast("string").alias("name"), F.lit(kind).alias("type"), F.col(value).cast("double").alias("value"), F.when(F.col(value) > 2 * limit, worse).otherwise(mild).alias("severity"), (F.col(value) * score).cast("double").alias("score"))
    hard = over(methods.where(F.col("complexity") >= complexity), "name", "complexity", "complexity", complexity, "critical", "high", 10)
    files = methods.groupBy("file").agg(F.sum("loc").alias("loc"), F.count("*").alias("n"))
    large = over(files.where(F.col("loc") > loc), "file", "large_file", "loc", loc, "high", "medium", 0.1)
    god = over(files.where(F.col("n") > members), "file", "god_class", "n", members, "high", "medium", 5)
    near = coupling(edges).withColumn("total", F.col("ca") + F.col("ce"))
    tied = over(near.where(F.col("total") > coupled), "node", "high_coupling", "total", coupled, "high", "medium", 3)
    return hard.unionByName(large).unionByName(god).unionByName(tied).orderBy(F.desc("score"), "type", "name").limit(k)


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, loops, mutual pairs, sources, sinks, density, largest degrees."""
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    deg = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    of_nodes = deg.agg(F.count("*").alias("nodes"), F.count_if(F.col("i") == 0).alias("sources"), F.count_if(F.col("o") == 0).alias("sinks"), F.max("o").alias("most_out"), F.max("i").alias("most_in"))
    pairs = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    of_edges = pairs.agg(F.sum("n").alias("edges"), F.count_if(F.col("a") == F.col("b")).alias("loops"), F.count_if((F.col("a") != F.col("b")) & (F.col("n") == 2)).alias("mutual"))
    one = of_nodes.crossJoin(of_edges)  # two tables of one row
    return one.withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def cyclic_groups(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes on a directed cycle, and the smallest node of their strongly connected part."""
    return on_cycles(edges)


def unused_imports(imports: DataFrame, uses: DataFrame) -> DataFrame:
    """Imports (src, dst) whose target no use (column dst) names."""
    return imports.join(uses.select("dst").distinct(), "dst", "left_anti").select("src", "dst")


def betweenness(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, centrality): share of shortest paths through each node, over all ordered pairs, by rounds of joins.

    Paths are counted level by level from every node at once, then shares flow back from the deepest level. It holds a row
    for each pair of nodes that reach each other: for the graphs of modules, not of items.
    """
    from strataloom.sources.tables import written

    e = written(edges.select("src", "dst").where("src != dst").distinct(), "btw-edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = nodes.count()
    seen = level = written(nodes.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "btw-level")
    depth = 0
    for d in range(1, max_rounds):
        step = level.join(e, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = written(step.join(seen, ["s", "node"], "left_anti").select("s", "node", F.lit(d).alias("d"), "paths"), "btw-level")
        if level.isEmpty():
            break
        depth, seen = d, seen.unionByName(level)
    else:
        raise RuntimeError(f"paths were still growing after {max_rounds} rounds")
    share = seen.withColumn("share", F.lit(0.0)).where(F.col("d") == depth).select("s", "node", "d", "paths", "share")
    done = share
    for d in range(depth - 1, 0, -1):
        own = seen.where(F.col("d") == d)
        below = e.join(share.select("s", F.col("node").alias("dst"), F.col("paths").alias("below"), F.col("share").alias("add")), "dst").select("s", F.col("src").alias("node"), "below", "add")
        back = own.join(below, ["s", "node"], "left").groupBy("s", "node", "d", "paths").agg(F.coalesce(F.sum(F.col("paths") / F.col("below") * (1 + F.col("add"))), F.lit(0.0)).alias("share"))
        share = written(back, "btw-share")
        done = done.unionByName(share)
    total = done.groupBy("node").agg(F.sum("share").alias("c"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(total, "node", "left").select("node", (F.coalesce("c", F.lit(0.0)) * scale).alias("centrality"))


def longest_paths(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, length): edges of the longest path that ends in each node, on a graph without cycles."""
    from strataloom.sources.tables import written

    e = written(edges.select("src", "dst").where("src != dst").distinct(), "path-edges")
    best = front = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("length", F.lit(0)), "path")
    for r in range(1, max_rounds):
        front = written(front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("length", F.lit(r)), "path")
        if front.isEmpty():
            return best.groupBy("node").agg(F.max("length").alias("length"))
        best = best.unionByName(front)
    raise RuntimeError(f"paths were still growing after {max_rounds} rounds: a cycle")


def direct_neighbours(edges: DataFrame) -> DataFrame:
    """(node, dependencies, dependents): sorted arrays of what each node points to and is pointed to by."""
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("d"), F.lit(None).cast("string").alias("u")).unionByName(e.select(F.col("dst").alias("node"), F.lit(None).cast("string").alias("d"), F.col("src").alias("u")))
    return out.groupBy("node").agg(F.array_sort(F.collect_list("d")).alias("dependencies"), F.array_sort(F.collect_list("u")).alias("dependents"))


def edge_lines(edges: DataFrame, form: str) -> DataFrame:
    """(line) of each edge (src, dst, kind) as ``dot``, ``mermaid`` or ``json``; the sink adds head and foot."""
    if form == "dot":
        line = F.format_string('"%s" -> "%s" [label="%s"];', "src", "dst", "kind")
    elif form == "mermaid":
        safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
        line = F.format_string("%s -->|%s| %s", safe("src"), F.col("kind"), safe("dst"))
    else:
        line = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type")))
    return edges.select(line.alias("line"))


def merkle_roots(leaves: DataFrame, group: str, order: list[str], content: str, max_rounds: int = 64) -> DataFrame:
    """(group, leaves, root): pairwise hashes of hashes in order; of an odd number the last is paired with itself."""
    from strataloom.sources.tables import written

    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    size = F.count("*").over(Window.partitionBy(group))
    level = written(leaves.select(group, place.alias("i"), size.alias("n"), size.alias("leaves"), F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256).alias("h")), "merkle")
    for _ in range(max_rounds):
        if level.where("n > 1").isEmpty():
            return level.select(group, "leaves", F.col("h").alias("root"))
        left, right = F.max(F.when(F.col("i") % 2 == 0, F.col("h"))), F.max(F.when(F.col("i") % 2 == 1, F.col("h")))
        up = level.where("n > 1").groupBy(group, "leaves", "n", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(F.sha2(F.concat(left, F.coalesce(right, left)), 256).alias("h"))
        level = written(up.select(group, "i", F.ceil(F.col("n") / 2).alias("n"), "leaves", "h").unionByName(level.where("n = 1")), "merkle")
    raise RuntimeError("too many leaves")
