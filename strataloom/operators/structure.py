"""Structure of projects and corpora: advisories, matrices, reachability, communities, cluster agreement."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.sources.tables import Cuts, written


def version_key(version: Column) -> Column:
    """A dotted version as an array of its numbers, trailing zeros left out, so that arrays compare as versions do; null without a number."""
    numbers = F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    last = F.aggregate(F.sequence(F.lit(1), F.size(numbers)), F.lit(0), lambda a, i: F.when(F.element_at(numbers, i) > 0, i).otherwise(a))
    return F.when(F.size(numbers) > 0, F.slice(numbers, 1, last))


def advisories(dependencies: DataFrame, catalog: DataFrame) -> DataFrame:
    """Dependencies (artifact, version, ...) that an advisory (artifact, low, high, ...) covers: low <= version < high.

    An open end is null. The artifacts are joined by key, the range is a residual condition of that join. A dependency
    without a version is covered by none.
    """
    d = dependencies.withColumn("_v", version_key(F.col("version")))
    c = catalog.withColumn("_lo", version_key(F.col("low"))).withColumn("_hi", version_key(F.col("high")))
    inside = (F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    return d.join(c, "artifact").where(F.col("_v").isNotNull() & inside).drop("_v", "_lo", "_hi")


def version_conflicts(dependencies: DataFrame) -> DataFrame:
    """(artifact, versions, uses) of artifacts used in more than one version."""
    by_version = dependencies.where("artifact is not null and version is not null").groupBy("artifact", "version").agg(F.count("*").alias("n"))
    return by_version.groupBy("artifact").agg(F.count("*").alias("versions"), F.sum("n").alias("uses")).where("versions > 1")


def dependency_matrix(edges: DataFrame) -> DataFrame:
    """(src, dst, n, mutual): the cells of the matrix of different nodes, and whether the opposite cell is filled too."""
    cells = edges.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    back = cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"))
    return cells.join(back, ["src", "dst"], "left").select("src", "dst", "n", F.coalesce("back", F.lit(False)).alias("mutual"))


def unreached(nodes: DataFrame, edges: DataFrame, entries: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Nodes (column node) that no entry reaches along the edges; every round's frontier is a join, written."""
    step = edges.select(F.col("src").alias("node"), "dst").where("src != dst").distinct()
    seen = front = written(entries.select("node").distinct(), "reach")
    for _ in range(max_rounds):
        front = written(front.join(step, "node").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"), "reach-new")
        if front.isEmpty():
            return nodes.select("node").distinct().join(seen, "node", "left_anti")
        seen = written(seen.unionByName(front), "reach")
    raise RuntimeError(f"the frontier was not empty after {max_rounds} rounds")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at neither end of an edge."""
    return nodes.select("node").distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community, settled) by weighted label propagation over undirected edges (src, dst, weight).

    All nodes change at once: each takes the label with the most weight among its neighbours and itself (its own vote
    weighs as much as its heaviest edge), ties go to the smaller label, so results do not depend on the order of rows. It
    stops when no label changes, or after ``rounds``; ``settled`` tells which nodes kept theirs in the last one.
    """
    spark = edges.sparkSession
    cuts, parts = Cuts(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = cuts.written(edges.where("src is not null and dst is not null and src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "lp-given")
    # Numbers in the order of the nodes stand for them: ties are the same, rows are small.
    nodes = e.select("src").union(e.select("dst")).distinct().orderBy("src").select(F.col("src").alias("node"), F.monotonically_increasing_id().alias("i"))
    nodes = cuts.written(nodes, "lp-nodes")
    for end in ("src", "dst"):
        e = e.join(nodes.select(F.col("node").alias(end), F.col("i").alias(f"{end}_i")), end)
    e = cuts.written(e.select(F.col("src_i").alias("src"), F.col("dst_i").alias("dst"), "weight"), "lp-numbered")
    both = e.union(e.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    both = cuts.written(both.unionByName(both.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")), "lp-edges")
    voters = both.repartition(parts, "dst").persist(StorageLevel.DISK_ONLY)  # every round reads them where they are, by dst
    labels = nodes.select("i", F.col("i").alias("community"), F.lit(False).alias("settled"))
    for _ in range(rounds):
        votes = voters.join(labels.select(F.col("i").alias("dst"), "community").hint("shuffle_hash"), "dst").select(F.col("src").alias("i"), "community", "weight")
        votes = votes.repartition(parts, "i").groupBy("i", "community").agg(F.sum("weight").alias("weight"))  # both sums where a node's votes are
        best = votes.groupBy("i").agg(F.min_by("community", F.struct(-F.col("weight"), F.col("community"))).alias("new"))
        labels = cuts.written(best.join(labels.select("i", "community"), "i").select("i", F.col("new").alias("community"), (F.col("new") == F.col("community")).alias("settled")), "lp-labels")
        if labels.where("not settled").isEmpty():
            break
    names = nodes.select(F.col("i").alias("community"), F.col("node").alias("name"))
    out = written(labels.join(nodes, "i").join(names, "community").select("node", F.col("name").alias("community"), "settled"), "lp-found")
    voters.unpersist()
    cuts.clear()
    return out


def cluster_agreement(both: DataFrame, first: str, second: str) -> DataFrame:
    """One row: rows, Rand index and mean best-match Jaccard (of the first's clusters) of two clusterings of the same rows.

    Pairs are counted from the contingency table, never listed. Rows without one of the labels are left out.
    """
    cells = both.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    wide = cells.join(cells.groupBy("a").agg(F.sum("n").alias("na")), "a").join(cells.groupBy("b").agg(F.sum("n").alias("nb")), "b")
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    best = wide.groupBy("a").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j")).agg(F.avg("j").alias("jaccard"))
    same = wide.agg(F.sum("n").alias("n"), pairs("n").alias("ab"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("pa"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("pb"))
    one = same.crossJoin(rows).crossJoin(cols).crossJoin(best)  # four tables of one row
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(total > 0, (total + 2 * F.col("ab") - F.col("pa") - F.col("pb")) / total).otherwise(1.0).alias("rand"), "jaccard")


def cross_corpus_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, kind, weight) between items (id, rule_id, content_hash) of two corpora with one rule.

    Of the first corpus the item with the largest id stands for its rule. Equal contents are same_rule (1.0), others
    evolved_from (0.8), from the second's item to the first's.
    """
    last = a.where("rule_id is not null").groupBy("rule_id").agg(F.max_by(F.struct("id", "content_hash"), "id").alias("o"))
    same = F.col("content_hash").eqNullSafe(F.col("o.content_hash"))
    got = b.join(last, "rule_id")
    return got.select(F.when(same, F.col("o.id")).otherwise(F.col("id")).alias("src"), F.when(same, F.col("id")).otherwise(F.col("o.id")).alias("dst"), F.when(same, "same_rule").otherwise("evolved_from").alias("kind"), F.when(same, 1.0).otherwise(0.8).alias("weight"))


def compacted(edges: DataFrame, superseded: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, weight) with the nodes of ``superseded`` (node, by) replaced; similar edges of such nodes, loops and repeats go (the heaviest stays)."""
    s = superseded.select("node", "by")
    e = edges.join(s.select(F.col("node").alias("src"), F.col("by").alias("_s")), "src", "left").join(s.select(F.col("node").alias("dst"), F.col("by").alias("_d")), "dst", "left")
    moved = F.col("_s").isNotNull() | F.col("_d").isNotNull()
    e = e.where(~(moved & (F.col("kind") == "similar"))).select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "kind", "weight")
    return e.where("src != dst").groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))
