"""Merkle manifest of a dataset: persisted levels bottom-up, proofs pushed top-down.

Rows are leaves of one tree a group, in the order given; every 16 consecutive nodes become one, until one is left: the
group's root. The groups' roots, in the order of the groups, are the leaves of a tree of trees. Each level is written. On
the way down every level joins its nodes to their parents, a child takes its siblings from its parent and puts them in
front of what the parent inherited, so a leaf has its whole proof after as many joins as there are levels.

Places in a group come from a sort by range: rows are numbered in their partition, and a table with one row for each group
and partition that it touches says how many rows come before. So a group of any size is spread over partitions, and no
key but a run of 16 is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cuts

FANOUT = 16


def digest_of(parts: Column) -> Column:
    """Lower-case hex SHA-256 of an array of digests or texts, joined."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row: each value as its length in UTF-8 bytes, a colon and itself; ``-`` for null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, columns)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return digest_of(F.transform(proof, lambda step: F.concat(step["left"], step["right"])))


def _no_proof() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def _placed(rows: DataFrame, order: list[str], cuts: Cuts) -> DataFrame:
    """``rows`` with their place (``idx``, from 0) in their tree in ``order`` and the tree's size ``n``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    dealt = cuts.written(dealt.withColumn("m", F.monotonically_increasing_id()), "merkle-leaves")
    dealt = dealt.withColumn("pid", F.shiftright("m", 33)).withColumn("m", F.col("m").bitwiseAND((1 << 33) - 1))
    runs = dealt.groupBy("tree", "pid").agg(F.min("m").alias("first"), F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    before = F.sum("here").over(tree.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("tree").alias("t"), F.col("pid").alias("p"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    placed = dealt.join(runs, F.col("tree").eqNullSafe(F.col("t")) & (F.col("pid") == F.col("p")))
    return placed.withColumn("idx", F.col("m") + F.col("shift")).drop("t", "p", "m", "pid", "shift")


class Forest:
    """Trees over ``rows`` (column ``digest``), one for each value of ``tree`` (null is a tree too), leaves in ``order``."""

    def __init__(self, rows: DataFrame, order: list[str], cuts: Cuts, fanout: int = FANOUT):
        self.fanout, self.cuts = fanout, cuts
        self.leaves = _placed(rows, order, cuts)
        self.levels = [self.leaves.select("tree", "idx", "n", "digest")]
        most = self.levels[0].agg(F.max("n")).first()[0] or 0
        while most > 1:
            kids = F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda k: k["digest"])
            up = self.levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.ceil(F.first("n") / fanout).alias("n"), kids.alias("kids"))
            self.levels.append(cuts.written(up.withColumn("digest", digest_of(F.col("kids"))), "merkle-level"))
            most = -(-most // fanout)

    def roots(self) -> DataFrame:
        """(tree, digest): what remains of each tree."""
        out = self.levels[0].where("n = 1").select("tree", "digest")
        for level in self.levels[1:]:
            out = out.unionByName(level.where("n = 1").select("tree", "digest"))
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves' rows with ``proof``; ``above`` (tree, proof, ...) is what each tree's root inherits, its other columns come along."""
        named = [c for c in above.columns if c != "tree"]
        above = above.withColumnRenamed("tree", "t")
        got = None
        for depth in range(len(self.levels) - 1, -1, -1):
            nodes = self.levels[depth] if depth else self.leaves
            tops = nodes.where("n = 1").join(above, F.col("tree").eqNullSafe(F.col("t"))).drop("t")
            if got is not None:
                place = F.col("idx") % self.fanout
                up = got.select(F.col("tree").alias("t"), F.col("idx").alias("run"), F.col("kids").alias("run_kids"), *named)
                kids = nodes.where("n > 1").join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.floor(F.col("idx") / self.fanout) == F.col("run")))
                left, right = F.slice("run_kids", 1, place.cast("int")), F.slice("run_kids", (place + 2).cast("int"), self.fanout)
                own = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
                kids = kids.withColumn("proof", F.concat(F.array(own), F.col("proof"))).drop("t", "run", "run_kids")
                tops = kids.unionByName(tops)
            got = self.cuts.written(tops, "merkle-push") if depth else tops
        return got


def prove(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """``rows`` with ``subroot`` (of their group), ``root`` (of all) and ``proof``: their siblings on the way from leaf to root.

    ``leaf`` is a digest, as of ``leaf_digest``. A proof is an array of (left, right), from the leaf's level to the root's:
    digests of the siblings before and after, joined; ``fold`` leads from leaf and proof to the root. Within a group, leaves
    ascend by ``order`` (nulls first), then by digest; rows that repeat are leaves of their own. A null group is a group and
    comes first. A lone leaf is its group's root, a lone group's root is the root. No rows, no result. Other columns come
    along unless they are called subroot, root, proof, tree, idx, n, digest or kids.
    """
    cuts = Cuts(rows.sparkSession)
    leaves = rows.withColumn("tree", F.col(group)).withColumn("digest", F.col(leaf))
    inner = Forest(leaves, [*order, "digest"], cuts, fanout)
    subroots = cuts.written(inner.roots(), "merkle-roots")
    outer = Forest(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("of"), "digest"), ["of"], cuts, fanout)
    root = outer.roots().withColumnRenamed("digest", "root").withColumn("proof", _no_proof())
    above = outer.proofs(root).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    return inner.proofs(cuts.written(above, "merkle-above")).drop("tree", "idx", "n", "digest", "kids")
