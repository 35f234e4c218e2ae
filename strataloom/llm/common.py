"""Shared plumbing of the training-data operators: tables, written cut points, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or "/tmp/checkpoints/strataloom").rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Cuts:
    """Written cut points of one operator, removed together once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        """As ``written``, but kept in mind for ``clear``."""
        self.paths.append(f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        """Remove the files from the shared folder, through Spark's own file systems."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (columns ``a``, ``b``).

    Returns (``id``, ``component``) for every id that occurs in an edge between two different ids; ``component`` is the
    smallest id reachable. Rounds of contraction: every id hooks to its smallest neighbour, chains are shortened by
    pointer jumping, the edges are relabelled and deduplicated. Every step is a join or a grouped minimum (combined
    before its shuffle); the edges shrink by a factor each round and nothing is gathered on the driver.
    Null ids are ignored, loops and repeated edges change nothing, no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct()
    cuts = Cuts(e.sparkSession)
    e = cuts.written(e, "cc-edges")
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("p"))
        hook = cuts.written(hook, "cc-hook")
        for _ in range(2):
            up = hook.select(F.col("id").alias("p"), F.col("p").alias("up"))
            hook = hook.join(up, "p").select("id", F.col("up").alias("p"))
        hook = cuts.written(hook, "cc-label")
        steps.append(hook)
        la, lb = hook.select(F.col("id").alias("a"), F.col("p").alias("pa")), hook.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        e = e.join(la, "a").join(lb, "b").where("pa != pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        e = cuts.written(e, "cc-edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not steps:
        out = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    else:
        out = steps[0].select("id", F.col("p").alias("component"))
    for s in steps[1:]:
        nxt = s.select(F.col("id").alias("component"), "p")
        out = out.join(nxt, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
    out = written(out, "cc-out")
    cuts.clear()
    return out
