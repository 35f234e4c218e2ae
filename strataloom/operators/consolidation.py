"""Incremental consolidation of memory items: clusters, canonical items, supersession links, promotions and events by version.

Items (id, kind, first_tag, embedding, content, tags, confidence, tier, usage, validation, has_source, archived) are clustered
as ``clusters_by_type`` does: by id, each free item founding a cluster. So items that come later than all before change
nothing of what there is, and a delta compares its items with the founders and with each other only: deltas in the order
of ids give what one run over all gives. An item without a usable vector is alone: whether all of its type and tag have
none can change with the next batch. Founders are in a kept vector index.

Every version is written to folders of its own and counts once its line in the log is written, which comes last. A batch
is known by its name: one that is tried again after it was logged changes nothing, one that failed before starts over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.measures import usable_vector
from strataloom.operators.graph import components
from strataloom.operators.items import clusters_by_type
from strataloom.operators.records import merged
from strataloom.operators.vector_index import VectorIndex
from strataloom.sources.tables import Cuts, written

#: Uses from which an item goes to the long-term tier, and types that go there by themselves.
USES, PROMOTED = 5, ("constraint", "decision", "definition")
_LOG = "version long, batch string, folder string, items long, clusters long, merged long, promoted long"
_KEPT = ["id", "kind", "first_tag", "embedding", "content", "tags", "confidence", "tier", "usage", "validation", "has_source"]


def cluster_key() -> Column:
    return F.concat_ws(":", "kind", F.lower("first_tag"))


def promoted_tier() -> Column:
    """The tier that an item's use, type or validation lifts it to; null where it stays.

    From short to mid term, from mid to long term; the first step also by two uses. Without a source only that one is open.
    """
    strong = (F.coalesce(F.col("usage"), F.lit(0)) >= USES) | F.coalesce(F.col("kind").isin(*PROMOTED), F.lit(False)) | F.coalesce(F.col("validation") == "verified", F.lit(False))
    twice = (F.col("tier") == "stm") & (F.coalesce(F.col("usage"), F.lit(0)) >= 2)
    up = F.when(F.col("tier") == "mtm", "ltm").otherwise("mtm")
    return F.when(F.col("tier") == "ltm", None).when(strong & F.coalesce("has_source", F.lit(False)), up).when(~strong & twice, "mtm")


class Consolidation:
    """The versioned result at ``path``."""

    def __init__(self, spark: SparkSession, path: str, most_distance: float = 0.3):
        self.spark, self.path, self.distance = spark, path.rstrip("/"), most_distance

    def log(self) -> DataFrame:
        """A line for each version: its batch, items, clusters touched, items merged and promoted."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _LOG)

    def _table(self, name: str, schema: str) -> DataFrame:
        folders = [r["folder"] for r in self.log().collect()]  # one a version
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}/{name}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def members(self) -> DataFrame:
        """(id, cluster, version): where each item is, and since when; a cluster is named by its founder."""
        return self._table("members", "id long, cluster long, version long")

    def items(self) -> DataFrame:
        return self._table("items", "id long, kind string, first_tag string, embedding array<double>, content string, tags array<string>, confidence double, tier string, usage long, validation string, has_source boolean")

    def canonical(self) -> DataFrame:
        """(cluster, revision, members, id, content, tags, confidence, version): merged items, a revision each time their cluster grew."""
        return self._table("canonical", "cluster long, revision long, members long, id long, content string, tags array<string>, confidence double, version long")

    def current(self) -> DataFrame:
        """The last revision of each canonical item."""
        last = self.canonical().groupBy("cluster").agg(F.max("revision").alias("revision"))
        return self.canonical().join(last, ["cluster", "revision"], "left_semi")

    def links(self) -> DataFrame:
        """(src, dst, rel, version): a canonical item and each item that it supersedes."""
        return self._table("links", "src long, dst long, rel string, version long")

    def events(self) -> DataFrame:
        """(id, action, detail, version): merges of clusters, and promotions with the tier."""
        return self._table("events", "id long, action string, detail string, version long")

    def apply(self, items: DataFrame, batch: str) -> Consolidation:
        """Takes in a batch: archived items, null ids and ids that are there already are left out, of rows that repeat an id one stays.

        Its ids must come after those before, if deltas are to equal one run; where they do not, each joins the first founder
        near enough all the same.
        """
        done = self.log().collect()
        if any(r["batch"] == batch for r in done):
            return self
        version, folder, cuts = len(done) + 1, f"v-{uuid.uuid4().hex}", Cuts(self.spark)
        put = lambda df, name: df.coalesce(8).write.parquet(f"{self.path}/{folder}/{name}")
        now = F.lit(version).cast("long").alias("version")
        fresh = items.where("id is not null and not coalesce(archived, false)").select(F.col("id").cast("long").alias("id"), *(F.col(c) for c in _KEPT[1:]))
        fresh = fresh.withColumn("embedding", F.col("embedding").cast("array<double>")).dropDuplicates(["id"]).join(self.members().select("id"), "id", "left_anti")
        fresh = cuts.written(fresh.select("id", "kind", "first_tag", "embedding", F.col("content").cast("string"), F.col("tags").cast("array<string>"), F.col("confidence").cast("double"), F.col("tier").cast("string"), F.col("usage").cast("long"), F.col("validation").cast("string"), F.col("has_source").cast("boolean")), "new-items")
        keyed = fresh.select("id", cluster_key().alias("key"), "embedding")

        # Against the founders there are: the first one near enough, of the same type and tag.
        at = f"{self.path}/founders"
        joined = self.spark.createDataFrame([], "id long, cluster long")
        if done:
            founders = VectorIndex(self.spark, at)
            near = founders.near(keyed.where(usable_vector(F.col("embedding"))), 1.0 - self.distance, vec_id="id", same="key").withColumnRenamed("id", "cluster").withColumnRenamed("query_id", "id")
            old = self._founder_keys()
            near = near.join(keyed.select("id", "key"), "id").join(old, ["cluster", "key"]).groupBy("id").agg(F.min("cluster").alias("cluster"))
            joined = joined.unionByName(near)
        joined = cuts.written(joined.groupBy("id").agg(F.min("cluster").alias("cluster")), "new-joined")
        rest = cuts.written(fresh.join(joined, "id", "left_anti"), "new-rest")
        own = clusters_by_type(rest, self.distance, bare=False) if not rest.isEmpty() else self.spark.createDataFrame([], "id long, cluster long")
        placed = cuts.written(joined.unionByName(own), "new-placed")

        put(fresh, "items")
        put(placed.select("id", "cluster", now), "members")
        # Clusters that grew: merged anew from all their members.
        grown = placed.select("cluster").distinct()
        whole = self.members().select("id", "cluster").unionByName(placed).join(grown, "cluster", "left_semi")
        several = whole.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
        whole = cuts.written(whole.join(several, "cluster", "left_semi"), "new-whole")
        full = self.items().select("id", "content", "tags", "confidence").unionByName(fresh.select("id", "content", "tags", "confidence")).join(whole, "id")
        before = self.canonical().groupBy("cluster").agg(F.max("revision").alias("was"))
        better = merged(full.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), "cluster").join(before, "cluster", "left")
        put(better.select("cluster", (F.coalesce("was", F.lit(0)) + 1).cast("long").alias("revision"), F.col("members").cast("long").alias("members"), "id", "content", "tags", F.col("confidence").cast("double").alias("confidence"), now), "canonical")
        linked = self.links().select(F.col("dst").alias("id"))
        put(whole.join(linked, "id", "left_anti").select(F.col("cluster").alias("src"), F.col("id").alias("dst"), F.lit("supersedes").alias("rel"), now), "links")
        alone = fresh.join(whole, "id", "left_anti").withColumn("to", promoted_tier()).where("to is not null")
        merges = whole.groupBy("cluster").agg(F.count("*").alias("n")).select(F.col("cluster").alias("id"), F.lit("merge").alias("action"), F.col("n").cast("string").alias("detail"), now)
        put(merges.unionByName(alone.select("id", F.lit("promote").alias("action"), F.col("to").alias("detail"), now)), "events")

        made = fresh.join(placed.where("id = cluster"), "id", "left_semi").select("id", cluster_key().alias("key"), "embedding")
        if done:
            VectorIndex(self.spark, at).append(made, batch, "id", "embedding")
        else:
            VectorIndex.build(made, at, "id", "embedding", batch=batch)
        count = lambda df: df.count()
        line = (version, batch, folder, count(fresh), count(grown), count(whole), count(alone))
        self.spark.createDataFrame([line], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        cuts.clear()
        return self

    def _founder_keys(self) -> DataFrame:
        """(cluster, key) of all founders."""
        own = self.members().where("id = cluster").select("id")
        return self.items().join(own, "id", "left_semi").select(F.col("id").alias("cluster"), cluster_key().alias("key"))


def graph_components(items: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
    """(id, component): items (id, doc, first_tag) within two steps of each other in a graph (src, dst) and of one document, one first tag, or ``near`` (a, b) by their vectors.

    Two such items share a node that they are next to or are. For each node and document, and node and tag, every item is
    linked with the first one only, which joins the same components as all pairs would; a hub costs its degree.
    """
    e = edges.where("src is not null and dst is not null").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    name = items.select("id", F.concat(F.lit("i"), F.col("id")).alias("node"), "doc", F.lower("first_tag").alias("tag"))
    next_to = e.select(F.col("src").alias("node"), F.col("dst").alias("hub")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("hub"))).unionByName(name.select("node", F.col("node").alias("hub")))  # repeats make no other links, so they stay
    at = written(next_to.join(name, "node").select("id", "hub", "doc", "tag"), "consolidation-hubs")
    links = None
    for sign in ("doc", "tag"):
        some = at.where(f"coalesce({sign}, '') != ''")
        first = some.groupBy("hub", sign).agg(F.min("id").alias("first"))
        star = some.join(first, ["hub", sign]).where("id != first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
        links = star if links is None else links.unionByName(star)
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    here = at.select("id", "hub").join(ends, "id", "left_semi").distinct()  # few items are near any
    a, b = here.select(F.col("id").alias("a"), "hub"), here.select(F.col("id").alias("b"), "hub")
    both = near.select("a", "b").join(a, "a").join(b, ["b", "hub"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    of = components(links.unionByName(both).distinct())
    return items.select("id").distinct().join(of.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clusters_by_graph(items: DataFrame, edges: DataFrame, near: DataFrame, most_distance: float = 0.3) -> DataFrame:
    """(id, component, cluster): ``clusters_by_type`` within the components of ``graph_components``."""
    of = written(graph_components(items, edges, near), "graph-components")
    found = clusters_by_type(items.join(of, "id").withColumn("kind", F.concat_ws("/", "component", "kind")), most_distance)
    return of.join(found, "id").select("id", "component", "cluster")
