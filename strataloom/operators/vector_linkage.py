"""Linkage clustering of vectors by cosine over all their pairs, none of which is written.

Average: the mean similarity of two clusters is the inner product of their sums of unit vectors over both sizes, so a cluster
is one row however large it is. Of every round all clusters merge that are each other's nearest, as in ``linkage.agglomerated``;
no merge brings another cluster nearer, so a cluster looks for its nearest anew only if it has grown or its nearest has, and
one without any that is near enough stays as it is. What few are left at the end merge in one task.

Single: trees pick their best edge to another one. The edges of a list of each vector's nearest are known; a vector none of whose
nearest is in another tree, but whose last one is nearer than the best edge of its tree, asks the index for its nearest in
another tree. So each pick is that of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.graph import components
from strataloom.operators.linkage import _preferred
from strataloom.operators.vector_index import VectorIndex, _rows_of, _unit
from strataloom.sources.tables import Cuts, written

ALONE = 4096  # clusters that one task merges to the end
ROWS = 16_384  # clusters that one task compares with others
TASKS = 64  # that a round's comparison is cut into
LINES = 256  # clusters that are compared with those at once
SLICE = 65_536  # pairs of which the exact similarity is taken at once
SLACK = 1e-9  # of a similarity, for rounding
_MERGES = "round int, a long, b long, distance double, size long"


def _ones(batches):
    for batch in batches:
        if batch.num_rows:
            u = _unit(_rows_of(batch.column("vec").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.ones(len(u), np.int64)), pa.array([v.tobytes() for v in u], pa.binary())], names=["id", "n", "vec"])


def _added(batches):
    for batch in batches:
        if batch.num_rows:
            total = _rows_of(batch.column("va").to_pylist()) + _rows_of(batch.column("vb").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array([v.tobytes() for v in total], pa.binary())], names=["id", "n", "vec"])


def _ties(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, the same from both sides."""
    h = np.minimum(a, b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(a, b).astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _means(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Mean similarities of pairs, row by row, each sum from the first component to the last: the same from both sides."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total / (n * m)


def _best(asks, rows, least: float):
    """(id, s, tie, nn) of the most similar row of each of ``asks``, both (ids, n, sums)."""
    (ids, n, x), (other, m, y) = asks, rows
    s = (x @ y.T) / n[:, None] / m[None, :]
    s[ids[:, None] == other[None, :]] = -np.inf
    i, j = np.nonzero(s >= np.maximum(s.max(axis=1), least)[:, None] - SLACK)
    del s
    exact = np.concatenate([_means(x[i[b : b + SLICE]], y[j[b : b + SLICE]], n[i[b : b + SLICE]], m[j[b : b + SLICE]]) for b in range(0, len(i), SLICE)]) if len(i) else np.zeros(0)
    tie = _ties(ids[i], other[j])
    order = np.lexsort((other[j], tie, exact, i))
    last = order[np.flatnonzero(np.append(i[order][1:] != i[order][:-1], True))] if len(i) else order
    last = last[exact[last] >= least]
    return pa.RecordBatch.from_arrays([pa.array(ids[i[last]]), pa.array(exact[last]), pa.array(tie[last]), pa.array(other[j[last]])], names=["id", "s", "tie", "nn"])


def _compared(least: float):
    """Of each (group, share) the rows first, then those that ask."""

    def columns(batch):
        number = lambda c, dtype: batch.column(c).to_numpy(zero_copy_only=False).astype(dtype)
        return number("id", np.int64), number("n", np.float64), _rows_of(batch.column("vec").to_pylist())

    def run(batches):
        now, pieces, rows = None, [], None
        for batch in batches:
            what = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "share", "role")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((what[1:] != what[:-1]).any(axis=1)) + 1, [len(what)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == b:
                    continue
                if now != tuple(what[a][:2]):
                    now, pieces, rows = tuple(what[a][:2]), [], None
                here = columns(batch.slice(a, b - a))
                if what[a][2] == 0:
                    pieces.append(here)
                elif pieces or rows:
                    if rows is None:
                        rows, pieces = tuple(np.concatenate(c) for c in zip(*pieces)), []
                    for c in range(0, b - a, LINES):
                        yield _best(tuple(v[c : c + LINES] for v in here), rows, least)

    return run


def _nearest(act: DataFrame, asked: DataFrame, held: int, asking: int, least: float) -> DataFrame:
    """(id, nn, s): of each of ``asked`` the most similar of ``act``, if that is similar enough."""
    groups = -(-held // ROWS)
    shares = max(1, min(-(-TASKS // groups), -(-asking // LINES)))
    rows = act.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("role"), "id", "n", "vec")
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("role"), "id", "n", "vec")
    met = rows.unionByName(asks).repartition(min(4 * TASKS, 2 * groups * shares), "group", "share").sortWithinPartitions("group", "share", "role")
    hits = met.mapInArrow(_compared(least), "id long, s double, tie long, nn long")
    best = hits.groupBy("id").agg(F.max(F.struct("s", "tie", "nn")).alias("m"))
    return best.select("id", F.col("m.nn").alias("nn"), F.col("m.s").alias("s"))


def _to_the_end(least: float, r: int):
    """All rounds from ``r`` on of the clusters of one partition."""

    def run(batches):
        parts = [(b.column("id").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False), _rows_of(b.column("vec").to_pylist())) for b in batches if b.num_rows]
        if not parts:
            return
        ids, n, x = (np.concatenate(c) for c in zip(*parts))
        by = np.argsort(ids)
        ids, n, x, out = ids[by].astype(np.int64), n[by].astype(np.float64), x[by], []

        def against(i):
            total = np.zeros((len(i), len(x)))
            for d in range(x.shape[1]):
                total += x[i, d][:, None] * x[:, d][None, :]
            total /= n[i][:, None] * n[None, :]
            total[np.arange(len(i)), i] = -np.inf
            return total

        s, now, live = against(np.arange(len(ids))), r, np.ones(len(ids), bool)
        while len(ids) > 1:
            top = s.max(axis=1)
            i, j = np.nonzero((s == top[:, None]) & (top >= least)[:, None])
            if not len(i):
                break
            order = np.lexsort((j, _ties(ids[i], ids[j]), i))
            last = order[np.flatnonzero(np.append(i[order][1:] != i[order][:-1], True))]
            nn = np.full(len(ids), -1)
            nn[i[last]] = j[last]
            a = np.flatnonzero((nn >= 0) & (nn[nn] == np.arange(len(ids))) & (nn > np.arange(len(ids))))
            b = nn[a]
            out += zip([now] * len(a), ids[a].tolist(), ids[b].tolist(), (1 - s[a, b]).tolist(), (n[a] + n[b]).astype(np.int64).tolist())
            x[a] += x[b]
            n[a] += n[b]
            live &= top >= least  # none is near enough, nor ever will be
            live[b] = False
            s[:, ~live] = s[~live] = -np.inf
            now += 1
            if live.sum() < 0.7 * len(ids):
                at = (np.cumsum(live) - 1)[a]
                ids, n, x, s = ids[live], n[live], x[live], s[np.ix_(live, live)]
                live = live[live]
            else:
                at = a
            fresh = against(at)
            fresh[:, ~live] = -np.inf
            s[at] = fresh
            s[:, at] = fresh.T
        names = ("round", "a", "b", "distance", "size")
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=list(names))

    return run


def average_merges(rows: DataFrame, most_distance: float = 0.7, max_rounds: int = 5000) -> DataFrame:
    """(round, a, b, distance, size): merges of average linkage up to ``most_distance`` of ``rows`` (id, vec, of ``packed_rows``), each cluster named by its least member.

    The distance of two vectors is one less their cosine, of two clusters the mean of all their pairs. Ties are broken by a
    hash of the pair. Ordered by distance the merges are the dendrogram.
    """
    spark, least = rows.sparkSession, 1.0 - most_distance - 1e-12
    kept, old = Cuts(spark), Cuts(spark)
    act = old.written(rows.select("id", "vec").mapInArrow(_ones, "id long, n long, vec binary").withColumns({"nn": F.lit(None).cast("long"), "s": F.lit(None).cast("double")}), "average-clusters")
    merges: list[DataFrame] = []
    for r in range(1, max_rounds + 1):
        held = act.count()
        if held <= ALONE:
            merges.append(kept.written(act.select("id", "n", "vec").repartition(1).mapInArrow(_to_the_end(least, r), _MERGES), "average-merges"))
            break
        asked, new = act.where("nn is null"), Cuts(spark)
        asking = asked.count()
        found = _nearest(act.select("id", "n", "vec"), asked.select("id", "n", "vec"), held, asking, least)
        best = new.written(act.where("nn is not null").select("id", "nn", "s").unionByName(found), "average-nearest")
        sizes = best.join(act.select("id", "n"), "id").groupBy(F.least("id", "nn").alias("a"), F.greatest("id", "nn").alias("b"))
        both = sizes.agg(F.count("*").alias("k"), F.max("s").alias("s"), F.sum("n").alias("size")).where("k = 2")
        merged = kept.written(both.select(F.lit(r).cast("int").alias("round"), "a", "b", (1.0 - F.col("s")).alias("distance"), "size"), "average-merges")
        merges.append(merged)
        if merged.isEmpty() and asking == held:
            break
        gone = merged.select(F.explode(F.array("a", "b")).alias("id"))
        live = act.select("id", "n", "vec").join(best, "id")  # what has none near enough never will
        # Ties can leave clusters that wait for one another: then all ask anew.
        moved = best.select("id").withColumnRenamed("id", "nn") if merged.isEmpty() else gone.withColumnRenamed("id", "nn")
        rest = live.join(gone, "id", "left_anti").join(moved.withColumn("moved", F.lit(True)), "nn", "left")
        rest = rest.select("id", "n", "vec", F.when(F.col("moved").isNull(), F.col("nn")).alias("nn"), F.when(F.col("moved").isNull(), F.col("s")).alias("s"))
        of = lambda end: live.select(F.col("id").alias(end), F.col("vec").alias(f"v{end}"))
        grown = merged.select("a", "b", "size").join(of("a"), "a").join(of("b"), "b").select(F.col("a").alias("id"), F.col("size").alias("n"), "va", "vb").mapInArrow(_added, "id long, n long, vec binary")
        act = new.written(rest.unionByName(grown, allowMissingColumns=True), "average-clusters")
        old.clear()
        old = new
    else:
        raise RuntimeError(f"clusters were still merging after {max_rounds} rounds")
    out = spark.createDataFrame([], _MERGES)
    for m in merges:
        out = out.unionByName(m)
    out = written(out, "average")
    old.clear()
    kept.clear()
    return out


def vector_forest(index: VectorIndex, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, max_rounds: int = 64) -> DataFrame:
    """(a, b, similarity): a forest of the most similar of all pairs of an index' rows, which is single linkage; ``queries`` are the rows of the index.

    Pairs whose cosine is not positive are left out. ``k`` nearest are looked for at first: that costs or saves asking again, the forest is the same.
    """
    spark, kept, old = index.spark, Cuts(index.spark), Cuts(index.spark)
    found = index.search(queries, k, vec_id=vec_id, vector=vector)
    # What a vector's unlisted ones have at most; none are unlisted if the list is not full.
    last = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("most"))
    nodes = old.written(index.rows().select("id").join(last, "id", "left").select("id", F.col("id").alias("tree"), "most"), "vector-forest-nodes")
    lists = old.written(found.where("score > 0").select(F.col("query_id").alias("x"), F.col("id").alias("y"), F.col("score").alias("similarity"), F.col("query_id").alias("tx"), F.col("id").alias("ty")), "vector-forest-lists")
    chosen: list[DataFrame] = []
    order = _preferred(F.col("similarity"), F.least("x", "y"), F.greatest("x", "y"))
    for _ in range(max_rounds):
        largest = nodes.groupBy("tree").count().orderBy(F.desc("count"), "tree").first()
        if largest is None:
            break
        new, small = Cuts(spark), nodes.where(F.col("tree") != largest["tree"])  # the largest tree need not pick: the others do
        if small.isEmpty():
            break
        ends = lambda df: df.select("similarity", "x", "y", F.explode(F.array(F.struct(F.col("tx").alias("tree"), F.col("ty").alias("to")), F.struct(F.col("ty").alias("tree"), F.col("tx").alias("to")))).alias("e")).select("e.tree", "e.to", "similarity", "x", "y")
        best = ends(lists).groupBy("tree").agg(F.max("similarity").alias("best"))
        listed = lists.select(F.col("x").alias("id")).distinct()
        left = small.join(listed, "id", "left_anti").join(best, "tree", "left").withColumn("least", F.coalesce("best", F.lit(0.0))).where("most > least")
        asked = new.written(left.select("id", F.col("tree").alias("key"), "least"), "vector-forest-asked")
        if not asked.isEmpty():
            got = index.apart(asked, nodes.select("id", F.col("tree").alias("key"))).select(F.col("query_id").alias("x"), F.col("id").alias("y"), F.col("score").alias("similarity"))
            got = new.written(got.where("similarity > 0"), "vector-forest-found")
            own = nodes.select(F.col("id").alias("x"), F.col("tree").alias("tx"))
            lists = lists.unionByName(got.join(own, "x").join(own.toDF("y", "ty"), "y").select("x", "y", "similarity", "tx", "ty"))
            knows = asked.select("id", "least").join(got.select(F.col("x").alias("id"), "similarity"), "id", "left").select("id", F.coalesce("similarity", "least").alias("less"))
            nodes = nodes.join(knows, "id", "left").select("id", "tree", F.coalesce("less", "most").alias("most"))
        pick = ends(lists).where(F.col("tree") != largest["tree"]).groupBy("tree").agg(F.max_by(F.struct("to", "similarity", "x", "y"), order).alias("e"))
        pick = kept.written(pick.select("tree", "e.*"), "vector-forest-chosen")
        if pick.isEmpty():
            new.clear()
            break
        chosen.append(pick)
        of = new.written(components(pick.select(F.col("tree").alias("src"), F.col("to").alias("dst"))), "vector-forest-trees")
        to = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        nodes = new.written(nodes.join(to("tree"), "tree", "left").select("id", F.coalesce("ctree", "tree").alias("tree"), "most"), "vector-forest-nodes")
        moved = lists.join(to("tx"), "tx", "left").join(to("ty"), "ty", "left").select("x", "y", "similarity", F.coalesce("ctx", "tx").alias("tx"), F.coalesce("cty", "ty").alias("ty"))
        lists = new.written(moved.where("tx != ty"), "vector-forest-lists")
        old.clear()
        old = new
    else:
        raise RuntimeError(f"the forest was still growing after {max_rounds} rounds")
    out = spark.createDataFrame([], "a long, b long, similarity double")
    for c in chosen:
        out = out.unionByName(c.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"))
    out = written(out.distinct(), "vector-forest")
    old.clear()
    kept.clear()
    return out
