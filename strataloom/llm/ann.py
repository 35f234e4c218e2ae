"""Approximate nearest neighbours: lists around trained centroids, scanned dimension block by dimension block.

Vectors are rotated at random, which spreads each one's length evenly over its components, and kept in blocks of columns.
Every vector belongs to the list of its nearest centroid; a query probes the lists whose centroids have the largest inner
product with it. In a list, the first components of all candidates give a partial distance; by it a hypothesis test decides
whether a candidate can still reach the k-th best score so far, and those that can't are abandoned. What is left goes on to
the next block of columns, so most candidates are read in part only, and scores of those that stay to the end are worked out
on the original vectors. The query's own list is scanned first; its k-th best score is what candidates of the other lists
are tested against from their first columns on.

The inner product asks for a distance that depends on the candidate: a score of at least t is a squared distance of at most
|q|^2 + |x|^2 - 2t.

Centroids, and how many lists to probe, come from a bounded sample; every row is indexed. Lists are cut into blocks by
their size and by the number of their queries, so a list that holds a third of all rows is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cuts
from .embedding_dedup import usable

K, QUERY_EVERY = 20, 20
SAMPLE = 32_768  # rows at most from which centroids and probes are fitted: those with the least hashes of their ids
LISTS = 2048  # at most
ASKED = 512  # rows of the sample that are queries when the number of probes is fitted
COVER = 0.98  # share of their true neighbours in the sample that the probed lists must hold
COLUMNS = 16  # of a block
EPSILON = 2.1  # of the test: a partial distance is too large by more than this many times its spread
ROWS = 2048  # candidates of a block of a list
QUERIES = 4096  # queries of a list that go to one task
CHUNK = 256  # queries scanned together
SEED = 13


class Model:
    """Rotation, centroids and the number of lists to probe for vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int, k: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        self.rotation = rotation(self.dim, seed)
        lists = max(1, min(lists, len(x)))
        c = x[np.sort(rng.choice(len(x), lists, replace=False))].copy()
        for _ in range(8):
            of = self._near(x, c)
            total = np.zeros_like(c)
            np.add.at(total, of, x)
            size = np.bincount(of, minlength=lists)
            c[size > 0] = total[size > 0] / size[size > 0, None]
        self.centroids = c
        self.probes = self._fit_probes(x, k)

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        half = (c * c).sum(axis=1) / 2
        return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)

    def list_of(self, x: np.ndarray) -> np.ndarray:
        return self._near(x, self.centroids)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query, the most promising first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")

    def _fit_probes(self, x: np.ndarray, k: int) -> int:
        asked = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
        score = x[asked] @ x.T
        score[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return 1
        true = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = self.order(x[asked])
        rank = np.argsort(order, axis=1)
        need = np.sort(np.take_along_axis(rank, self.list_of(x)[true], axis=1).ravel())
        return int(need[int(np.ceil(COVER * len(need))) - 1]) + 1


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and x in double precision, added from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


class Candidates:
    """A block of candidates in blocks of rotated columns, and what is left of each one's squared length after them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray):
        self.ids, self.x, self.turned = ids, x, x @ turn
        self.dim = x.shape[1]
        self.edges = [*range(0, self.dim, COLUMNS), self.dim]
        self.norm = (x * x).sum(axis=1)
        self.read = self.scored = 0  # components of candidates read in scans; scores worked out

    def scan(self, own: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, turn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the best k of each query that reach its floor, its own id left out."""
        turned, norm = q @ turn, (q * q).sum(axis=1)
        t = floor.copy()
        seeds = min(len(self.ids), 4 * k)
        held = self._add([(np.zeros(0, np.int64), np.zeros(0))] * len(q), own, q, *(v.ravel() for v in np.indices((len(q), seeds))), t, k)
        for at in range(seeds, len(self.ids), 512):
            rows = slice(at, min(at + 512, len(self.ids)))
            i, j = self._left(turned, norm, rows, t)
            held = self._add(held, own, q, i, j + at, t, k)
        return held

    def _left(self, q: np.ndarray, norm: np.ndarray, rows: slice, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that no test has ruled out."""
        x, xn = self.turned[rows], self.norm[rows]
        radius = np.maximum(norm[:, None] + xn[None, :] - 2 * t[:, None], 0)  # infinite where there is no threshold yet
        part, open_, i = np.zeros(radius.shape), np.ones(radius.shape, dtype=bool), None
        for a, b in zip(self.edges, self.edges[1:]):
            qd, xd = q[:, a:b], x[:, a:b]
            if i is None:  # many are still in: one product for all
                part += (qd * qd).sum(axis=1)[:, None] + (xd * xd).sum(axis=1)[None, :] - 2 * (qd @ xd.T)
                self.read += part.size * (b - a)
            else:
                part += ((qd[i] - xd[j]) ** 2).sum(axis=1)
                self.read += len(i) * (b - a)
            # Reject: the whole distance, judged by the part, is beyond the radius. At the end nothing is left to judge.
            wide = (1 + EPSILON / np.sqrt(b)) ** 2 * (b / self.dim) if b < self.dim else 1 + 1e-9
            near = part <= wide * radius + 1e-12
            if i is None:
                open_ &= near
                if np.count_nonzero(open_) < open_.size // 8 or b == self.dim:
                    i, j = np.nonzero(open_)
                    part, radius = part[i, j], radius[i, j]
            else:
                i, j, part, radius = i[near], j[near], part[near], radius[near]
        return i, j

    def _add(self, held, own, q, i, j, t, k):
        score = exact_scores(q[i], self.x[j])
        self.scored += len(i)
        good = (score >= t[i]) & (self.ids[j] != own[i])
        i, j, score = i[good], j[good], score[good]
        ends = np.searchsorted(i, np.arange(len(q) + 1))
        out = []
        for a, (ids, was) in enumerate(held):
            s = slice(ends[a], ends[a + 1])
            if s.start < s.stop:
                ids, was = np.concatenate([ids, self.ids[j[s]]]), np.concatenate([was, score[s]])
                best = np.lexsort((ids, -was))[:k]
                ids, was = ids[best], was[best]
                if len(ids) == k:
                    t[a] = max(t[a], was[-1])
            out.append((ids, was))
        return out


def _scan(k: int):
    """Of each group the candidates first, then its queries as a stream."""
    names = ("dim", "list", "block", "part", "role", "id", "vec", "floor")

    def found(block, rows, turn):
        own, q = np.asarray([r[0] for r in rows], np.int64), np.frombuffer(b"".join(r[1] for r in rows), "<f8").reshape(len(rows), -1)
        floor = np.asarray([-np.inf if r[2] is None else r[2] for r in rows])
        got = block.scan(own, q, floor, k, turn)
        ids, scores = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, [len(g[0]) for g in got])), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    def run(batches):
        group, seen, block, asked, turns = None, [], None, [], {}
        for batch in batches:
            for *key, role, i, vec, floor in zip(*(batch.column(c).to_pylist() for c in names)):
                if key != group:
                    if asked:
                        yield found(block, asked, turns[group[0]])
                    group, seen, block, asked = key, [], None, []
                if role == 0:
                    seen.append((i, vec))
                    continue
                if block is None:
                    if not seen:
                        continue
                    dim = key[0]
                    if dim not in turns:
                        turns[dim] = rotation(dim)
                    block = Candidates(np.asarray([s[0] for s in seen], np.int64), np.frombuffer(b"".join(s[1] for s in seen), "<f8").reshape(-1, dim), turns[dim])
                    seen = []
                asked.append((i, vec, floor))
                if len(asked) == CHUNK:
                    yield found(block, asked, turns[dim])
                    asked = []
        if asked:
            yield found(block, asked, turns[group[0]])

    return run


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), dim)


def _indexed(models: dict[int, Model]):
    """Rows with their list; vectors of a length without a model are one list."""

    def run(batches):
        for batch in batches:
            dims, blobs = np.asarray(batch.column(1).to_pylist(), np.int64), batch.column(2).to_pylist()
            lists = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in models:
                    lists[at] = models[dim].list_of(_matrix([blobs[i] for i in at], dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lists)], names=["vec_id", "dim", "vec", "list"])

    return run


def _probed(models: dict[int, Model], sizes: dict[tuple[int, int], int], k: int):
    """A row for each list a query probes: as many as the model says, and more while they hold too few candidates."""

    def run(batches):
        for batch in batches:
            ids, dims, blobs = (batch.column(i).to_pylist() for i in range(3))
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                order = models[dim].order(_matrix([blobs[i] for i in at], dim)) if dim in models else np.zeros((len(at), 1), np.int64)
                held = np.cumsum(np.asarray([sizes.get((dim, c), 0) for c in range(order.shape[1])])[order], axis=1)
                want = np.maximum(models[dim].probes if dim in models else 1, (held < k + 1).sum(axis=1) + 1)
                out = [(ids[i], dim, blobs[i], int(c), p) for i, o, w in zip(at, order, want) for p, c in enumerate(o[:w])]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.int32()), pa.array([o[4] for o in out], pa.int32())], names=["vec_id", "dim", "vec", "list", "place"])

    return run


def _pack(batches):
    for batch in batches:
        vecs = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in vecs], pa.int32()), pa.array([np.asarray(v, dtype="<f8").tobytes() for v in vecs], pa.binary())], names=["vec_id", "dim", "vec"])


class Index:
    """All usable rows of ``vectors`` (vec_id, embedding), each in the list of its nearest centroid."""

    def __init__(self, vectors: DataFrame, k: int = K, sample: int = SAMPLE):
        self.spark, self.cuts, self.k = vectors.sparkSession, Cuts(vectors.sparkSession), k
        base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable("e"))
        rows = self.cuts.written(base.mapInArrow(_pack, "vec_id long, dim int, vec binary").distinct(), "ann-rows")
        drawn = rows.orderBy(F.xxhash64("vec_id", "vec")).limit(sample).collect()
        self.models = {}
        n = rows.count()
        for dim in sorted({r["dim"] for r in drawn}):
            x = _matrix([r["vec"] for r in drawn if r["dim"] == dim], dim)
            self.models[dim] = Model(x, min(LISTS, round(np.sqrt(n * len(x) / len(drawn)))), k)
        self.rows = self.cuts.written(rows.mapInArrow(_indexed(self.models), "vec_id long, dim int, vec binary, list int"), "ann-index")
        # One figure a list: their number is bounded by LISTS for each length of vectors.
        self.sizes = {(r["dim"], r["list"]): r["count"] for r in self.rows.groupBy("dim", "list").count().collect()}

    def _hits(self, asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of ``asked`` (vec_id, dim, vec, list, floor) in the lists they name."""
        queries = {(r["dim"], r["list"]): r["count"] for r in asked.groupBy("dim", "list").count().collect()}
        plan = [(d, c, -(-n // ROWS), -(-queries[d, c] // QUERIES)) for (d, c), n in self.sizes.items() if (d, c) in queries]
        plan = F.broadcast(self.spark.createDataFrame(plan, "dim int, list int, blocks int, parts int"))
        cut = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        there = self.rows.join(plan, ["dim", "list"]).withColumn("block", cut("blocks")).withColumn("part", each("parts")).withColumn("role", F.lit(0)).withColumn("floor", F.lit(None).cast("double"))
        here = asked.join(plan, ["dim", "list"]).withColumn("part", cut("parts")).withColumn("block", each("blocks")).withColumn("role", F.lit(1))
        key = ["dim", "list", "block", "part"]
        cols = [*key, "role", F.col("vec_id").alias("id"), "vec", "floor"]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = there.select(*cols).unionByName(here.select(*cols)).repartition(parts, *key).sortWithinPartitions(*key, "role")
        return dealt.mapInArrow(_scan(self.k), "query_id long, vec_id long, score double")

    def _best(self, hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest found of each of ``queries`` (vec_id, dim, vec), never its own id."""
        probes = self.cuts.written(queries.select("vec_id", "dim", "vec").mapInArrow(_probed(self.models, self.sizes, self.k), "vec_id long, dim int, vec binary, list int, place int"), "ann-probes")
        own = self.cuts.written(self._best(self._hits(probes.where("place = 0").withColumn("floor", F.lit(None).cast("double")))), "ann-own")
        floors = own.where(F.col("rank") == self.k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        rest = self._hits(probes.where("place > 0").join(floors, "vec_id", "left"))
        got = self._best(own.select("query_id", "vec_id", "score").unionByName(rest))
        return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product of every row whose vec_id is divisible by ``every``.

    Scores are exact, ties go to the smaller vec_id; neighbours may be missed, at least 0.9 are found on average. Vectors
    that are null, empty, zero or hold null or non-finite components, and null ids, take no part; only vectors of equal
    length meet. Rows that repeat a vec_id are one vector if equal, else candidates of their own, and the query is the one
    whose packed bytes are least; a query never finds its own id. Fewer candidates than k are all found. Other columns are not looked at. No
    rows, no result.
    """
    index = Index(vectors, k)
    asked = index.rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "dim")).alias("v"))
    return index.search(asked.select("vec_id", "v.dim", "v.vec"))
