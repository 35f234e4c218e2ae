"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Candidates are packed into blocks; a block has, for every dimension, its candidates sorted by that component. For a query
the lists are read in step from their better ends, a run of entries at a time, and never by candidate. What has been
read gives each candidate seen a lower bound (components not read at the list's worst end) and an upper bound (at the value
up to which the list is read), and all candidates not seen one upper bound. Candidates whose upper bound is below the k-th
best lower bound, or below the k-th best score of the blocks before, are out; when none is left beyond what is wanted, or
reading has stopped to narrow the field, the scores of those that are left, and of no others, are resolved.

Blocks of queries meet all blocks of candidates by key, in groups of a query block and a share of the candidates; in a group the
best scores so far go from block to block, and at most k rows a query come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import usable_numbers

QUERY_EVERY = 50
SCALE = 256
CANDIDATES = 4096  # in a block
QUERIES = 1024  # in a block
FIRST_READ = 64  # the lists are first read to one in so many entries
GROWTH = 4  # and then to so many times that
WORTH = 0.5  # reading goes on while it leaves at most this share of what was left before


def _pack(most: int):
    """Rows (id, vector) to blocks of at most ``most`` vectors of one length."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = held.setdefault(len(v), [])
                h.append((i, v))
                if len(h) == most:
                    yield block(held.pop(len(v)))
        for h in list(held.values()):
            yield block(h)

    def block(rows):
        ids, x = np.asarray([r[0] for r in rows], "<i8"), np.asarray([r[1] for r in rows], "<i8")
        return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype("<i4").tobytes() if np.abs(x).max(initial=0) < 2**31 else x.tobytes()], pa.binary())], names=["dim", "ids", "mat"])

    return run


def _unpack(ids: bytes, mat: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    kind = "<i4" if len(mat) == 4 * dim * len(i) else "<i8"
    return i, np.frombuffer(mat, kind).reshape(len(i), dim).astype(np.int64)


class SortedLists:
    """A block's sorted lists, best value first; a negative weight reads its list from the other end."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(-x, axis=0, kind="stable")
        self.value = np.take_along_axis(x, self.order, axis=0)
        self.reads = self.resolved = 0

    def read(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seen, lower, upper) of every candidate after ``depth`` sequential reads of each list with a weight."""
        n = len(self.x)
        d = np.flatnonzero(q)
        flip = q[d] < 0
        ends = np.where(flip[None, :], n - 1 - np.arange(depth)[:, None], np.arange(depth)[:, None])
        who, value = self.order[ends, d[None, :]].ravel(), (self.value[ends, d[None, :]] * q[d]).ravel()
        worst = np.where(flip, self.value[0, d], self.value[-1, d]) * q[d]
        ahead = value.reshape(depth, -1)[-1]
        times = np.bincount(who, minlength=n)
        gained = np.zeros(n, dtype=value.dtype)
        low, high = np.zeros(n, dtype=value.dtype), np.zeros(n, dtype=value.dtype)
        np.add.at(gained, who, value)
        np.add.at(low, who, np.tile(worst, depth))
        np.add.at(high, who, np.tile(ahead, depth))
        self.reads += len(who)
        return times > 0, gained + worst.sum() - low, gained + ahead.sum() - high

    def open(self, q: np.ndarray, own: int, k: int, floor) -> np.ndarray:
        """Candidates that may be among the best k of ``q`` (never its own), if scores below ``floor`` do not count."""
        n = len(self.x)
        alive, depth = np.flatnonzero(self.ids != own), n // FIRST_READ
        while depth and depth < n and len(alive) > k:
            seen, low, high = self.read(q, depth)
            best = low[alive[seen[alive]]]
            kth = np.partition(best, len(best) - k)[len(best) - k] if len(best) >= k else None
            least = max((v for v in (kth, floor) if v is not None), default=None)
            if least is None:
                break
            left = alive[high[alive] >= least]  # the bound of those not seen is the same for all of them
            worth = len(left) <= WORTH * len(alive)
            alive = left
            if not worth:
                break
            depth *= GROWTH
        return alive

    def top(self, q: np.ndarray, own: np.ndarray, k: int, floors: list | None = None) -> list[tuple[int, int, int]]:
        """(query, id, score) of the best k candidates but its own of every query, ties to the smaller id."""
        out, whole = [], []
        left = {}
        for j, query in enumerate(own.tolist()):
            left[j] = self.open(q[j], query, k, floors[j] if floors else None)
            if len(left[j]) >= len(self.x) - 1:
                whole.append(j)
        resolved = dict(zip(whole, q[whole] @ self.x.T)) if whole else {}  # nothing was ruled out: one product for these queries
        for j, query in enumerate(own.tolist()):
            at = left[j]
            got = resolved[j][at] if j in resolved else self.x[at] @ q[j]
            self.resolved += len(at)
            if len(at) > k:
                near = got >= np.partition(got, len(got) - k)[len(got) - k]
                at, got = at[near], got[near]
            out += [(query, int(self.ids[at[b]]), int(got[b])) for b in np.lexsort((self.ids[at], -got))[:k]]
        return out


def _search(k: int):
    """Of each group the queries first, then its blocks of candidates one by one; the best k of every query at its end."""

    def ended(best):
        rows = [(q, i, s) for (_, q), hits in best.items() for s, i in hits]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    def run(batches):
        group, asked, best = None, {}, {}
        for batch in batches:
            for g, part, role, dim, ids, mat in zip(*(batch.column(c).to_pylist() for c in ("g", "part", "role", "dim", "ids", "mat"))):
                if (g, part) != group:
                    if best:
                        yield ended(best)
                    group, asked, best = (g, part), {}, {}
                ids, x = _unpack(ids, mat, dim)
                if role == 0:
                    asked.setdefault(dim, []).append((ids, x))
                    continue
                lists, doubles = None, None
                for own, q in asked.get(dim, []):
                    exact = dim * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**50  # doubles hold every sum
                    if lists is None or doubles != exact:
                        lists, doubles = SortedLists(ids, x.astype(np.float64 if exact else np.int64)), exact
                    floors = [h[-1][0] if len(h := best.get((dim, i), ())) == k else None for i in own.tolist()]
                    for i, c, s in lists.top(q.astype(lists.x.dtype), own, k, floors):
                        best.setdefault((dim, i), []).append((s, c))
                for key in [key for key, h in best.items() if len(h) > k]:
                    best[key] = sorted(best[key], key=lambda h: (-h[0], h[1]))[:k]
        if best:
            yield ended(best)

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row whose vec_id is divisible by ``every``.

    Components count as floor(256 * x) of the double; the score is the integer inner product, ties go to the smaller
    vec_id. Vectors that are null, empty or hold null or non-finite components, and null ids, take no part; only vectors of
    equal length meet. Rows that repeat a vec_id are one vector if equal, else candidates of their own, each with its rank
    (and the query is the least of them); a query never finds its own id. Components of which a score could exceed 63 bits are
    outside what is defined. Other columns are not looked at. No rows, no result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable_numbers("e"))
    base = base.select("vec_id", F.transform("e", lambda x: F.floor(x * SCALE).cast("long")).alias("v")).distinct()
    asked = base.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(1, -(-asked.count() // QUERIES))  # blocks of queries
    shares = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    blocks = "dim int, ids binary, mat binary"
    q = asked.repartition(groups, "vec_id").mapInArrow(_pack(QUERIES), blocks).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("role", F.lit(0))
    c = base.mapInArrow(_pack(CANDIDATES), blocks).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    c = c.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).withColumn("role", F.lit(1))
    met = q.unionByName(c).repartition(groups * shares, "g", "part").sortWithinPartitions("g", "part", "role")
    hits = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
