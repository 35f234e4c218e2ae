"""A kept vector index: an inverted file over trained centroids, in Parquet, with exact search.

Every row lies in the cell of its nearest centroid. A version of the index is one small file that names each cell's
centroid, radius, size and folders; it is written last, so a reader sees a whole version or the one before, and a batch that
is tried again is applied once. Batches only add folders. Cells past a size are cut by centroids of their own, and rows are
removed by writing the cells that hold them anew.

Search is by cosine. On unit vectors that is a distance, and no row of a cell is nearer to a query than the cell's centroid
less its radius. A query first reads its nearest cells, which gives a k-th score; then the cells whose bound allows for
that score, so the result is exact. Cells are compared in groups of bounded size, each with its queries in chunks: a task
holds one group and the scores of one chunk, however many queries there are, and a query travels once to a group.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.measures import usable_vector
from strataloom.sources.tables import Cuts, written

SAMPLE = 20_000  # rows at most from which centroids are trained: those with the least hashes
CELLS = 4096  # at most when an index is built
FIRST = 2  # cells that a query reads before it has a bound
GROUP, GROUP_BYTES = 32_768, 2**25  # rows, and bytes of their vectors, that one task compares
TASKS = 64  # that a search is cut into at least: by groups of cells, and shares of the queries
CHUNK = 256  # queries compared with a group at once
SLICE = 65_536  # pairs of which the exact cosine is taken at once
SLACK = 1e-9  # of a score, for rounding
NEAR = 1e-7  # of a distance, for rounding: the root of what a score loses
_MANIFEST = "cell int, centroid array<double>, radius double, n long, folders array<string>, batches array<string>, version int"


def _rows_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1) if blobs else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance, a slice of rows at a time."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), CHUNK):
        d = _distances(x[i : i + CHUNK], c)
        near[i : i + CHUNK] = d.argmin(axis=1)
        far[i : i + CHUNK] = d.min(axis=1)
    return near, far


def train(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centroids of unit vectors ``x``: k-means from rows of a seeded draw."""
    cells = max(1, min(cells, len(x)))
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), cells, replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, c)[0]
        total, size = np.zeros_like(c), np.bincount(near, minlength=cells)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _packed(batches):
    for batch in batches:
        blobs = [np.asarray(v, "<f8").tobytes() for v in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *batch.columns[1:]], names=batch.schema.names)


def _assigned(names: np.ndarray, centroids: np.ndarray):
    """Rows (packed vector first) with their cell and the distance to its centroid."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near, far = _nearest(_unit(_rows_of(batch.column(0).to_pylist())), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[near], pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _parting(batches):
    """(cell, parts, vec), cell by cell, to the packed centroids that cut each cell in so many parts."""

    def cut(cell, parts, blobs):
        c = train(_unit(_rows_of(blobs)), parts)
        return pa.RecordBatch.from_arrays([pa.array([cell] * len(c), pa.int32()), pa.array([v.tobytes() for v in c], pa.binary())], names=["cell", "centroid"])

    now, blobs = None, []
    for batch in batches:
        for cell, parts, vec in zip(*(batch.column(c).to_pylist() for c in ("cell", "parts", "vec"))):
            if now and cell != now[0]:
                yield cut(*now, blobs)
                blobs = []
            now = (cell, parts)
            blobs.append(vec)
    if now:
        yield cut(*now, blobs)


def _reach(d: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """How far the first cells of each query reach: those that hold ``k`` other rows, and one more."""
    some = min(64, d.shape[1])
    near = np.argpartition(d, some - 1, axis=1)[:, :some] if some < d.shape[1] else np.tile(np.arange(some), (len(d), 1))
    out = np.full(len(d), np.inf)
    for which, order in ((np.arange(len(d)), near), (None, None)):
        if which is None:  # the nearest 64 cells hold too few
            which = np.flatnonzero(np.isinf(out))
            if not len(which) or some == d.shape[1]:
                break
            order = np.tile(np.arange(d.shape[1]), (len(which), 1))
        here = np.take_along_axis(d[which], order, axis=1)
        by = np.argsort(here, axis=1, kind="stable")
        here, held = np.take_along_axis(here, by, axis=1), np.cumsum(sizes[np.take_along_axis(order, by, axis=1)], axis=1)
        last = np.maximum(FIRST, (held < k + 1).sum(axis=1) + 1) - 1
        ok = last < here.shape[1]
        out[which[ok]] = here[np.flatnonzero(ok), last[ok]]
    return out


def _wanted(names, centroids, radius, sizes, k: int):
    """(id, vec, cell) to read: the first ones while there is no ``bound``, else the others that may hold something nearer."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                d = _distances(_unit(_rows_of(piece.column("vec").to_pylist())), centroids)
                reach = _reach(d, sizes, k)[:, None]
                if "bound" in piece.schema.names:
                    bound = np.asarray([np.inf if b is None else b for b in piece.column("bound").to_pylist()])
                    take = (d > reach) & (d - radius[None, :] <= bound[:, None] + NEAR)
                else:
                    take = d <= reach
                i, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(i)), piece.column("vec").take(pa.array(i)), pa.array(names[j], pa.int32())], names=["id", "vec", "cell"])

    return run


def _within(least: np.ndarray) -> np.ndarray:
    """The distance of unit vectors at a score."""
    return np.sqrt(np.maximum(2 - 2 * np.maximum(least, -1.0), 0))


def _asking(names, centroids, radius, sizes, first, parts, shares: int, k: int | None):
    """Queries (id, vec, key, least) once for each group of cells that they read; without ``least`` the first cells only.

    ``first`` and ``parts`` are the groups of each cell. ``reach`` is how far its first cells are, and null once it has a score.
    """
    total = int((first + parts).max())
    ends = [np.flatnonzero((first <= g) & (g < first + parts)) for g in range(total)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                d = _distances(_unit(_rows_of(piece.column("vec").to_pylist())), centroids)
                near = d.argmin(axis=1)
                if "least" in piece.schema.names:
                    least = np.asarray([-np.inf if s is None else s for s in piece.column("least").to_pylist()])
                    take, reach = d - radius[None, :] <= _within(least)[:, None] + NEAR, np.full(len(d), np.nan)
                else:
                    least, reach = np.full(len(d), -np.inf), _reach(d, sizes, k)
                    take = d <= reach[:, None]
                i, g = np.nonzero(np.stack([take[:, cells].any(axis=1) for cells in ends], axis=1))
                ids = np.asarray(piece.column("id").to_pylist(), np.int64)
                share = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shares)
                by = pa.array(i)
                made = [pa.array(g, pa.int32()), pa.array(share[i].astype(np.int32)), pa.array(np.ones(len(i), np.int32)), piece.column("key").take(by), pa.array(names[near[i]], pa.int32()), piece.column("id").take(by), piece.column("vec").take(by), pa.array(least[i]), pa.array(reach[i])]
                yield pa.RecordBatch.from_arrays(made, names=_MET)

    return run


_MET = ["group", "share", "role", "key", "cell", "id", "vec", "least", "reach"]
_MET_SCHEMA = "group int, share int, role int, key long, cell int, id long, vec binary, least double, reach double"


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, each sum from the first component to the last."""
    both, qq, xx = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for d in range(q.shape[1]):
        both += q[:, d] * x[:, d]
        qq += q[:, d] * q[:, d]
        xx += x[:, d] * x[:, d]
    return both / np.sqrt(qq * xx)


def _once(ids: np.ndarray, blobs: list[bytes], k: int) -> np.ndarray:
    """Rows that can be among the ``k`` nearest: of equal vectors the ``k + 1`` smallest ids, as one may be the query's own."""
    seen, out = {}, []
    for i in np.argsort(ids, kind="stable").tolist():
        n = seen[blobs[i]] = seen.get(blobs[i], 0) + 1
        if n <= k + 1:
            out.append(i)
    return np.sort(np.asarray(out, np.int64))


def _compared(names, centroids, radius, k: int | None, keyed: bool = False, later: bool = False, apart: bool = False):
    """Of each (group, share) the rows first, then its queries in chunks; the best k of each query, or all from its least score on.

    ``keyed``: only rows of the query's key; ``later``: only rows of a larger id; ``apart``: only rows of another key.
    """

    def columns(batch):
        number = lambda c, dtype: batch.column(c).to_numpy(zero_copy_only=False).astype(dtype)
        return {"key": number("key", np.int64), "cell": np.searchsorted(names, number("cell", np.int64)), "id": number("id", np.int64), "vec": batch.column("vec").to_pylist(), "least": number("least", np.float64), "reach": number("reach", np.float64)}

    def gathered(pieces):
        rows = {c: np.concatenate([p[c] for p in pieces]) for c in ("key", "cell", "id")}
        blobs = [v for p in pieces for v in p["vec"]]
        if k and not apart:
            some = _once(rows["id"], blobs, k)
            rows, blobs = {c: v[some] for c, v in rows.items()}, [blobs[i] for i in some.tolist()]
        rows["x"] = _rows_of(blobs)
        rows["u"] = _unit(rows["x"])
        rows["cells"], rows["cell"] = np.unique(rows["cell"], return_inverse=True)
        return rows

    def hits(rows, asks, a):
        part = {c: asks[c][a : a + CHUNK] for c in ("key", "id", "least", "reach")}
        q = _rows_of(asks["vec"][a : a + CHUNK])
        u, d = _unit(q), None
        d = _distances(u, centroids[rows["cells"]])
        first = ~np.isnan(part["reach"])[:, None]
        take = np.where(first, d <= part["reach"][:, None] + NEAR, d - radius[rows["cells"]][None, :] <= _within(part["least"])[:, None] + NEAR)
        some = take.any(axis=0)[rows["cell"]]
        if keyed:
            some &= (rows["key"] >= part["key"].min()) & (rows["key"] <= part["key"].max())
        at = np.flatnonzero(some)
        if not len(at):
            return
        s = u @ (rows["u"] if len(at) == len(some) else rows["u"][at]).T
        ids = rows["id"][at]
        s[ids[None, :] <= part["id"][:, None] if later else ids[None, :] == part["id"][:, None]] = -3
        if keyed:
            s[rows["key"][at][None, :] != part["key"][:, None]] = -3
        least = part["least"].copy()
        if apart:
            s[rows["key"][at][None, :] == part["key"][:, None]] = -3
            least = np.maximum(least, s.max(axis=1))  # one is asked for, however low its least score
        free = np.flatnonzero(np.isinf(least))
        if k and len(free) and len(at) > k:
            least[free] = np.partition(s[free], len(at) - k, axis=1)[:, len(at) - k]
        i, j = np.nonzero((s >= least[:, None] - SLACK) & (s > -2))
        del s
        score = np.concatenate([_cosines(q[i[b : b + SLICE]], rows["x"][at[j[b : b + SLICE]]]) for b in range(0, len(i), SLICE)]) if len(i) else np.zeros(0)
        found = ids[j]
        if k:
            order = np.lexsort((found, -score, i))
            start = np.searchsorted(i[order], i[order])
            keep = order[np.arange(len(order)) - start < k]
        else:
            keep = np.flatnonzero(score >= part["least"][i])
        yield pa.RecordBatch.from_arrays([pa.array(part["id"][i[keep]]), pa.array(found[keep]), pa.array(score[keep])], names=["query_id", "id", "score"])

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
                        rows, pieces = gathered(pieces), []
                    for c in range(0, b - a, CHUNK):
                        yield from hits(rows, here, c)

    return run


def _groups(cells: list[tuple[int, int]], most: int) -> dict[int, tuple[int, int]]:
    """The first group of each (cell, size), and how many it has: groups of about ``most`` rows, of neighbouring cells or parts of one."""
    out, group, held = {}, 0, 0
    for cell, n in cells:
        if held and held + n > most:
            group, held = group + 1, 0
        out[cell] = (group, max(1, -(-n // most)))
        held += n
        if held > most:
            group, held = group + out[cell][1], 0
    return out


def packed_rows(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec, id, other columns): vectors that can be compared as packed doubles, one for an id."""
    other = [F.col(f"`{c}`") for c in rows.columns if c not in (vec_id, vector, "id", "vec", "cell", "far", "in_folder")]
    df = rows.where(F.col(vec_id).isNotNull() & usable_vector(F.col(vector))).select(F.col(vector).cast("array<double>").alias("vec"), F.col(vec_id).cast("long").alias("id"), *other)
    schema = T.StructType([T.StructField("vec", T.BinaryType()), *df.schema.fields[1:]])
    once = Window.partitionBy("id").orderBy("vec")
    return df.mapInArrow(_packed, schema).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def _stored(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])


_LINE = Row("cell", "centroid", "radius", "n", "folders", "batches", "version")


class VectorIndex:
    """An index at ``path`` over rows (id long, vector, and any columns to filter by).

    Vectors that are null, empty, zero or hold null or non-finite components are left out, as are null ids; an id that is
    there already is not added again, and of rows that repeat one in a batch the first by vector stays. All vectors have one
    length. Columns named id, vec, cell, far or in_folder are not kept. An index without rows finds nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._held = self._fields = None

    # --- versions

    def manifest(self) -> list:
        """The newest whole version: a row for each cell (their number is bounded), and one (cell -1) with the batches."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        newest = rows.agg(F.max("version")).first()[0]
        if self._held is None or self._held[0] != newest:
            self._held = newest, rows.where(F.col("version") == newest).orderBy("cell").collect()
        return self._held[1]

    def _commit(self, cells: dict[int, tuple], batches: list[str], version: int) -> VectorIndex:
        rows = [(-1, None, None, sum(c[2] for c in cells.values()), None, batches)] + [(n, *c, None) for n, c in sorted(cells.items())]
        df = self.spark.createDataFrame([(*r, version) for r in rows], _MANIFEST)
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._held = version, [_LINE(*r, version) for r in rows]
        return self

    def _state(self):
        rows = self.manifest()
        return {r["cell"]: (r["centroid"], r["radius"], r["n"], r["folders"]) for r in rows[1:]}, list(rows[0]["batches"]), rows[0]["version"]

    def _read(self, cells: dict[int, tuple], only=None) -> DataFrame:
        """Rows of cells, from their own folders only."""
        own = [(f, n) for n, c in cells.items() if only is None or n in only for f in c[3]]
        if not own:
            return self.spark.createDataFrame([], self.schema())
        stored = T.StructType([*self.schema().fields, T.StructField("in_folder", T.StringType())])
        rows = self.spark.read.schema(stored).parquet(*(f"{self.path}/rows/{f}" for f in sorted({f for f, _ in own})))
        return rows.join(F.broadcast(self.spark.createDataFrame(own, "in_folder string, cell int")), ["in_folder", "cell"]).select(*self.schema().names)

    def schema(self) -> T.StructType:
        if self._fields is None:
            self._fields = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))
        return self._fields

    def rows(self) -> DataFrame:
        """All rows: vec (packed doubles), id, the other columns, cell, and far (distance to the centroid)."""
        return self._read(self._state()[0])

    # --- writing

    @classmethod
    def build(cls, rows: DataFrame, path: str, vec_id: str = "vec_id", vector: str = "embedding", cells: int | None = None, batch: str = "first") -> VectorIndex:
        """A new index with ``rows`` as its first batch; the square root of their number as cells, if not told."""
        self = cls(rows.sparkSession, path)
        good = self._packed(rows, vec_id, vector)
        self.spark.createDataFrame([(_stored(good).json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        return self._commit(self._trained(good, cells), [batch], 1)

    def _trained(self, good: DataFrame, cells: int | None = None) -> dict[int, tuple]:
        """Cells of the first rows there are; none without rows."""
        n = good.count()
        if not n:
            return {}
        centroids = train(_unit(_rows_of(self._drawn(good, n))), cells or min(CELLS, round(n**0.5)))
        got = self._store(good, np.arange(len(centroids), dtype=np.int32), centroids)
        return {i: (c.tolist(), *got.get(i, (0.0, 0, []))) for i, c in enumerate(centroids)}

    def _drawn(self, good: DataFrame, n: int) -> list[bytes]:
        """Vectors of the SAMPLE of ``n`` rows with the least hashes.

        Each task sends the driver as many as it has, so only hashes below a bound that holds a little more are ordered.
        """
        share = 1.25 * SAMPLE / n
        while True:
            some = good.where(F.xxhash64("id") <= int(-(2**63) + share * 2**64)) if share < 1 else good
            drawn = some.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").collect()
            if share >= 1 or len(drawn) == SAMPLE:
                return [r["vec"] for r in drawn]
            share *= 2

    def _packed(self, rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
        return packed_rows(rows, vec_id, vector)

    def _store(self, rows: DataFrame, names: np.ndarray, centroids: np.ndarray) -> dict[int, tuple]:
        """Writes rows by cell; (radius, size, folders) of each cell that got some."""
        folder = uuid.uuid4().hex
        placed = rows.mapInArrow(_assigned(names, centroids), _stored(rows)).withColumn("in_folder", F.lit(folder))
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell").write.parquet(f"{self.path}/rows/{folder}")
        stored = self.spark.read.schema(_stored(rows)).parquet(f"{self.path}/rows/{folder}")
        return {r["cell"]: (r["radius"], r["n"], [folder]) for r in stored.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}

    def append(self, rows: DataFrame, batch: str, vec_id: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        """Adds a batch under a name; a name that is there already changes nothing."""
        cells, batches, version = self._state()
        if batch in batches:
            return self
        fresh = self._packed(rows, vec_id, vector).join(self._read(cells).select("id"), "id", "left_anti")
        fresh = fresh.select(*[c for c in self._read(cells).columns if c not in ("cell", "far")])
        if not cells:
            return self._commit(self._trained(fresh), [*batches, batch], version + 1)
        names = np.asarray(sorted(cells), np.int32)
        for n, (radius, size, folders) in self._store(fresh, names, np.asarray([cells[c][0] for c in names])).items():
            c, r, s, f = cells[n]
            cells[n] = (c, max(r, radius), s + size, [*f, *folders])
        return self._commit(cells, [*batches, batch], version + 1)

    def delete(self, gone: DataFrame) -> VectorIndex:
        """Removes ids (column ``id``): cells that hold some are written anew."""
        cells, batches, version = self._state()
        gone = gone.select(F.col("id").cast("long")).distinct()
        held = [r["cell"] for r in self._read(cells).select("id", "cell").join(gone, "id", "left_semi").select("cell").distinct().collect()]
        return self._anew(cells, held, lambda df: df.join(gone, "id", "left_anti"), batches, version)

    def _anew(self, cells, which, change, batches, version, split=lambda n: 1) -> VectorIndex:
        """Cells ``which`` written anew, each cut in ``split`` by centroids of its own."""
        if not which:
            return self
        names, centroids, old = [], [], {n: cells.pop(n) for n in which}
        top = max([*cells, *which]) + 1
        cut = self._parted(old, {n: split(n) for n in which if split(n) > 1})
        for n in which:
            parts = cut.get(n, [old[n][0]])
            names += range(top, top + len(parts))
            centroids += parts
            top += len(parts)
        rows = change(self._read(old)).drop("cell", "far")
        order = [c for c in self._read(old).columns if c not in ("cell", "far")]
        got = self._store(rows.select(*order), np.asarray(names, np.int32), np.asarray(centroids))
        for n, c in zip(names, centroids):
            cells[n] = (c, *got.get(n, (0.0, 0, [])))
        return self._commit(cells, batches, version + 1)

    def _parted(self, cells, parts: dict[int, int]) -> dict[int, list]:
        """Centroids that cut each cell in so many parts, trained on at most SAMPLE of its rows where they are."""
        if not parts:
            return {}
        plan = F.broadcast(self.spark.createDataFrame([(n, min(p, CELLS)) for n, p in parts.items()], "cell int, parts int"))
        drawn = Window.partitionBy("cell").orderBy(F.xxhash64("id"))
        rows = self._read(cells, parts).select("cell", "id", "vec").join(plan, "cell").withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= SAMPLE)
        out: dict[int, list] = {}
        for r in rows.select("cell", "parts", "vec").mapInArrow(_parting, "cell int, centroid binary").collect():  # the new cells
            out.setdefault(r["cell"], []).append(np.frombuffer(r["centroid"], "<f8").tolist())
        return out

    def split(self, most: int) -> VectorIndex:
        """Cells of more than ``most`` rows, or of more than 8 folders, are written anew, cut to about ``most`` rows."""
        cells, batches, version = self._state()
        sizes = {n: c[2] for n, c in cells.items()}
        large = [n for n, c in cells.items() if c[2] > most or len(c[3]) > 8]
        parts = lambda n: -(-2 * sizes[n] // most) if sizes[n] > most else 1
        return self._anew(cells, large, lambda df: df, batches, version, parts)

    # --- search

    def needed(self, queries: DataFrame, k: int, bounds: DataFrame | None = None, state=None) -> DataFrame:
        """(id, vec, cell) that queries (id, vec) read first, or beyond their ``bound`` then."""
        cells = (state or self._state())[0]
        names = np.asarray(sorted(n for n, c in cells.items() if c[2]), np.int32)
        if not len(names):
            return queries.select("id", "vec", F.lit(0).alias("cell")).limit(0)
        figures = [np.asarray([cells[n][i] for n in names]) for i in range(3)]
        asked = queries.join(bounds, "id", "left") if bounds is not None else queries
        return asked.mapInArrow(_wanted(names, *figures, k), "id long, vec binary, cell int")

    def _hits(self, asked: DataFrame, cells, k: int | None, where: Column | None, sizes: dict[int, int], same: str | None = None, later: bool = False, apart: DataFrame | None = None) -> DataFrame:
        """What queries (id, vec, key, and maybe ``least``) find in the cells they read: groups of cells and shares of queries, all with each other."""
        names = np.asarray(sorted(n for n in cells if sizes.get(n)), np.int32)
        if not len(names):
            return self.spark.createDataFrame([], "query_id long, id long, score double")
        centroids, radius = (np.asarray([cells[n][i] for n in names]) for i in range(2))
        total = sum(sizes[n] for n in names.tolist())
        side = min(round(TASKS**0.5), round((total / 1024) ** 0.5) + 1)  # few rows are few tasks
        most = max(1024, min(GROUP, GROUP_BYTES // (8 * centroids.shape[1]), -(-total // side)))
        of = _groups([(n, sizes[n]) for n in names.tolist()], most)
        first, parts = (np.asarray([of[n][i] for n in names.tolist()]) for i in range(2))
        groups = int((first + parts).max())
        shares = max(1, -(-side * side // groups))
        plan = F.broadcast(self.spark.createDataFrame([(n, *g) for n, g in of.items()], "cell int, first int, parts int"))
        rows = self._read(cells, of)
        rows = (rows.where(where) if where is not None else rows).withColumn("key", F.xxhash64(f"`{same}`") if same else F.lit(0).cast("long"))
        rows = rows.drop("key").join(apart, "id") if apart is not None else rows
        group = F.col("first") + F.pmod(F.xxhash64("id"), "parts").cast("int")
        none = F.lit(None).cast("double")
        rows = rows.join(plan, "cell").select(group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("role"), "key", "cell", "id", "vec", none.alias("least"), none.alias("reach"))
        counts = np.asarray([sizes[n] for n in names.tolist()])
        asks = asked.mapInArrow(_asking(names, centroids, radius, counts, first, parts, shares, k), _MET_SCHEMA)
        met = rows.unionByName(asks).repartition(min(4 * TASKS, 2 * groups * shares), "group", "share").sortWithinPartitions("group", "share", "role", "key", "cell")
        return met.mapInArrow(_compared(names, centroids, radius, k, same is not None, later, apart is not None), "query_id long, id long, score double")

    def _sizes(self, cells, where: Column | None) -> dict[int, int]:
        """Rows of each cell, of those with ``where``."""
        if where is None:
            return {n: c[2] for n, c in cells.items()}
        return {r["cell"]: r["n"] for r in self._read(cells).where(where).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, id, score): exactly the ``k`` nearest rows (of those with ``where``) of each query by cosine, never its own id.

        Ties go to the smaller id. Queries without a usable vector find nothing; of queries that repeat an id one is asked.
        """
        cells = self._state()[0]
        sizes = self._sizes(cells, where)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if not any(sizes.values()):
            return self.spark.createDataFrame([], "query_id long, rank int, id long, score double")
        cuts = Cuts(self.spark)
        asked = cuts.written(self._packed(queries.select(vec_id, vector), vec_id, vector).withColumn("key", F.lit(0).cast("long")), "index-queries")
        first = cuts.written(top(self._hits(asked, cells, k, where, sizes)), "index-first")
        least = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        got = top(self._hits(asked.join(least, "id", "left"), cells, k, where, sizes))
        got = written(got.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"), "index-found")
        cuts.clear()
        return got

    def near(self, queries: DataFrame, least_score: float, where: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", same: str | None = None, later: bool = False) -> DataFrame:
        """(query_id, id, score): exactly the rows of at least that cosine to each query, never its own id.

        With ``same`` only those that agree with the query in a column of both, by a hash of it; with ``later`` only those of a larger id.
        """
        cells = self._state()[0]
        key = [F.col(f"`{same}`").alias("same")] if same else []
        asked = self._packed(queries.select(vec_id, vector, *key), vec_id, vector).select("id", "vec", (F.xxhash64("same") if same else F.lit(0).cast("long")).alias("key"), F.lit(float(least_score)).alias("least"))
        return written(self._hits(asked, cells, None, where, self._sizes(cells, where), same, later), "index-near")

    def apart(self, asked: DataFrame, keys: DataFrame) -> DataFrame:
        """(query_id, id, score): for ids of the index with a key and a least score (id, key, least) exactly the nearest row of another key, if it has that score.

        ``keys`` are those of all rows (id, key); rows without one are not found. Ties go to the smaller id.
        """
        cells = self._state()[0]
        own = self._read(cells).select("id", "vec").join(asked.select("id", "key", "least"), "id").select("id", "vec", "key", "least")
        hits = self._hits(own, cells, 1, None, self._sizes(cells, None), apart=keys.select("id", "key"))
        best = hits.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("m"))
        return best.select("query_id", (-F.col("m.id")).alias("id"), F.col("m.score").alias("score"))
