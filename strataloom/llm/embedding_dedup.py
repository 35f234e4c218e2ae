"""Near-duplicate vectors by sorted projection passes.

Every pass hashes a vector by the signs of random projections, sorts all vectors by those bits in sequence and compares
each with a window of its predecessors at least, in double precision. The sorted rows are numbered and dealt into blocks
by number, each with the rows before it, so results do not depend on partitions. Passes are independent; the first ones
follow from the number of vectors. Each measures how many bits part a vector from those beyond its window, and with it
the chance that a pair at the threshold was missed. Vectors for which that is still too large go on to further passes
among themselves, or, where that is less work, are all compared with each other. Pairs found are united into components. Equal vectors are one class from the start, and the links of each vector are then counted
exactly, in blocks of its component, so that groups larger than a window lose none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

COSINE = 0.95
WINDOW = 256
ROWS = 2048  # rows of a pass that are compared as one block
BITS = 48
RECALL = 0.995
BLOCK = 2048


def passes_for(n: int, window: int = WINDOW, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold shares a window with probability ``recall``: it does so in one pass if its first log2(n / window) bits agree."""
    bits = max(0.0, math.log2(max(n, 1) / window))
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 4


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(n_passes: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, dims, blobs, reps = (batch.column(i).to_pylist() for i in range(4))
            for dim in set(dims):
                rows = [i for i, d in enumerate(dims) if d == dim]
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).standard_normal((dim, n_passes * BITS))
                bits = (_unit([blobs[i] for i in rows]) @ planes[dim] > 0).reshape(len(rows), n_passes, BITS)
                keys = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for p in range(n_passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(keys[:, p]), pa.array([reps[i] for i in rows], pa.int64()), pa.array([ids[i] for i in rows], pa.int64())], names=["pass", "dim", "key", "rep", "cid"])

    return run


def _forest(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of ``m`` rows over the pairs (i, j)."""
    label = np.arange(m)
    while len(i) and (label[i] != label[j]).any():
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def _grouped(batches, keys: list[str], cols: list[str]):
    """Rows (tuples of ``cols``) of each group; rows come sorted by ``keys``."""
    group, rows = None, []
    for batch in batches:
        for key, row in zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*(batch.column(c).to_pylist() for c in cols))):
            if key != group:
                if rows:
                    yield rows
                group, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def _found(a, b, cid, miss) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cid, pa.int64()), pa.array(miss, pa.float64())], names=["a", "b", "cid", "miss"])


def _blocks(window: int):
    """Links inside each block (enough of them to connect what links), and the log of the chance that a pair of each row was missed."""
    same = 1 - math.acos(COSINE) / math.pi

    def run(batches):
        for rows in _grouped(batches, ["block", "pass", "dim"], ["role", "key", "cid", "rep", "vec"]):
            role, key = np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows], dtype=np.int64)
            own = np.flatnonzero(role == 0)
            if not len(own):
                continue
            first, end = own[0], own[-1] + 1
            x = _unit([r[4] for r in rows[:end]])
            i, j = np.nonzero(x[first:] @ x.T >= COSINE)
            label = _forest(end, i + first, j)
            off = np.flatnonzero(label != np.arange(end))
            yield _found([rows[k][3] for k in off], [rows[k][3] for k in label[off]], [None] * len(off), [None] * len(off))
            depth = np.zeros(len(own), dtype=np.int64)
            for far in (own - window - 1, own + window + 1):
                there = (far >= 0) & (far < len(rows))
                depth[there] = np.maximum(depth[there], 1 + _shared_bits(key[own[there]], key[far[there]]))
            met = np.where(depth > BITS, 0.0, same**depth)
            with np.errstate(divide="ignore"):
                miss = np.maximum(np.log1p(-met), -1e6)
            yield _found([None] * len(own), [None] * len(own), [rows[k][2] for k in own], miss)

    return run


def _all_pairs(batches):
    """Links inside each pair of blocks, as above; every two rows are compared."""
    for rows in _grouped(batches, ["dim", "bi", "bj"], ["rep", "vec"]):
        x = _unit([r[1] for r in rows])
        label = _forest(len(rows), *np.nonzero(x @ x.T >= COSINE))
        off = np.flatnonzero(label != np.arange(len(rows)))
        yield _found([rows[k][0] for k in off], [rows[k][0] for k in label[off]], [None] * len(off), [None] * len(off))


_FOUND = "a long, b long, cid long, miss double"


def _pass_links(rows: DataFrame, n_passes: int, seed: int, parts: int, window: int, size: int) -> DataFrame:
    """What ``n_passes`` passes over ``rows`` (cid, rep, dim, vec) find, in blocks of ``size`` rows by number in key order."""
    spark = rows.sparkSession
    keyed = rows.select("cid", "dim", "vec", "rep").mapInArrow(_keys(n_passes, seed), "pass int, dim int, key long, rep long, cid long")
    keyed = keyed.repartitionByRange(parts, "pass", "dim", "key", "rep", "cid").sortWithinPartitions("pass", "dim", "key", "rep", "cid")
    keyed = written(keyed.withColumn("m", F.monotonically_increasing_id()), "emb-keys").withColumn("pid", F.shiftright("m", 33))
    counts = sorted((r["pid"], r["n"]) for r in keyed.groupBy("pid").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, at = [], 0
    for pid, n in counts:
        before.append((pid, at))
        at += n
    offsets = F.broadcast(spark.createDataFrame(before, "pid long, before long"))
    keyed = keyed.join(offsets, "pid").withColumn("g", F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1))
    block, place = F.floor(F.col("g") / size), F.col("g") % size
    # Its own block; the next one, which looks back over the window; the one before, which measures depths only.
    roles = F.array(F.lit(0), F.when(place >= size - window - 1, F.lit(-1)), F.when(place <= window, F.lit(1)))
    dealt = keyed.withColumn("role", F.explode(F.filter(roles, lambda r: r.isNotNull()))).withColumn("block", block - F.col("role"))
    dealt = dealt.join(rows.select("cid", "vec"), "cid").withColumn("vec", F.when(F.col("role") < 1, F.col("vec")))
    dealt = dealt.select("block", "pass", "dim", "g", "role", "key", "cid", "rep", "vec").repartition(parts, "block").sortWithinPartitions("block", "pass", "dim", "g")
    return dealt.mapInArrow(_blocks(window), _FOUND)


def _exact_links(rows: DataFrame, n: int, parts: int) -> DataFrame:
    nb = -(-n // (BLOCK // 2))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("cid"), F.lit(nb)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    dealt = dealt.select("dim", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "rep", "vec")
    return dealt.repartition(parts, "dim", "bi", "bj").sortWithinPartitions("dim", "bi", "bj").mapInArrow(_all_pairs, _FOUND)


def near_links(classes: DataFrame, seed: int, parts: int, window: int = WINDOW, size: int = ROWS) -> DataFrame:
    """(a, b) of different vectors (cid, rep, dim, vec), enough to connect all that links, by as many passes as the crowding asks for."""
    rows, n = classes, classes.count()
    n_passes, found, exact = passes_for(n, window), [], False
    while n > 1:
        links = _exact_links(rows, n, parts) if exact else _pass_links(rows, n_passes, seed + len(found), parts, window, size)
        found.append(written(links, "emb-links"))
        if exact:
            break
        miss = found[0]
        for f in found[1:]:
            miss = miss.unionByName(f)
        miss = miss.where("cid is not null").groupBy("cid").agg(F.sum("miss").alias("miss"))
        last = found[-1].where("cid is not null").groupBy("cid").agg(F.avg("miss").alias("gain"))
        left = miss.where(F.col("miss") > math.log(1 - RECALL)).join(last, "cid")
        rows = written(classes.join(left, "cid").select("cid", "rep", "dim", "vec", "miss", "gain"), "emb-open")
        n, gain, lacks = rows.agg(F.count("*"), F.avg("gain"), F.max("miss")).first()
        if n > 1:
            n_passes = min(64, math.ceil((math.log(1 - RECALL) - lacks) / gain)) + 1 if gain < -0.01 else 0
            exact = not n_passes or len(found) > 5 or n <= n_passes * (size + 2 * window)
    out = classes.sparkSession.createDataFrame([], "a long, b long")
    for f in found:
        out = out.unionByName(f.where("a is not null").select("a", "b"))
    return out.distinct()


def _degrees(batches):
    """Links of each vector in one pair of blocks of a component; rows come sorted by component and pair of blocks."""
    group, rows = None, []

    def done(rows):
        side = [[r for r in rows if r[0] == s] for s in (0, 1)]
        x = _unit([r[3] for r in side[0]])
        if side[1]:
            hit = x @ _unit([r[3] for r in side[1]]).T >= COSINE
            left, right = hit @ np.asarray([r[2] for r in side[1]]), np.asarray([r[2] for r in side[0]]) @ hit
            out = [(r[1], int(n)) for s, c in ((side[0], left), (side[1], right)) for r, n in zip(s, c)]
        else:
            hit = x @ x.T >= COSINE
            np.fill_diagonal(hit, False)
            out = [(r[1], int(n)) for r, n in zip(side[0], hit @ np.asarray([r[2] for r in side[0]]))]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["rep", "links"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("component", "bi", "bj", "side", "rep", "n", "vec")]
        for c, bi, bj, side, rep, n, vec in zip(*cols):
            if (c, bi, bj) != group:
                if rows:
                    yield done(rows)
                group, rows = (c, bi, bj), []
            rows.append((side, rep, n, vec))
    if rows:
        yield done(rows)


def _pack(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in batch.column(1).to_pylist()], pa.int32()), pa.array([np.asarray(v, dtype="<f8").tobytes() for v in batch.column(1).to_pylist()], pa.binary())], names=["vec_id", "dim", "vec"])


def usable_numbers(column: str = "embedding"):
    """Not null, not empty, all components finite."""
    v = F.col(column)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(column: str = "embedding"):
    """Not null, not empty, all components finite, not all zero."""
    return usable_numbers(column) & F.exists(F.col(column), lambda x: x != 0)


def embedding_dedup(vectors: DataFrame, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding; other columns are not looked at).

    Rows link at a cosine of at least 0.95, found in some pass (or equal). Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, nor do vectors of different lengths with each other. Every row is a vector
    of its own, also where it repeats a vec_id; a null vec_id takes no part (component null). Ties need no rule. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = written(base.where(usable() & F.col("vec_id").isNotNull()).mapInArrow(_pack, "vec_id long, dim int, vec binary"), "emb-good")
    classes = written(good.groupBy("vec", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()), "emb-class")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = written(near_links(classes.select("cid", "rep", "dim", "vec"), seed, parts), "emb-links")
    comp = components(links)

    # Links counted exactly within components, block by block.
    member = classes.join(comp.withColumnRenamed("id", "rep"), "rep").select("component", "rep", "n", "vec")
    sizes = member.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"))
    member = member.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("rep"), "nb").cast("int"))
    pairs = member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.select("component", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), (F.col("b") > F.col("o")).cast("int").alias("side"), "rep", "n", "vec")
    dealt = pairs.repartition(parts, "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    degree = dealt.mapInArrow(_degrees, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.join(degree, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select("vec", "dim", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    got = good.join(of_class, ["vec", "dim"]).select("vec_id", "n_links", "component_id")
    rest = base.where(~(F.coalesce(usable(), F.lit(False)) & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return got.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
