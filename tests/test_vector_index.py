"""The kept vector index against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators.vector_index import VectorIndex


def frame(spark, ids, x, kinds=None):
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, kinds if kinds is not None else ids % 5)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int")


def plain(ids, x, k, of=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, out = u @ u.T, {}
    for a, i in enumerate(ids):
        at = [b for b in np.lexsort((ids, -np.round(s[a], 12))) if b != a and (of is None or of[b])][:k]
        out[int(i)] = [int(ids[b]) for b in at]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def clustered(n, seed, clusters=25, dim=24):
    r = np.random.default_rng(seed)
    c = r.standard_normal((clusters, dim))
    return c[np.where(r.random(n) < 1 / 3, 0, r.integers(0, clusters, n))] + 0.05 * r.standard_normal((n, dim))  # a third in one place


@pytest.fixture(scope="module")
def data():
    return np.arange(900), clustered(900, 3)


def test_build_append_split_delete(spark, tmp_path, data):
    ids, x = data
    index = VectorIndex.build(frame(spark, ids[:500], x[:500]), str(tmp_path / "i"))
    index.append(frame(spark, ids[400:], x[400:]), "more")  # a hundred are there already
    index.append(frame(spark, ids[400:], x[400:]), "more")  # a batch that is tried again
    assert index.rows().count() == 900
    assert found(index.search(frame(spark, ids, x), 7)) == plain(ids, x, 7)
    largest = lambda: max(r["n"] for r in index.manifest()[1:])
    before = largest()
    index.split(60)
    assert largest() < before and index.rows().count() == 900 and index.manifest()[0]["n"] == 900
    assert found(index.search(frame(spark, ids, x), 7)) == plain(ids, x, 7)
    index.delete(frame(spark, ids, x).where("kind = 2").select(F.col("vec_id").alias("id")))
    assert index.rows().count() == 720
    assert found(index.search(frame(spark, ids, x), 7)) == plain(ids, x, 7, ids % 5 != 2)
    assert found(VectorIndex(spark, str(tmp_path / "i")).search(frame(spark, ids[:9], x[:9]), 3, F.col("kind") == 4)) == {i: v for i, v in plain(ids, x, 3, ids % 5 == 4).items() if i < 9}


def test_few_cells_are_read(spark, tmp_path, data):
    ids, x = data
    index = VectorIndex.build(frame(spark, ids, x), str(tmp_path / "i"), cells=25)
    asked = index._packed(frame(spark, ids, x).select("vec_id", "embedding"), "vec_id", "embedding")
    least = index.search(frame(spark, ids, x), 5).where("rank = 5").select(F.col("query_id").alias("id"), F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("bound"))
    read = index.needed(asked, 5).count() + index.needed(asked, 5, least).count()
    assert read < 0.25 * 900 * sum(r["n"] > 0 for r in index.manifest()[1:])


def test_edges(spark, tmp_path):
    v = [1.0, 0.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (None, v, 1), (7, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    index = VectorIndex.build(df, str(tmp_path / "i"))
    got = [tuple(r) for r in index.search(df, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 7, -1.0), (2, 1, 1, 1.0), (2, 2, 7, -1.0), (7, 1, 1, -1.0), (7, 2, 2, -1.0)]
    none = VectorIndex.build(df.limit(0), str(tmp_path / "n"))
    assert none.search(df, 3).collect() == [] and none.rows().collect() == []
    assert none.append(df, "later").rows().count() == 3  # trained on the first rows there are
    index.delete(df.select(F.col("vec_id").alias("id")))
    assert index.search(df, 3).collect() == []


def test_cells_are_chosen_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from strataloom.operators.vector_index import _wanted

    r = np.random.default_rng(1)
    c, x = r.standard_normal((2048, 8)), r.standard_normal((5000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), pa.array([v.tobytes() for v in x])], names=["id", "vec"])
    tracemalloc.start()
    read = sum(b.num_rows for b in _wanted(np.arange(2048, dtype=np.int32), c, np.ones(2048), np.full(2048, 50), 10)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == 10_000 and peak < 100 * 2**20  # all scores of the batch at once are 80 MB, and there were several such arrays


def test_many_equal_vectors_and_near_of_one_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("strataloom.operators.vector_index.GROUP", 1024)
    ids, x = np.arange(2600), clustered(2600, 4, dim=6)
    x[:1500] = x[0]  # one cell of more than a group
    rows = frame(spark, ids, x)
    index = VectorIndex.build(rows, str(tmp_path / "i"), cells=40)
    few = ids[[0, 3, 1499, 1500, 2599]]
    got = found(index.search(frame(spark, few, x[few]), 6))
    assert got == {i: v for i, v in plain(ids, x, 6).items() if i in few} and got[1499] == [0, 1, 2, 3, 4, 5]
    u = x[1400:] / np.linalg.norm(x[1400:], axis=1, keepdims=True)
    some = frame(spark, ids[1400:], x[1400:])
    index = VectorIndex.build(some, str(tmp_path / "n"), cells=20)
    near = {(r["query_id"], r["id"]) for r in index.near(some, 0.9, same="kind", later=True).collect()}
    s = u @ u.T
    assert near == {(1400 + a, 1400 + b) for a, b in zip(*np.nonzero(s >= 0.9)) if a < b and a % 5 == b % 5}


def test_few_rows_are_ordered_to_draw_a_sample(spark, tmp_path, data, monkeypatch):
    from strataloom.operators import vector_index as V

    ids, x = data
    df = frame(spark, ids, x)
    order, trained, ordered = type(df).orderBy, [], []
    monkeypatch.setattr(V, "SAMPLE", 50)
    monkeypatch.setattr(V, "train", lambda x, *a, train=V.train: (trained.append(x), train(x, *a))[1])
    monkeypatch.setattr(type(df), "orderBy", lambda self, *c: (ordered.append(self.count()), order(self, *c))[1])
    VectorIndex.build(df, str(tmp_path / "drawn"))
    monkeypatch.undo()
    least = [r["vec_id"] for r in df.orderBy(F.xxhash64("vec_id")).limit(50).collect()]
    assert np.allclose(trained[0], V._unit(x[least])) and ordered[-1] < 200  # of 900
