"""Linkage of vectors over all pairs against plain loops."""

import itertools

import numpy as np
import pytest

from strataloom.operators import vector_linkage as V
from strataloom.operators.vector_index import VectorIndex, packed_rows


def vectors(n, seed, clusters=6, dim=8, copies=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((clusters, dim))[r.integers(0, clusters, n)] + 0.4 * r.standard_normal((n, dim))
    return np.concatenate([x, np.repeat(x[:1], copies, axis=0)])


def frame(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (None, [1.0] * x.shape[1]), (9000, None), (9001, [0.0] * x.shape[1])], "vec_id long, embedding array<double>").repartition(5)


def averages(x, most):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, clusters, out = u @ u.T, {i: [i] for i in range(len(x))}, []
    while len(clusters) > 1:
        best, a, b = max((s[np.ix_(clusters[a], clusters[b])].mean(), a, b) for a, b in itertools.combinations(sorted(clusters), 2))
        if 1 - best > most + 1e-12:
            break
        clusters[a] = clusters[a] + clusters.pop(b)
        out.append((a, b, round(1 - best, 9), len(clusters[a])))
    return out


@pytest.mark.parametrize("alone", [4096, 6])
def test_average_over_all_pairs(spark, monkeypatch, alone):
    monkeypatch.setattr(V, "ALONE", alone)
    monkeypatch.setattr(V, "ROWS", 20)
    x = vectors(45, 3)
    got = V.average_merges(packed_rows(frame(spark, x)), 0.8).orderBy("distance").collect()
    want = averages(x, 0.8)
    assert [(r["a"], r["b"], round(r["distance"], 9), r["size"]) for r in got] == sorted(want, key=lambda m: m[2])
    assert max(m[3] for m in want) > 8  # more than five nearest can tell


@pytest.mark.parametrize("alone", [4096, 6])
def test_copies_merge_in_few_rounds(spark, monkeypatch, alone):
    monkeypatch.setattr(V, "ALONE", alone)
    got = V.average_merges(packed_rows(frame(spark, vectors(1, 5, copies=39))), 0.5).collect()
    assert len(got) == 39 and max(r["size"] for r in got) == 40 and max(r["round"] for r in got) < 25
    assert all(abs(r["distance"]) < 1e-9 for r in got)


def forest(x):
    """Similarities of a best spanning forest over positive pairs."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, of, out = u @ u.T, list(range(len(x))), []
    for a, b in sorted(itertools.combinations(range(len(x)), 2), key=lambda p: -s[p]):
        if of[a] != of[b] and s[a, b] > 0:
            out.append(round(s[a, b], 9))
            of = [of[a] if t == of[b] else t for t in of]
    return sorted(out)


@pytest.mark.parametrize("x,k", [(vectors(150, 7), 2), (vectors(60, 8, copies=30), 3), (np.concatenate([np.eye(4), -np.eye(4), np.eye(4)[:2]]), 1)], ids=["clusters", "copies", "axes"])
def test_forest_over_all_pairs(spark, tmp_path, x, k):
    df = frame(spark, x)
    index = VectorIndex.build(df, f"{tmp_path}/i")
    got = V.vector_forest(index, df, k=k).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(u[r["a"]] @ u[r["b"]] - r["similarity"]) < 1e-12 for r in got)
    assert sorted(round(r["similarity"], 9) for r in got) == forest(x)


def test_queries_see_all_pairs(spark, tmp_path):
    """A tight group of seven and a looser one: what joins them is in no list of five nearest."""
    from strataloom.plans import clusters as P

    r = np.random.default_rng(1)
    x = np.concatenate([np.eye(6)[0] + 0.01 * r.standard_normal((7, 6)), np.eye(6)[0] * 0.6 + np.eye(6)[1] + 0.01 * r.standard_normal((7, 6))])
    frame(spark, x).selectExpr("*", "0 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(round(r["similarity"], 6) for r in P.linkage_forest(spark, str(tmp_path)).collect()) == [round(s, 6) for s in forest(x)]
    got = sorted((r["a"], r["b"], r["distance"], r["size"]) for r in P.linkage_average(spark, str(tmp_path)).collect())
    assert got == sorted((a, b, round(d, 6), n) for a, b, d, n in averages(x, 0.8)) and max(g[3] for g in got) == 14


def test_nothing(spark, tmp_path):
    none = frame(spark, vectors(3, 1)).limit(0)
    assert V.average_merges(packed_rows(none)).collect() == []
    assert V.vector_forest(VectorIndex.build(none, f"{tmp_path}/n"), none).collect() == []
