"""Nearest neighbours against all inner products."""

from __future__ import annotations

import numpy as np
import pytest

from strataloom.llm import ann
from strataloom.llm import queries as Q


def all_pairs(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def recall(got, want):
    return np.mean([len({v for v, *_ in got[q]} & set(w)) / len(w) for q, w in want.items() if w])


def check(got, ids, x, k=20):
    where = {int(i): n for n, i in enumerate(ids)}
    for q, hits in got.items():
        assert [r for *_, r in hits] == list(range(1, len(hits) + 1)) and len(hits) == min(k, len(ids) - 1)
        assert q not in {v for v, *_ in hits}
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        for v, s, _ in hits:
            assert abs(s - float(x[where[v]] @ x[where[q]])) < 1e-12


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, x = np.asarray([r["vec_id"] for r in rows]), np.asarray([r["embedding"] for r in rows], dtype=np.float64)
    got, want = found(Q.op13_ann(spark, f"/root/testdata/{sf}").collect()), all_pairs(ids, x)
    assert got.keys() == want.keys()
    check(got, ids, x)
    assert recall(got, want) >= 0.95


def clustered(n, dim, clusters, seed, spread=0.15, scale=False):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((clusters, dim))
    x = c[np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, clusters, n))] + spread * rng.standard_normal((n, dim))  # a third in one list
    return x * rng.uniform(0.2, 3, (n, 1)) if scale else x


@pytest.mark.parametrize("scale", [False, True])
def test_crowded_and_of_any_length(spark, scale, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 300)
    monkeypatch.setattr(ann, "QUERIES", 16)
    x = clustered(3000, 48, 30, 5, scale=scale)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got, want = found(ann.nearest(df).collect()), all_pairs(ids, x)
    assert got.keys() == want.keys()
    check(got, ids, x)
    assert recall(got, want) >= 0.9


def test_scan_abandons_candidates():
    x = clustered(4096, 128, 40, 6)
    turn = ann.rotation(128)
    assert np.allclose(turn @ turn.T, np.eye(128))
    block, own = ann.Candidates(np.arange(4096), x, turn), np.arange(0, 4096, 64)
    got = block.scan(own, x[own], np.full(len(own), -np.inf), 20, turn)
    want = all_pairs(np.arange(4096), x, every=64)
    assert np.mean([len(set(ids.tolist()) & set(want[int(q)])) / 20 for q, (ids, _) in zip(own, got)]) >= 0.95
    assert block.read < 0.5 * len(own) * 4096 * 128 and block.scored < 0.25 * len(own) * 4096


def test_edges(spark):
    v = [1.0, 0.5, 0.0]
    rows = [(0, v), (0, v), (20, [0.0, 0.0, 0.0]), (40, None), (60, [1.0, None, 2.0]), (80, [float("nan"), 1.0, 1.0]), (None, v), (3, v), (2, v), (5, [1.0]), (100, [2.0]), (7, [-1.0, 0.0, 0.0]), (0, [9.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, list string, dim int")
    got = found(ann.nearest(df).collect())
    assert got == {0: [(2, 9.0, 1), (3, 9.0, 2), (7, -9.0, 3)], 100: [(5, 2.0, 1)]}
    assert ann.nearest(df.where("vec_id > 1000")).collect() == []
