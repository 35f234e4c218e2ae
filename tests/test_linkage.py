"""Linkage and ordered clusters against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import linkage as L


def graph(n, m, seed, ties=False):
    r = random.Random(seed)
    pairs = r.sample(list(itertools.combinations(range(n), 2)), m)
    return {p: (r.choice([0.25, 0.5, 1.0]) if ties else r.uniform(0.05, 1)) for p in pairs}


def frame(spark, e):
    rows = [(b, a, s) if (a + b) % 2 else (a, b, s) for (a, b), s in e.items()]
    return spark.createDataFrame([*rows, (1, 1, 0.9), (None, 2, 0.9), (3, 4, 0.0)], "a long, b long, similarity double").repartition(6)


def one_at_a_time(e, n, linkage, most_distance):
    clusters = {i: {i} for i in range(n)}
    of = lambda a, b: e.get((min(a, b), max(a, b)), 0.0)
    out = []
    while True:
        best = None
        for a, b in itertools.combinations(sorted(clusters), 2):
            s = [of(x, y) for x in clusters[a] for y in clusters[b]]
            s = sum(s) / len(s) if linkage == "average" else min(s) if linkage == "complete" else max(s)
            if s > 0 and (best is None or s > best[0]):
                best = (s, a, b)
        if best is None or 1 - best[0] > most_distance + 1e-12:
            return out
        s, a, b = best
        clusters[a] |= clusters.pop(b)
        out.append((a, b, round(1 - s, 9), len(clusters[a])))


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_merges_of_one_at_a_time(spark, linkage):
    e = graph(30, 140, 5)
    got = L.agglomerated(frame(spark, e), linkage, 0.8).orderBy("distance").collect()
    assert [(r["a"], r["b"], round(r["distance"], 9), r["size"]) for r in got] == sorted(one_at_a_time(e, 30, linkage, 0.8), key=lambda m: m[2])


def test_forest_is_single_linkage(spark):
    e = graph(40, 120, 6)
    forest = L.spanning_forest(frame(spark, e))
    got = [(r["a"], r["b"], r["similarity"]) for r in forest.collect()]
    assert all(e[a, b] == s for a, b, s in got)
    merges = one_at_a_time(e, 40, "single", 1.0)
    assert sorted(round(1 - s, 9) for *_, s in got) == sorted(m[2] for m in merges)
    nodes = spark.range(40).select(F.col("id").alias("node"))
    want = {i: i for i in range(40)}
    for a, b, d, _ in merges:
        if d <= 0.4:
            want = {k: a if v == b else v for k, v in want.items()}
    assert {r["node"]: r["cluster"] for r in L.cut(nodes, forest.where("similarity >= 0.6")).collect()} == want


def test_ties_repartitioning_and_copies(spark):
    e = graph(30, 100, 7, ties=True) | {p: 1.0 for p in itertools.combinations(range(40, 60), 2)}  # a group of twenty copies
    a = sorted(tuple(r) for r in L.agglomerated(frame(spark, e), "average", 0.6).collect())
    b = sorted(tuple(r) for r in L.agglomerated(frame(spark, e).repartition(3, "b"), "average", 0.6).collect())
    assert a == b and max(r[0] for r in a) < 15
    assert len(L.spanning_forest(frame(spark, e)).where("a >= 40").collect()) == 19


@pytest.mark.parametrize("seed,m", [(1, 60), (2, 300)])
def test_ordered_clusters(spark, seed, m):
    r = random.Random(seed)
    e, place = graph(60, m, seed), list(range(60))
    r.shuffle(place)
    near = {i: set() for i in range(60)}
    for a, b in e:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for i in sorted(range(60), key=place.__getitem__):
        if i not in want:
            want |= {i: i} | {j: i for j in near[i] if j not in want}
    nodes = spark.createDataFrame(list(enumerate(place)), "node long, place long")
    got = {x["node"]: x["leader"] for x in L.ordered_clusters(nodes, frame(spark, e).select("a", "b").where("not (a = 3 and b = 4)" if (3, 4) not in e else "true")).collect()}
    assert got == want


def test_empty(spark):
    none = frame(spark, {}).limit(0)
    assert L.agglomerated(none).collect() == [] and L.spanning_forest(none).collect() == []
    nodes = spark.createDataFrame([(7, 0)], "node long, place long")
    assert [tuple(r) for r in L.ordered_clusters(nodes, none.select("a", "b")).collect()] == [(7, 7)]
    assert [tuple(r) for r in L.cut(nodes, none).collect()] == [(7, 7)]
