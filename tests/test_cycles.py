"""Strong parts, witness cycles and reach against plain walks."""

import random

import pytest

from strataloom.operators import cycles as C


def reached(edges, n):
    out = {}
    for s in range(n):
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[s] = seen
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 30, 45), (3, 40, 120)])
def test_parts_cycles_reach(spark, seed, n, m):
    r = random.Random(seed)
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(n, n)} | {(n + 1 + i, n + 1 + (i + 1) % 9) for i in range(9)} | {(0, n + 1)}
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
    total = n + 10
    far = reached(edges, total)
    want = {i: min(j for j in far[i] if i in far[j]) for i in range(total) if i in far[i]}
    assert {x["node"]: x["cycle"] for x in C.on_cycles(df).collect()} == want
    there = {i for e in edges for i in e}
    assert {x["node"]: x["reached"] for x in C.reach(df).collect()} == {i: len(far[i] - {i}) for i in there}
    parts = C.strong_parts(df)
    ways = {}
    for x in C.witnesses(df, parts).orderBy("part", "place").collect():
        ways.setdefault(x["part"], []).append((x["place"], x["node"]))
    assert ways.keys() == {p for i, p in want.items() if sum(v == p for v in want.values()) > 1}
    for part, way in ways.items():
        nodes = [v for _, v in way]
        assert [p for p, _ in way] == list(range(len(way))) and nodes[0] == part and len(set(nodes)) == len(nodes)
        assert all((a, b) in edges for a, b in zip(nodes, [*nodes[1:], part]))
    assert len(ways[n + 1]) == 9


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert C.on_cycles(none).collect() == [] and C.reach(none).collect() == [] and C.witnesses(none, C.strong_parts(none)).collect() == []
