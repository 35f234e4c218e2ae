"""Links of items through a graph: edges are not sorted out before they are joined."""

from __future__ import annotations

from strataloom.operators import consolidation as C


def test_repeated_edges_are_joined_as_they_are(spark, monkeypatch):
    plans, put = {}, C.written
    monkeypatch.setattr(C, "written", lambda df, tag: (plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}), put(df, tag))[1])
    items = spark.createDataFrame([(1, "d", "x"), (2, "d", "y"), (3, "e", "z"), (4, "f", "w"), (5, None, None)], "id long, doc string, first_tag string")
    edges = spark.createDataFrame([("i1", "o1"), ("i1", "o1"), ("o1", "i2"), ("i3", "o2"), ("i3", "o2"), ("i4", "o2"), ("i4", "o2"), ("i5", "o1")], "src string, dst string")
    near = spark.createDataFrame([(3, 4), (4, 3), (1, 3)], "a long, b long")
    got = sorted(map(tuple, C.graph_components(items, edges, near).collect()))
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    assert "Aggregate" not in plans["consolidation-hubs"]
