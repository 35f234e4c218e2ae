"""Consolidation in deltas: as one run, applied once, with links, revisions, promotions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators.consolidation import Consolidation, clusters_by_graph, promoted_tier

SCHEMA = "id long, kind string, first_tag string, embedding array<double>, content string, tags array<string>, confidence double, tier string, usage long, validation string, has_source boolean, archived boolean"


def some(n, seed=1):
    r, g = random.Random(seed), np.random.default_rng(seed)
    centres = g.standard_normal((8, 12))
    rows = []
    for i in range(n):
        v = (centres[r.randrange(8)] + 0.25 * g.standard_normal(12)).tolist() if i % 9 else None
        kind = r.choice(["note", "fact", "decision"])
        rows.append((i, kind, r.choice(["A", "a", "b", None]), v, f"text {i}", [f"t{i % 4}", f"T{i % 4}"], r.random(), r.choice(["stm", "mtm"]), r.randrange(7), r.choice(["verified", "unverified", None]), bool(i % 3), i % 17 == 0))
    return rows


def plain(rows, most=0.3):
    """id -> founder, by a loop."""
    rows = [r for r in rows if not r[11]]
    key = lambda r: r[1] + (":" + r[2].lower() if r[2] else "")
    unit = {r[0]: np.asarray(r[3]) / np.linalg.norm(r[3]) for r in rows if r[3] is not None}
    out = {}
    for r in rows:
        if r[0] in out:
            continue
        group = [x for x in rows if key(x) == key(r)]
        out[r[0]] = r[0]
        for x in group:
            if x[0] not in out and r[0] in unit and x[0] in unit and unit[r[0]] @ unit[x[0]] >= 1 - most:
                out[x[0]] = r[0]
    return out


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("consolidation")
    rows = some(150)
    df = lambda part: spark.createDataFrame(part, SCHEMA).repartition(3)
    one = Consolidation(spark, f"{at}/one").apply(df(rows), "all")
    three = Consolidation(spark, f"{at}/three")
    for name, part in (("a", rows[:60]), ("b", rows[60:100]), ("b", rows[60:100]), ("c", rows[90:])):
        three.apply(df(part), name)
    return rows, one, three


def test_deltas_are_one_run(runs):
    rows, one, three = runs
    of = lambda c: {r["id"]: r["cluster"] for r in c.members().collect()}
    assert of(one) == of(three) == plain(rows)
    shown = lambda c: sorted((r["cluster"], r["members"], r["id"], r["content"], tuple(r["tags"]), round(r["confidence"], 9)) for r in c.current().collect())
    assert shown(one) == shown(three) and shown(one)
    pairs = lambda c: sorted((r["src"], r["dst"], r["rel"]) for r in c.links().collect())
    assert pairs(one) == pairs(three) and len({d for _, d, _ in pairs(three)}) == len(pairs(three))


def test_batches_count_once_and_revisions_grow(runs):
    _, _, three = runs
    log = three.log().orderBy("version").collect()
    assert [(r["version"], r["batch"]) for r in log] == [(1, "a"), (2, "b"), (3, "c")]
    revisions = three.canonical().groupBy("cluster").agg(F.sort_array(F.collect_list("revision")).alias("r"), F.sort_array(F.collect_list("members")).alias("m")).collect()
    assert all(r["r"] == list(range(1, len(r["r"]) + 1)) and len(set(r["m"])) == len(r["m"]) for r in revisions)
    assert max(len(r["r"]) for r in revisions) > 1
    merges = three.events().where("action = 'merge'").count()
    assert merges == three.canonical().count() and three.events().where("action = 'promote'").count() == sum(r["promoted"] for r in log)


def test_a_failed_batch_starts_over(spark, tmp_path, monkeypatch):
    rows = some(60, 2)
    df = lambda part: spark.createDataFrame(part, SCHEMA)
    done = Consolidation(spark, f"{tmp_path}/c").apply(df(rows[:30]), "a")
    real = type(spark.range(1).write).mode
    monkeypatch.setattr(type(spark.range(1).write), "mode", lambda self, m: (_ for _ in ()).throw(OSError("lost")) if m == "append" and "index" not in m and failing else real(self, m))
    failing = True
    with pytest.raises(OSError):
        done.apply(df(rows[30:]), "b")
    failing = False
    assert done.log().count() == 1 and done.members().count() == len(plain(rows[:30]))
    done.apply(df(rows[30:]), "b")
    assert {r["id"]: r["cluster"] for r in done.members().collect()} == plain(rows)


def test_small_cases(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    row = lambda i, **k: tuple({"id": i, "kind": "note", "first_tag": None, "embedding": [1.0, 0.0], "content": "x", "tags": None, "confidence": 0.5, "tier": "stm", "usage": 0, "validation": None, "has_source": True, "archived": None, **k}.values())
    c = Consolidation(spark, f"{tmp_path}/c").apply(df([]), "none")
    assert c.members().collect() == [] and c.log().first()["items"] == 0
    c.apply(df([row(1, usage=2), row(2, kind="decision"), row(None), row(3, archived=True)]), "first")
    assert sorted(r["id"] for r in c.members().collect()) == [1, 2]
    assert sorted((r["id"], r["detail"]) for r in c.events().collect()) == [(1, "mtm"), (2, "mtm")]
    c.apply(df([row(5), row(5)]), "second")
    assert [(r["cluster"], r["members"]) for r in c.current().collect()] == [(1, 2)]
    tiers = df([row(1, usage=5), row(2, usage=5, tier="mtm"), row(3, usage=5, tier="ltm"), row(4, usage=2), row(5, usage=2, tier="mtm"), row(6, usage=5, has_source=False), row(7, validation="verified")])
    assert [r["t"] for r in tiers.orderBy("id").select(promoted_tier().alias("t")).collect()] == ["mtm", "ltm", None, "mtm", None, None, "mtm"]


def test_graph_clusters(spark):
    v = lambda x: [1.0, x]
    rows = [(1, "d1", "k", v(0.0)), (2, "d1", "k", v(0.01)), (3, "d2", "k", v(0.0)), (4, "d3", "m", v(0.0)), (5, "d4", "n", v(5.0)), (6, "d1", "k", v(0.0))]
    items = spark.createDataFrame(rows, "id long, doc string, first_tag string, embedding array<double>").withColumn("kind", F.lit("note"))
    edges = spark.createDataFrame([("i1", "e1"), ("i2", "e1"), ("i3", "e2"), ("i4", "e2"), ("e1", "e9"), ("i5", "e1")], "src string, dst string")
    near = spark.createDataFrame([(3, 4), (1, 3)], "a long, b long")
    got = {r["id"]: r["cluster"] for r in clusters_by_graph(items, edges, near).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}  # 6 has no edge; 3 and 4 are one component but of two tags
