"""Edge cases and plain versions of the structure and record operators."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from strataloom.operators import records as R
from strataloom.operators import structure as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_communities_by_a_plain_loop(spark):
    r = random.Random(8)
    edges = [(f"n{a}", f"n{b}", float(w)) for a, b, w in ((r.randrange(40), r.randrange(40), r.choice((1, 2, 5))) for _ in range(90))]
    weight = defaultdict(float)
    for a, b, w in edges:
        if a != b:
            weight[a, b] += w
            weight[b, a] += w
    near = defaultdict(dict)
    for (a, b), w in weight.items():
        near[a][b] = w
    label = {n: n for n in near}
    for _ in range(20):
        new = {}
        for n in near:
            votes = defaultdict(float)
            votes[label[n]] += max(near[n].values())
            for m, w in near[n].items():
                votes[label[m]] += w
            new[n] = min(votes, key=lambda k: (-votes[k], k))
        done, label = new == label, new
        if done:
            break
    df = spark.createDataFrame([*edges, (None, "n1", 1.0)], "src string, dst string, weight double")
    got = T.communities(df)
    assert dict(rows(got.select("node", "community"))) == label and got.where("not settled").count() == 0 and len(set(label.values())) < len(label)
    assert rows(T.communities(df.limit(0))) == []


def test_version_ranges(spark):
    d = spark.createDataFrame([("x", v) for v in ("1.2", "1.10", "1.10.0", "2", "v1.9-rc", None, "none")], "artifact string, version string")
    c = spark.createDataFrame([("x", "1.2.1", "1.10", "A"), ("x", None, "1.10.0", "B"), ("x", "1.10", None, "C"), ("y", None, None, "D")], "artifact string, low string, high string, id string")
    got = {(r["version"], r["id"]) for r in T.advisories(d, c).collect()}
    assert got == {("1.2", "B"), ("v1.9-rc", "A"), ("v1.9-rc", "B"), ("1.10", "C"), ("1.10.0", "C"), ("2", "C")}


def test_reach_and_orphans(spark):
    n = spark.createDataFrame([(c,) for c in "abcdef"], "node string")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "c"), ("e", "e")], "src string, dst string")
    assert rows(T.unreached(n, e, n.where("node = 'a'"))) == [("d",), ("e",), ("f",)]
    assert len(rows(T.unreached(n, e, n.limit(0)))) == 6 and rows(T.orphans(n, e)) == [("f",)]


def test_agreement_with_itself_and_with_nothing(spark):
    df = spark.createDataFrame([(i % 3, i % 3, 0) for i in range(12)] + [(None, 1, 1)], "a int, b int, one int")
    assert tuple(T.cluster_agreement(df, "a", "b").first()) == (12, 1.0, 1.0)
    r = T.cluster_agreement(df, "a", "one").first()
    assert abs(r["rand"] - 18 / 66) < 1e-9 and abs(r["jaccard"] - 1 / 3) < 1e-9
    assert tuple(T.cluster_agreement(df.limit(0), "a", "b").first()) == (0, 1.0, None)


def test_compaction(spark):
    e = spark.createDataFrame([(1, 2, "similar", 0.9), (1, 3, "mentions", 0.5), (4, 3, "mentions", 0.7), (1, 4, "mentions", 1.0), (5, 6, "similar", 0.8)], "src int, dst int, kind string, weight double")
    gone = spark.createDataFrame([(1, 4)], "node int, by int")
    assert rows(T.compacted(e, gone)) == [(4, 3, "mentions", 0.7), (5, 6, "similar", 0.8)]


def test_chain_finds_forged_and_moved_entries(spark):
    made, before = [], None
    for i, body in enumerate(("one", None, "three", "four")):
        h = spark.range(1).select(R.entry_hash(F.lit(body), F.lit(before))).first()[0]
        made.append(("c", i, body, before, h))
        before = h
    schema = "chain string, n int, body string, prev_hash string, hash string"
    check = lambda log: [(r["linked"], r["intact"]) for r in R.verify_chain(spark.createDataFrame(log, schema), "chain", "n", ["body"]).orderBy("n").collect()]
    assert check(made) == [(True, True)] * 4
    assert check([made[0], ("c", 1, "forged", *made[1][3:]), *made[2:]]) == [(True, True), (True, False), (True, True), (True, True)]
    assert check([made[0], *made[2:]]) == [(True, True), (False, True), (True, True)]


def test_windows_of_lines(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(10)))), (2, ""), (3, None), (4, "a")], "doc_id int, text string")
    got = [tuple(r)[:3] for r in R.line_windows(docs, 4, 1).orderBy("doc_id", "first").collect()]
    assert got == [(1, 0, 3), (1, 3, 6), (1, 6, 9), (4, 0, 0)]


def test_latency_and_controls(spark):
    calls = spark.createDataFrame([("t", float(i), i == 3) for i in range(40)] + [("u", None, None), ("u", 2.0, True)], "tool string, ms double, bad boolean")
    got = {r["tool"]: (r["calls"], r["errors"], r["p95"]) for r in R.tool_latency(calls, "tool", "ms", F.col("bad")).collect()}
    assert got == {"t": (40, 1, 38.0), "u": (2, 1, 2.0)}
    assert rows(R.control_ratio(calls, "tool", "ms", ~F.col("bad")))[1] == ("u", 2, 0, 0.0)
    assert rows(R.merged(spark.createDataFrame([], "k int, id int, content string, tags array<string>, confidence double"), "k")) == []


def test_edges_are_dealt_once_for_all_rounds(spark, tmp_path, monkeypatch):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", float(1 + i % 3)) for i in range(12)], "src string, dst string, weight double")
    dealt, deal = [], type(e).repartition
    monkeypatch.setattr(type(e), "repartition", lambda self, *by: (dealt.append(by[-1]), deal(self, *by))[1])
    monkeypatch.setattr("strataloom.sources.tables.scratch", lambda spark: str(tmp_path))
    found = T.communities(e)
    assert found.count() == 13 and dealt.count("dst") == 1 and dealt.count("i") > 1
    assert [p.name[:8] for p in tmp_path.iterdir()] == ["lp-found"]  # rounds leave nothing behind
