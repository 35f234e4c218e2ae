"""Items, Markdown, sanitizing, metrics and the keyword index against plain loops and worked cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph as G
from strataloom.operators import items as I
from strataloom.operators import markdown as M
from strataloom.operators import metrics as K
from strataloom.operators import retrieval as R
from strataloom.operators import sanitize as Z


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_chunks(text, most):
    if not (text or "").strip(" "):
        return []
    out, now, n = [], [], 0
    for p in re.split(r"\n\s*\n", text):
        if now and n + len(p) // 4 > most:
            out.append("\n\n".join(now))
            now, n = [], 0
        now.append(p)
        n += len(p) // 4
    return [*out, "\n\n".join(now)]


def test_paragraph_chunks(spark):
    r = random.Random(2)
    texts = [None, "", "one", "\n\na", "a" * 500] + ["".join(r.choice(["word ", "\n", "\n\n", "\n \n", "x" * 60]) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = dict(map(tuple, df.select("doc_id", M.paragraph_chunks(F.col("text"), 30)).collect()))
    assert got == {i: plain_chunks(t, 30) for i, t in enumerate(texts)}


def test_merge_confidence_by_hand(spark):
    schema = "c string, id int, tags array<string>, confidence double, validation string, updated timestamp_ntz"
    import datetime

    day = datetime.datetime(2025, 1, 1)
    items = [("a", 1, ["x", "Y"], 0.5, "unverified", day), ("a", 2, ["y", "z"], 0.9, "verified", day - datetime.timedelta(days=10)), ("b", 3, [], 0.4, "retracted", None), ("b", 4, None, 0.2, "verified", None)]
    got = {c: v for c, _, v in I.merge_confidence(spark.createDataFrame(items, schema), "c", "2025-01-01 00:00:00").collect()}
    assert got["a"] == pytest.approx(0.3 * 0.9 + 0.3 / 3 + 0.2 * 1 + 0.2 * 1)
    assert got["b"] == pytest.approx(0.3 * 0.4 + 0.0 + 0.2 * 0.5 + 0.0)


def test_tag_search_any_and_every(spark):
    df = spark.createDataFrame([(1, ["A", "b"]), (2, ["a"]), (3, []), (4, None)], "id int, tags array<string>")
    assert rows(I.by_tags(df, ["a", "B"])) == [(1, 2), (2, 1)] and rows(I.by_tags(df, ["a", "B"], every=True)) == [(1, 2)]


def test_recall_weighs_tags_vectors_and_provenance(spark):
    schema = "id int, tags array<string>, embedding array<double>, kind string, hashed boolean, validation string"
    df = spark.createDataFrame([(1, ["x"], [1.0, 0.0], "doc", True, "verified"), (2, ["x", "y"], None, "chat", False, "retracted"), (3, None, [-1.0, 0.0], "odd", True, None)], schema)
    got = {r["id"]: r["score"] for r in I.recall(df, ["X"], [1.0, 0.0]).collect()}
    assert got == {1: pytest.approx(0.3 + 0.5 + 0.2), 2: pytest.approx(0.15 + 0.2 * 0.12), 3: pytest.approx(0.2 * (0.6 * 0.2 + 0.4 * 0.3))}


def test_anchors_fences_and_repeated_titles(spark):
    text = "# A `b` & [c](d)!\n```\n# no\n```\n## A `b` & [c](d)!\n####### seven\n## tail ##"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    assert [(r["line"], r["level"], r["title"], r["anchor"]) for r in M.headings(df).orderBy("line").collect()] == [(1, 1, "A `b` & [c](d)!", "a-b-c"), (5, 2, "A `b` & [c](d)!", "a-b-c"), (7, 2, "tail", "tail")]
    assert M.contents(df).collect()[0]["toc"].split("\n")[1] == "  - [A `b` & [c](d)!](#a-b-c-1)"


def test_ids_get_letters_in_order(spark):
    df = spark.createDataFrame([(1, "F000002 F000001 run_20240101_120000_ab /home/me/x " + "a" * 40), (2, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in Z.sanitized(df).collect()}
    assert got[1]["content"] == "[DOC-B] [DOC-A] [RUN-ID] [PATH]/x [HASH]" and (got[1]["paths"], got[1]["ids"]) == (1, 4) and got[2]["content"] == ""


def brandes(edges):
    nodes = sorted({n for e in edges for n in e})
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    central = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        before = defaultdict(list)
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        flow = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                flow[v] += paths[v] / paths[w] * (1 + flow[w])
            if w != s:
                central[w] += flow[w]
    n = len(nodes)
    return {v: c / ((n - 1) * (n - 2)) for v, c in central.items()}


def test_betweenness_and_components_by_plain_loops(spark):
    r = random.Random(9)
    edges = [(r.randrange(14), r.randrange(14)) for _ in range(30)]
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {r["node"]: r["centrality"] for r in K.betweenness(df).collect()}
    own = [(a, b) for a, b in edges if a != b]
    assert got == pytest.approx({v: c for v, c in brandes(own).items()})
    parts = [(i * 10 + a % 7, i * 10 + b % 7) for i in range(5) for a, b in own[:4]]
    label = {n: n for e in parts for n in e}
    for _ in label:
        for a, b in parts:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(rows(G.components(spark.createDataFrame(parts, "src int, dst int")))) == label


def test_longest_paths_and_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "x")], "src string, dst string")
    assert dict(rows(K.longest_paths(df))) == {"a": 0, "b": 1, "c": 2, "d": 3}
    round_ = df.union(spark.createDataFrame([("d", "b")], "src string, dst string"))
    assert dict(rows(K.cyclic_groups(round_))) == {"b": "b", "c": "b", "d": "b", "x": "x"}
    with pytest.raises(RuntimeError):
        K.longest_paths(round_, max_rounds=8)


def test_merkle_roots_by_a_plain_fold(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    data = [(g, i, f"{g}-{i}") for g, n in (("a", 1), ("b", 2), ("c", 5), ("d", 8)) for i in range(n)]
    want = {}
    for g in "abcd":
        level = [sha(t) for k, _, t in data if k == g]
        n = len(level)
        while len(level) > 1:
            level += level[-1:] * (len(level) % 2)
            level = [sha(x + y) for x, y in zip(level[::2], level[1::2])]
        want[g] = (n, level[0])
    got = K.merkle_roots(spark.createDataFrame(data, "g string, i int, t string"), "g", ["i"], "t")
    assert {r["g"]: (r["leaves"], r["root"]) for r in got.collect()} == want


def test_keyword_index_in_batches_is_the_scan(spark, tmp_path):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("alpha beta gammaDelta eps 12 the x1".split()) for _ in range(r.randrange(0, 30)))) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = R.KeywordIndex(spark, str(tmp_path / "k")).append(df.where("doc_id < 50")).append(df.where("doc_id >= 50"))
    index.append(df.where("doc_id < 20"))  # there already
    for terms in (["alpha"], ["delta", "beta", "beta"], ["nowhere"], ["x1", "nowhere"]):
        a, b = index.search(terms, 7).collect(), R.bm25(df, terms, k=7).collect()
        assert [(x["doc_id"], x["rank"], round(x["score"], 9)) for x in a] == [(x["doc_id"], x["rank"], round(x["score"], 9)) for x in b]
