"""Outlines, scorecards and the keyword index, without orders, patterns and shuffles that are not needed."""

from __future__ import annotations

import os
import random
import re

from strataloom.operators import records as R
from strataloom.operators import retrieval as K
from strataloom.operators import scorecard as C


def test_outline_by_two_orders(spark):
    r = random.Random(7)
    rows = [(d, i * 3, r.choice([1, 2, 2, 3, 3, 3])) for d in range(4) for i in range(r.randrange(1, 40))]
    got = R.outline(spark.createDataFrame(rows, "doc_id long, line long, level int"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2
    want, n = {}, {}
    for d, line, level in rows:
        n[d] = [x + (k == level) if k <= level else 0 for k, x in zip((1, 2, 3), n.get(d, [0, 0, 0]))]
        after = [x for e, x, m in rows if e == d and x > line and m <= level]
        want[d, line] = (".".join(map(str, n[d][:level])), min(after) - 1 if after else None)
    assert {(x["doc_id"], x["line"]): (x["number"], x["until"]) for x in got.collect()} == want


def test_word_counts_are_those_of_the_patterns(spark):
    assert C._forms(r"agreed?|vote[ds]?|reject[eds]|consists? of") == {"agree", "agreed", "vote", "voted", "votes", "rejecte", "rejectd", "rejects", "consist of", "consists of"}
    patterns, r = {**C.INTENT, "acts": [C.ACTIONS]}, random.Random(5)
    forms = sorted(f for many in patterns.values() for p in many for f in C._forms(p))
    bits = [*forms, *(f.upper() for f in forms), "muſt", "Kould", "consısts of", "opİons", "optİons", "consists  of", "consist", "x", "ß"]
    texts = [(i, "".join(r.choice(bits) + r.choice([" ", " ", ", ", "_", "\n", "-", "1", "́ "]) for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = C.scorecard(df)
    assert "mustshall" not in got._jdf.queryExecution().executedPlan().toString() and "(?iu)(?<![\\p{L}\\p{N}_])(?:must" not in got._jdf.queryExecution().executedPlan().toString()
    from pyspark.sql import functions as F

    plain = df.select("doc_id", *[sum((F.regexp_count("text", F.lit(C._words(p))) for p in many), F.lit(0)).alias(k) for k, many in patterns.items()])
    low = df.withColumn("low", F.lower(F.translate("text", "ſKıİ", "skii"))).withColumn("hits", F.split("low", r"[^\p{L}\p{N}_]+"))
    fast = low.select("doc_id", *C._word_counts(patterns, "text", "low", "hits"))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, plain.collect()))


def test_rows_that_repeat_an_id_are_scored_each(spark, tmp_path):
    docs = [(1, "alpha beta beta"), (1, "alpha beta beta"), (2, "alpha gamma"), (None, "beta"), (3, ""), (4, "gamma delta gamma alpha gamma")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = K.KeywordIndex(spark, str(tmp_path / "k")).append(df)
    for terms in (["beta"], ["alpha", "gamma"]):
        want = {}
        for x in K.bm25(df, terms, k=None).collect():
            want[x["doc_id"]] = want.get(x["doc_id"], 0.0) + x["score"]
        assert {x["doc_id"]: round(x["score"], 9) for x in index.search(terms, None).collect()} == {d: round(s, 9) for d, s in want.items()}
    assert sorted(map(tuple, index.terms().collect())) == [("alpha", 4, 3, 4), ("beta", 3, 1, 5), ("delta", 1, 1, 1), ("gamma", 2, 2, 4)]
    folders = [d for _, d, _ in os.walk(tmp_path / "k")]
    assert not any(re.match("bucket=", x) for d in folders for x in d)
