"""How often rows are read, and how large graphs are walked."""

from __future__ import annotations

import pytest

from strataloom.operators import cycles as C
from strataloom.operators import differences as D
from strataloom.operators import graph as G
from strataloom.operators import network as N
from strataloom.operators import sanitize as Z
from strataloom.plans.differences import sanitized_differences
from strataloom.sources.tables import Cuts


def counted(spark, df):
    """The same rows, and how many of them were made so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


@pytest.fixture
def tags(monkeypatch):
    """Tags of the cut points that are written."""
    found, put = [], Cuts.written
    monkeypatch.setattr(Cuts, "written", lambda self, df, tag: (found.append(tag), put(self, df, tag))[1])
    return found


def test_factor_reads_its_edges_once(spark):
    df, seen = counted(spark, spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), ("c", "d")], "src string, dst string"))
    got = {r["node"]: r["reached"] for r in G.propagation_factor(df).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": 0} and seen.value == 4


def test_findings_read_the_rules_twice(spark):
    lines = [(1, 1, ":INPUT ACCEPT"), (1, 2, "-A INPUT -p tcp --dport 23 -j ACCEPT"), (1, 3, "-A INPUT -s 1.2.3.4 -p tcp --dport 3306:3307 -j ACCEPT"), (1, 4, "-A INPUT -j DROP"), (2, 1, ":INPUT DROP")]
    df, seen = counted(spark, spark.createDataFrame(lines, "file long, line long, content string"))
    got = sorted(tuple(r) for r in N.rule_findings(N.firewall_rules(df)).collect())
    assert got == [(1, 0, "no_default_deny", "medium"), (1, 2, "any_to_any", "high"), (1, 2, "port:Telnet", "high"), (1, 3, "port:MySQL", "high")]
    assert seen.value == 2 * len(lines)


def test_a_pattern_is_tried_where_its_letters_are(spark):
    df = spark.createDataFrame([(1, 'The "Model" of Run_ID, remodel'), (2, "models DIGEST."), (3, None), (4, "endſpoint")], "doc_id long, text string")
    got = Z.denied_keys(df)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "model"), (1, "run_id"), (2, "digest")]
    assert "Contains(low" in got._jdf.queryExecution().executedPlan().toString()


def test_counts_of_lines_need_no_join(spark, small):
    got = sanitized_differences(spark, small)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = spark.createDataFrame([(1, "a\nb\n", "a\nc\nd\n"), (2, "x", "x"), (3, None, ""), (4, "x\n", None)], "id long, old string, new string")
    plain = D.line_differences(pairs, "id", "old", "new").drop("hunks")
    counts = D.line_counts(pairs, "id", "old", "new")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect())) and counts.schema == plain.schema


def test_a_graph_of_cycles_is_not_trimmed(spark, tags):
    ring = [(i, (i + 1) % 6) for i in range(6)]
    got = C.strong_parts(spark.createDataFrame(ring, "src long, dst long"))
    assert got.count() == 6 and set(r["part"] for r in got.collect()) == {0}
    assert tags.count("parts-edges") == 2
    tail = [(9, 0), (8, 9), (3, 7), (7, 6)]
    assert sorted(r["node"] for r in C.strong_parts(spark.createDataFrame(ring + tail, "src long, dst long")).collect()) == list(range(6))


def test_witnesses_stop_at_the_first_way_back(spark, tags):
    edges = [(0, 1), (1, 0)] + [(i, i + 1) for i in range(1, 12)] + [(12, 0), (20, 21), (21, 22), (22, 20)]
    df = spark.createDataFrame(edges, "src long, dst long")
    parts = spark.createDataFrame([(i, 0) for i in range(13)] + [(i, 20) for i in (20, 21, 22)], "node long, part long")
    assert sorted(tuple(r) for r in C.witnesses(df, parts).collect()) == [(0, 0, 0), (0, 1, 1), (20, 0, 20), (20, 1, 21), (20, 2, 22)]
    assert tags.count("witness-front") <= 4
