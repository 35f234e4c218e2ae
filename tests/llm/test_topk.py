"""Exact top-k with ties, nulls, repeated rows, unequal lengths and nothing at all."""

import random

import numpy as np

from strataloom.llm.topk import SortedLists, top_k
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, score string, g int"


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_against_all_pairs_with_ties_and_unusable_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(6)]) for i in range(400)]
    rows += [(401, None), (402, [float("nan")] * 6), (450, [None] * 6), (500, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    assert found(top_k(df)) == brute.best(rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x", 1), (0, [1.0, 2.0], "x", 1), (7, [1.0, 1.0], "x", 1), (8, [1.0], "x", 1), (None, [1.0, 1.0], "x", 1)], SCHEMA)
    assert found(top_k(df)) == [(0, 1, 7, 256 * 256 * 3)]
    assert found(top_k(df.limit(0))) == []


def test_bounds_hold_at_every_depth():
    g = np.random.default_rng(2)
    x, q = g.integers(-50, 50, (64, 5)).astype(float), g.integers(-50, 50, (9, 5)).astype(float)
    lists = SortedLists(np.arange(64), x)
    for depth in (1, 8, 40, 63):
        for own in q:
            seen, low, high = lists.read(own, depth)
            assert (low <= x @ own).all() and (x @ own <= high).all() and len(set(high[~seen].tolist())) <= 1


def test_lists_are_read_in_part_and_few_scores_resolved():
    """Skewed components, as of topics: each vector is large in few of them."""
    g = np.random.default_rng(4)
    x = np.floor(256 * g.pareto(1.5, (4096, 16)) * (g.random((4096, 16)) < 0.2))
    q, own = x[:40], np.arange(40)
    lists = SortedLists(np.arange(4096), x)
    got = lists.top(q, own, 5)
    score = q @ x.T
    for j in range(40):
        order = [i for i in np.lexsort((np.arange(4096), -score[j])) if i != j][:5]
        assert [(i, s) for o, i, s in got if o == j] == [(i, int(score[j, i])) for i in order]
    assert lists.reads < 0.5 * 40 * 4096 * 16 and lists.resolved < 0.1 * 40 * 4096


def test_scores_of_earlier_blocks_rule_out_whole_ones():
    g = np.random.default_rng(6)
    x = g.integers(0, 100, (2048, 8)).astype(float)
    lists = SortedLists(np.arange(2048), x)
    assert lists.top(x[:3], np.arange(3) + 5000, 5, [10.0**9] * 3) == [] and lists.resolved == 0


def test_integers_beyond_doubles():
    g = np.random.default_rng(3)
    x, q = g.integers(-(2**28), 2**28, (200, 4)), g.integers(-(2**28), 2**28, (3, 4))
    got = SortedLists(np.arange(200), x).top(q, np.array([-1, -2, -3]), 5)
    for j, own in enumerate((-1, -2, -3)):
        s = x @ q[j]
        assert [(i, v) for o, i, v in got if o == own] == [(int(i), int(s[i])) for i in np.lexsort((np.arange(200), -s))[:5]]
