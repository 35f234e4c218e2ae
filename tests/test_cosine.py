"""The cosine to the last bit: what ties in SQL ties here."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions.measures import cosine
from strataloom.operators import retrieval as R


@pytest.fixture(scope="module")
def rows():
    return [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(8).standard_normal((400, 64)).astype(np.float32).astype(float))]


def test_cosines_are_those_of_sql(spark, rows):
    df = spark.createDataFrame(rows, "i long, v array<double>")
    q = F.array(*[F.lit(x) for x in rows[7][1]])
    got = {r["i"]: (r["own"], r["far"], r["scaled"]) for r in df.select("i", cosine(F.col("v"), F.col("v")).alias("own"), cosine(F.col("v"), q).alias("far"), cosine(F.col("v"), F.transform("v", lambda x: x * 3.0)).alias("scaled")).collect()}
    own = duckdb.execute("SELECT list_cosine_similarity($1::DOUBLE[], $1::DOUBLE[])", [rows[0][1]]).fetchall()[0][0]
    far = {i: duckdb.execute("SELECT list_cosine_similarity($1::DOUBLE[], $2::DOUBLE[])", [v, rows[7][1]]).fetchall()[0][0] for i, v in rows}
    assert {x[0] for x in got.values()} == {own} == {1.0}
    assert {i: x[1] for i, x in got.items()} == far
    assert max(x[2] for x in got.values()) <= 1.0


def test_odd_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1e-100, 0.0]), (2, [1e100, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [2.0])], "i int, v array<double>")
    got = {r["i"]: r["c"] for r in df.select("i", cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()}
    assert (got[0], got[1], got[2]) == (0.0, 1.0, 1.0) and got[3] != got[3] and got[5] is None
    own = {r["i"]: r["c"] for r in df.where("i in (1, 2)").select("i", cosine(F.col("v"), F.col("v")).alias("c")).collect()}
    assert own == {1: 1.0, 2: 1.0}


def test_the_first_of_both_lists_tie(spark, rows):
    """The query's own vector and the best keyword hit have half each: the smaller id is first."""
    keyword = spark.createDataFrame([(100_000, 7.3, 1)], "doc_id long, score double, rank int")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    squares = {i: float(np.cumsum(np.square(v))[-1]) for i, v in rows}
    short = [(i, v) for i, v in rows if squares[i] / (squares[i] ** 0.5 * squares[i] ** 0.5) < 1]  # by the product of two roots
    assert len(short) > 3
    for i, v in short[:4]:
        best = R.fuse_weighted(keyword, R.vector_search(df.where(F.col("vec_id") == i), v, 1), 2).collect()
        assert [(r["doc_id"], r["score"], r["rank"]) for r in best] == [(i, 0.5, 1), (100_000, 0.5, 2)]
