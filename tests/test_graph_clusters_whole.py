"""Clusters on the graph: items of one brand or type are linked whatever their size, and components are cut into clusters."""

from __future__ import annotations

from strataloom.plans import consolidation as P


def test_brands_and_types_are_whole(spark, tmp_path):
    v = lambda x: [1.0, x]
    part = [(1, "B1", "T1", 1), (2, "B1", "T2", 2), (3, "B2", "T2", 3), (4, "B3", "T3", 3), (5, "B2", "T2", 3), (6, "B4", "T9", 1), (7, "B4", "T9", 2), (8, "B5", "T4", 1), (9, "B5", "T5", 2)]
    tables = {
        "part": spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int"),
        "lineitem": spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 2, 2), (2, 3, 3), (2, 4, 4), (3, 6, 5), (3, 7, 6), (4, 8, 4), (5, 9, 4)], "l_orderkey long, l_partkey long, l_suppkey long"),
        "embeddings": spark.createDataFrame([(1, v(0.0)), (2, v(0.0)), (3, v(0.1)), (5, v(0.0)), (6, v(0.0)), (7, v(9.0))], "vec_id long, embedding array<double>"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["id"]: (r["component"], r["cluster"]) for r in P.graph_clusters(spark, str(tmp_path)).collect()}
    # 1 and 2 are of one brand, 2 and 3 of one type; 6 and 7 are of both, but far apart; 5 has no order, 4 neither brand nor type; 8 and 9 are of one supplier only.
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (4, 4), 5: (5, 5), 6: (6, 6), 7: (6, 7), 8: (8, 8), 9: (8, 9)}
