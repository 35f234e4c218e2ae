"""Queries: code metrics over lines of orders as methods, graph figures over nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import metrics as K
from strataloom.sources.tables import table

from . import sql as S
from .audit import main_edges, nation_edges


def _methods(spark, sf):
    """Lines as methods: the supplier is the project, the part the file."""
    q = F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("file"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"),
        (q % 23).alias("complexity"), (q % 31).alias("cognitive"), (F.col("l_linenumber") + q % 3).alias("parameters"), F.col("l_linenumber").alias("depth"), q.alias("loc"),
    )


def project_metrics(spark, sf):
    return K.project_metrics(_methods(spark, sf)).withColumns({"mean_complexity": F.round("mean_complexity", 6), "debt_hours": F.round("debt_hours", 6)})


def complexity_histogram(spark, sf):
    return K.complexity_histogram(_methods(spark, sf)).withColumn("share", F.round("share", 6))


def hotspots(spark, sf):
    return K.hotspots(_methods(spark, sf), nation_edges(spark, sf), complexity=15, loc=600, members=30, coupled=5)


def graph_stats(spark, sf):
    return K.graph_stats(nation_edges(spark, sf)).withColumn("density", F.round("density", 6))


def cyclic_groups(spark, sf):
    return K.cyclic_groups(main_edges(spark, sf))


def betweenness(spark, sf):
    return K.betweenness(main_edges(spark, sf)).withColumn("centrality", F.round("centrality", 6))


def longest_paths(spark, sf):
    return K.longest_paths(nation_edges(spark, sf).where("src < dst"))


def unused_imports(spark, sf):
    """Suppliers' parts of which no line was returned."""
    pair = F.concat_ws(".", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("dst")
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), pair, "l_returnflag")
    return K.unused_imports(line.select("src", "dst").distinct(), line.where("l_returnflag = 'R'"))


def _kinds(spark, sf):
    return nation_edges(spark, sf).withColumn("kind", F.when(F.col("src") == F.col("dst"), "self").otherwise("uses"))


def graph_dot(spark, sf):
    return K.edge_lines(_kinds(spark, sf), "dot")


def graph_mermaid(spark, sf):
    return K.edge_lines(_kinds(spark, sf), "mermaid")


def graph_json(spark, sf):
    return K.edge_lines(_kinds(spark, sf), "json")


def merkle_roots(spark, sf):
    return K.merkle_roots(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


QUERIES = [project_metrics, complexity_histogram, hotspots, graph_stats, cyclic_groups, betweenness, longest_paths, unused_imports, graph_dot, graph_mermaid, graph_json, merkle_roots]

_METHODS = "m AS (SELECT l_suppkey AS project, l_partkey AS file, l_orderkey || '-' || l_linenumber AS name, l_quantity::INT % 23 AS complexity, l_quantity::INT % 31 AS cognitive, l_linenumber + l_quantity::INT % 3 AS parameters, l_linenumber AS depth, l_quantity::INT AS loc FROM lineitem)"
_EDGES = f"e AS ({S.NATION_EDGES})"
_KINDS = f"{_EDGES}, k AS (SELECT src, dst, CASE WHEN src = dst THEN 'self' ELSE 'uses' END AS kind FROM e)"
SQL = {
    "project_metrics": f"""WITH {_METHODS}, g AS (SELECT project, count(DISTINCT file) AS files, count(*) AS methods, sum(loc)::BIGINT AS loc, sum(complexity)::BIGINT AS complexity, round(avg(complexity), 6) AS mean_complexity,
 round(sum(greatest(complexity - 10, 0) * 5 + greatest(cognitive - 15, 0) * 3 + greatest(parameters - 5, 0) * 10 + greatest(depth - 4, 0) * 15) / 60::DOUBLE, 6) AS debt_hours FROM m GROUP BY 1)
SELECT *, CASE WHEN loc = 0 THEN 100 ELSE round(greatest(0::DOUBLE, least(100::DOUBLE, (171 - 5.2::DOUBLE * ln(greatest(loc * log2(greatest(loc, 1)), 1)) - 0.23::DOUBLE * complexity - 16.2::DOUBLE * ln(greatest(loc, 1))) * 100 / 171)), 1) END::DOUBLE AS maintainability FROM g""",
    "complexity_histogram": f"WITH {_METHODS} SELECT CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'high' ELSE 'very_high' END AS level, count(*) AS methods, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM m GROUP BY 1",
    "hotspots": f"""WITH {_METHODS}, {_EDGES}, f AS (SELECT file, sum(loc) AS loc, count(*) AS n FROM m GROUP BY 1), c AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e WHERE src <> dst UNION ALL SELECT dst FROM e WHERE src <> dst) GROUP BY 1),
h AS (SELECT name, 'complexity' AS type, complexity::DOUBLE AS value, CASE WHEN complexity > 30 THEN 'critical' ELSE 'high' END AS severity, complexity * 10::DOUBLE AS score FROM m WHERE complexity >= 15
UNION ALL SELECT file::VARCHAR, 'large_file', loc::DOUBLE, CASE WHEN loc > 1200 THEN 'high' ELSE 'medium' END, loc * 0.1::DOUBLE FROM f WHERE loc > 600 UNION ALL SELECT file::VARCHAR, 'god_class', n::DOUBLE, CASE WHEN n > 60 THEN 'high' ELSE 'medium' END, n * 5::DOUBLE FROM f WHERE n > 30
UNION ALL SELECT node, 'high_coupling', n::DOUBLE, CASE WHEN n > 10 THEN 'high' ELSE 'medium' END, n * 3::DOUBLE FROM c WHERE n > 5) SELECT * FROM h ORDER BY score DESC, type, name LIMIT 50""",
    "graph_stats": f"""WITH {_EDGES}, d AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1),
n AS (SELECT count(*) AS nodes, count(*) FILTER (i = 0) AS sources, count(*) FILTER (o = 0) AS sinks, max(o)::BIGINT AS most_out, max(i)::BIGINT AS most_in FROM d),
p AS (SELECT count(*) AS edges, count(*) FILTER (src = dst) AS loops, count(*) FILTER (src < dst AND (dst, src) IN (SELECT (src, dst) FROM e)) AS mutual FROM e)
SELECT *, round(edges / (nodes * (nodes - 1))::DOUBLE, 6) AS density FROM n, p""",
    "cyclic_groups": f"WITH RECURSIVE e AS ({S.MAIN_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT a.src AS node, min(a.dst) AS cycle FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1",
    "longest_paths": f"WITH RECURSIVE e AS (SELECT * FROM ({S.NATION_EDGES}) WHERE src < dst), p AS (SELECT src AS node, 0 AS length FROM e UNION SELECT dst, 0 FROM e UNION SELECT e.dst, p.length + 1 FROM p JOIN e ON p.node = e.src) SELECT node, max(length) AS length FROM p GROUP BY 1",
    "unused_imports": "SELECT DISTINCT l_suppkey AS src, l_suppkey || '.' || l_partkey AS dst FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')",
    "graph_dot": f"""WITH {_KINDS} SELECT '"' || src || '" -> "' || dst || '" [label="' || kind || '"];' AS line FROM k""",
    "graph_mermaid": f"WITH {_KINDS} SELECT regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || kind || '| ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') AS line FROM k",
    "graph_json": f"""WITH {_KINDS} SELECT '{{"source":"' || src || '","target":"' || dst || '","type":"' || kind || '"}}' AS line FROM k""",
}
