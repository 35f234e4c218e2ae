"""Queries: advisories, matrices, reachability, cluster agreement, chained logs, merged items, outlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import records as R
from strataloom.operators import structure as T
from strataloom.sources.tables import table

from . import sql as S
from .audit import main_edges, nation_edges
from .memory import _CORPUS, _corpus


def _dependencies(spark, sf):
    """Suppliers as projects, brands as artifacts; the version is made of the part's size."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("artifact"), F.format_string("%d.%d", F.floor(F.col("p_size") / 10), F.col("p_size") % 10).alias("version"))
    return table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("project")).join(part, "l_partkey").select("project", "artifact", "version").distinct()


def advisories(spark, sf):
    sizes = table(spark, sf, "part").groupBy(F.col("p_brand").alias("artifact")).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    dotted = lambda c: F.format_string("%d.%d.0", F.floor(c / 10), c % 10)
    catalog = sizes.select("artifact", dotted(F.col("lo") + 5).alias("low"), F.when(F.col("hi") % 2 == 0, dotted(F.col("hi") - 5)).alias("high"))
    return T.advisories(_dependencies(spark, sf), catalog)


def version_conflicts(spark, sf):
    return T.version_conflicts(_dependencies(spark, sf))


def _nations(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("node"))


def dependency_matrix(spark, sf):
    return T.dependency_matrix(nation_edges(spark, sf))


def dead_nodes(spark, sf):
    entries = table(spark, sf, "nation").where("n_nationkey = 5").select(F.col("n_name").alias("node"))
    return T.unreached(_nations(spark, sf), main_edges(spark, sf), entries)


def orphan_nodes(spark, sf):
    """Nations with neither end in the main edge of another one that is mutual."""
    e = main_edges(spark, sf)
    mutual = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
    return T.orphans(_nations(spark, sf), mutual)


def communities(spark, sf):
    e = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    return T.communities(e.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "weight"))


def cluster_agreement(spark, sf):
    out = T.cluster_agreement(table(spark, sf, "documents"), "lang", "source")
    return out.withColumns({c: F.round(c, 6) for c in ("rand", "jaccard")})


def cross_corpus_edges(spark, sf):
    return T.cross_corpus_edges(_corpus(spark, sf, 0), _corpus(spark, sf, 1))


def compacted_graph(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst"), F.when(F.col("l_returnflag") == "R", "similar").otherwise("mentions").alias("kind"), F.col("l_quantity").alias("weight"))
    gone = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("by")).where("node != by")
    return T.compacted(e, gone)


def chain_audit(spark, sf):
    """Events as chains by user; some entries were changed after they had been hashed."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    one = e.withColumn("prev_hash", F.sha2(F.lag(F.col("event_id").cast("string")).over(Window.partitionBy("user_id").orderBy("event_id")), 256))
    log = one.withColumn("hash", F.when(F.col("event_id") % 17 == 0, "forged").otherwise(R.entry_hash(F.col("event_type"), F.col("event_id"), F.col("prev_hash"))))
    return R.verify_chain(log, "user_id", "event_id", ["event_type", "event_id"]).select("event_id", "linked", "intact")


def merged_items(spark, sf):
    p = table(spark, sf, "part")
    tags = F.array("p_type", F.upper("p_type"), F.col("p_brand"))
    items = p.select("p_size", F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), tags.alias("tags"), F.round(F.col("p_retailprice") / 100).alias("confidence"))
    return R.merged(items, "p_size").withColumn("tags", F.array_join("tags", ","))


def placeholder_numbers(spark, sf):
    return R.placeholders(table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k")), "user_id", "event_type", "k", "event_id").select("user_id", "event_type", F.col("k").alias("found"), F.col("number").cast("int").alias("number"), "placeholder")


def injected_items(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))
    return R.within_budget(turns, "conv_id", [F.desc("turn")], "tokens", 150)


def drift_grid(spark, sf):
    return R.drift_grid(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", F.col("o_totalprice") > 250_000).withColumn("pct", F.round("pct", 6))


def tool_latency(spark, sf):
    return R.tool_latency(table(spark, sf, "events"), "event_type", "value", F.get_json_object("props", "$.k").cast("int") > 90).withColumn("mean", F.round("mean", 6))


def control_ratio(spark, sf):
    return R.control_ratio(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", F.col("l_discount") < 0.08).withColumn("ratio", F.round("ratio", 6))


def line_windows(spark, sf):
    return R.line_windows(table(spark, sf, "documents"), 6, 2)


def _headings(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.least(F.lit(3), 1 + F.col("l_quantity").cast("int") % 5).alias("level")).groupBy("doc_id", "line").agg(F.max("level").alias("level"))


def heading_jumps(spark, sf):
    return R.heading_jumps(_headings(spark, sf))


def outline(spark, sf):
    return R.outline(_headings(spark, sf))


QUERIES = [advisories, version_conflicts, dependency_matrix, dead_nodes, orphan_nodes, communities, cluster_agreement, cross_corpus_edges, compacted_graph, chain_audit, merged_items, placeholder_numbers, injected_items, drift_grid, tool_latency, control_ratio, line_windows, heading_jumps, outline]

_DEPS = "d AS (SELECT DISTINCT l_suppkey AS project, p_brand AS artifact, p_size, (p_size // 10) || '.' || (p_size % 10) AS version FROM lineitem JOIN part ON l_partkey = p_partkey)"
_HEADINGS = "h AS (SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS line, max(least(3, 1 + l_quantity::INT % 5)) AS level FROM lineitem GROUP BY 1, 2)"
SQL = {
    "advisories": f"""WITH {_DEPS}, c AS (SELECT p_brand AS artifact, min(p_size) + 5 AS lo, max(p_size) - 5 AS hi, max(p_size) % 2 = 0 AS closed FROM part GROUP BY 1)
SELECT artifact, project, version, (lo // 10) || '.' || (lo % 10) || '.0' AS low, CASE WHEN closed THEN (hi // 10) || '.' || (hi % 10) || '.0' END AS high FROM d JOIN c USING (artifact) WHERE p_size >= lo AND (NOT closed OR p_size < hi)""",
    "version_conflicts": f"WITH {_DEPS} SELECT artifact, count(DISTINCT version) AS versions, count(*) AS uses FROM d GROUP BY 1 HAVING count(DISTINCT version) > 1",
    "dependency_matrix": f"WITH e AS ({S.NATION_EDGES}) SELECT src, dst, count(*) AS n, (dst, src) IN (SELECT (src, dst) FROM e) AS mutual FROM e WHERE src <> dst GROUP BY src, dst",
    "dead_nodes": f"""WITH RECURSIVE e AS ({S.MAIN_EDGES}), r AS (SELECT n_name AS node FROM nation WHERE n_nationkey = 5 UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)
SELECT n_name AS node FROM nation WHERE n_name NOT IN (SELECT node FROM r)""",
    "orphan_nodes": f"WITH m AS ({S.MAIN_EDGES}), e AS (SELECT a.src, a.dst FROM m a JOIN m b ON a.src = b.dst AND a.dst = b.src) SELECT n_name AS node FROM nation WHERE n_name NOT IN (SELECT src FROM e UNION SELECT dst FROM e)",
    "cluster_agreement": """WITH c AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c),
t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS ab FROM c), pa AS (SELECT sum(n * (n - 1) / 2) AS pa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), pb AS (SELECT sum(n * (n - 1) / 2) AS pb FROM (SELECT sum(n) AS n FROM c GROUP BY b)),
j AS (SELECT avg(j) AS jaccard FROM (SELECT max(n / (na + nb - n)) AS j FROM w GROUP BY a))
SELECT n::BIGINT AS n, round((n * (n - 1) / 2 + 2 * ab - pa - pb) / (n * (n - 1) / 2), 6) AS rand, round(jaccard, 6) AS jaccard FROM t, pa, pb, j""",
    "cross_corpus_edges": f"""WITH a AS ({_CORPUS} 0), b AS ({_CORPUS} 1), l AS (SELECT rule_id, max(id) AS id, arg_max(content_hash, id) AS h FROM a WHERE rule_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN h = b.content_hash THEN l.id ELSE b.id END AS src, CASE WHEN h = b.content_hash THEN b.id ELSE l.id END AS dst, CASE WHEN h = b.content_hash THEN 'same_rule' ELSE 'evolved_from' END AS kind, CASE WHEN h = b.content_hash THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM b JOIN l USING (rule_id)""",
    "compacted_graph": """WITH g AS (SELECT p_partkey AS node, p_partkey - p_partkey % 10 AS by FROM part WHERE p_size < 10 AND p_partkey % 10 <> 0), e AS (SELECT l_partkey AS src, l_suppkey * 7 AS dst, CASE WHEN l_returnflag = 'R' THEN 'similar' ELSE 'mentions' END AS kind, l_quantity AS weight FROM lineitem),
m AS (SELECT coalesce(a.by, src) AS src, coalesce(b.by, dst) AS dst, kind, weight FROM e LEFT JOIN g a ON src = a.node LEFT JOIN g b ON dst = b.node WHERE NOT ((a.by IS NOT NULL OR b.by IS NOT NULL) AND kind = 'similar'))
SELECT src, dst, kind, max(weight) AS weight FROM m WHERE src <> dst GROUP BY 1, 2, 3""",
    "chain_audit": """WITH p AS (SELECT *, sha256(lag(event_id::VARCHAR) OVER (PARTITION BY user_id ORDER BY event_id)) AS prev FROM events), h AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'forged' ELSE sha256(event_type || '|' || event_id || '|' || coalesce(prev, '')) END AS hash FROM p)
SELECT event_id, coalesce(prev, '') = coalesce(lag(hash) OVER (PARTITION BY user_id ORDER BY event_id), '') AS linked, event_id % 17 <> 0 AS intact FROM h""",
    "merged_items": """WITH i AS (SELECT *, round(p_retailprice / 100) AS confidence FROM part), b AS (SELECT p_size, p_partkey AS id, p_name AS content, confidence, count(*) OVER (PARTITION BY p_size) AS members FROM i QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY confidence DESC, length(p_name) DESC, p_partkey) = 1),
t AS (SELECT p_size, unnest([p_type, upper(p_type), p_brand]) AS tag FROM i), s AS (SELECT p_size, min(tag) AS tag FROM t GROUP BY p_size, lower(tag)), g AS (SELECT p_size, string_agg(tag, ',' ORDER BY tag) AS tags FROM s GROUP BY 1)
SELECT p_size, members, id, content, tags, confidence FROM b JOIN g USING (p_size)""",
    "placeholder_numbers": """WITH k AS (SELECT user_id, event_type, event_id, regexp_extract(props, '"k": *([0-9]+)', 1) AS found FROM events), f AS (SELECT user_id, event_type, found, min(event_id) AS first FROM k WHERE found <> '' GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY first, found)::INT AS number FROM f) SELECT user_id, event_type, found, number, '[' || upper(event_type) || '_' || lpad(number::VARCHAR, 4, '0') || ']' AS placeholder FROM n""",
    "injected_items": "WITH t AS (SELECT conv_id, turn, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens FROM conversations) SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t QUALIFY used <= 150",
    "drift_grid": """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS c FROM orders GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM c), (SELECT DISTINCT o_orderstatus FROM c))
SELECT o_orderpriority, o_orderstatus, coalesce(n, 0) AS n, round(coalesce(c / n * 100, 0), 6) AS pct FROM g LEFT JOIN c USING (o_orderpriority, o_orderstatus)""",
    "tool_latency": """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS calls, count(*) FILTER (try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) > 90) AS errors, round(avg(value), 6) AS mean, max(value) AS worst FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, calls, errors, mean, worst, CASE WHEN calls >= 20 THEN v[floor(calls * 0.95)::INT + 1] ELSE worst END AS p95 FROM s""",
    "control_ratio": "SELECT l_suppkey, count(*) AS controls, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS ratio FROM (SELECT l_suppkey, l_partkey, bool_and(l_discount < 0.08) AS ok FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "line_windows": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''), s AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 3, 0) + 1, 4)) AS first FROM l)
SELECT doc_id, first::INT AS first, (least(first + 6, len(l)) - 1)::INT AS last, array_to_string(l[first + 1 : first + 6], chr(10)) AS content FROM s""",
    "heading_jumps": f"WITH {_HEADINGS} SELECT doc_id, line, level, lag(level) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM h QUALIFY level > before + 1",
    "outline": f"""WITH {_HEADINGS}, a AS (SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY doc_id ORDER BY line) AS n1 FROM h), b AS (SELECT *, count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, n1 ORDER BY line) AS n2 FROM a),
c AS (SELECT *, count(*) FILTER (level = 3) OVER (PARTITION BY doc_id, n1, n2 ORDER BY line) AS n3 FROM b)
SELECT doc_id, line, level, CASE level WHEN 1 THEN n1::VARCHAR WHEN 2 THEN n1 || '.' || n2 ELSE n1 || '.' || n2 || '.' || n3 END AS number,
 CASE level WHEN 1 THEN min(line) FILTER (level = 1) OVER w WHEN 2 THEN min(line) FILTER (level <= 2) OVER w ELSE min(line) OVER w END - 1 AS until FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
}
