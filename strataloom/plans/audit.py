"""Queries: statistics, dependency graphs, activity and risk."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import activity as A
from strataloom.operators import graph as G
from strataloom.operators import statistics as T
from strataloom.sources.tables import scratch, table
from strataloom.streaming import activity as stream

from . import sql as S


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def distribution_stats(spark, sf):
    out = T.distribution(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")
    return _rounded(out, "mean", "std", "total", "skewness", "kurtosis", "cv")


def histogram(spark, sf):
    return _rounded(T.histogram(table(spark, sf, "part"), "p_size", 10), "low", "high", "share")


def entropy_by_segment(spark, sf):
    return _rounded(T.entropy(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey"), "entropy", "normalized")


def inequality(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return _rounded(T.inequality(totals, "v"), "gini", "cr4", "cr8", "herfindahl")


def nation_weights(spark, sf):
    """(src, dst, weight): what customers' nations buy from suppliers' nations; pairs of keys are summed before the small tables join."""
    nation = table(spark, sf, "nation")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    order = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    e = line.join(order, "l_orderkey").groupBy("c_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    e = e.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    e = e.groupBy("c_nationkey", "s_nationkey").agg(F.sum("q").alias("weight"))
    return e.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst")), "s_nationkey").select("src", "dst", "weight")


def nation_edges(spark, sf):
    """Pairs of nations that trade more than the mean of all pairs."""
    w = nation_weights(spark, sf)
    return w.crossJoin(F.broadcast(w.agg(F.avg("weight").alias("mean")))).where("weight > mean").select("src", "dst")  # one row


def main_edges(spark, sf):
    """Of each nation the one that it buys most from."""
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return nation_weights(spark, sf).withColumn("r", best).where("r = 1").select("src", "dst")


def coupling_martin(spark, sf):
    own = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("abstract"))
    classes = own.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("node")), "c_nationkey")
    return _rounded(G.coupling(nation_edges(spark, sf), classes), "instability", "abstractness", "distance")


def sdp_violations(spark, sf):
    return _rounded(G.stability_violations(nation_edges(spark, sf)), "src_instability", "dst_instability", "delta")


def propagation_factor(spark, sf):
    return _rounded(G.propagation_factor(nation_edges(spark, sf)), "factor")


def _supplies(spark, sf):
    """Parts and their suppliers, of all lines."""
    return table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


def graph_components(spark, sf):
    return G.components(_supplies(spark, sf))


def graph_bfs_depth2(spark, sf):
    seed = table(spark, sf, "supplier").where("s_suppkey = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return G.neighbours(_supplies(spark, sf), seed, 2)


def edge_cap(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return G.cap_edges(e, 20)


def timeline_cumulative(spark, sf):
    return A.timeline(table(spark, sf, "events"), "ts", "day")


def activity_run_summary(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    out = A.run_summary(table(spark, sf, "events"), "user_id", "event_type", ["view", "click", "error", "purchase", "signup"], F.col("value"), k > 50)
    return _rounded(out, "duration", digits=2)


def lifecycle_class(spark, sf):
    return _rounded(A.lifecycle(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "1999-01-01"), "volatility")


def volumetry_risk(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("module")).agg(F.count("*").alias("loc"), F.avg("l_quantity").alias("complexity"), F.sum("l_quantity").alias("volume"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1) & (F.col("l_quantity") >= 49)).alias("incidents"))
    return _rounded(A.risk_matrix(m, {"loc": 2000, "complexity": 60, "volume": 40_000}), "risk_score")


def stream_activity_windows(spark, sf):
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    counts = stream.windowed_counts(stream.event_stream(spark, f"{sf}/events.parque[t]", events.schema), "ts", "event_type")
    return stream.drained(counts, path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_rate_limit(spark, sf):
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    buckets = stream.rate_limited(stream.event_stream(spark, f"{sf}/events.parque[t]", events.schema), "user_id", "ts", 0.002, 2.0)
    got = stream.drained(buckets, path, "update")
    return got.groupBy("session").agg(F.max_by(F.struct("calls", "allowed"), "calls").alias("r")).select("session", "r.*")


QUERIES = [distribution_stats, histogram, entropy_by_segment, inequality, coupling_martin, sdp_violations, propagation_factor, graph_components, graph_bfs_depth2, edge_cap, timeline_cumulative, activity_run_summary, lifecycle_class, volumetry_risk, stream_activity_windows, stream_rate_limit]

_COUPLING = f"""e AS ({S.NATION_EDGES}),
ends AS (SELECT src AS node, (src <> dst)::INT AS ce, 0 AS ca, (src = dst)::INT AS internal FROM e UNION ALL SELECT dst, 0, (src <> dst)::INT, 0 FROM e),
c AS (SELECT node, sum(ca)::BIGINT AS ca, sum(ce)::BIGINT AS ce, sum(internal)::BIGINT AS internal FROM ends GROUP BY node),
i AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce / (ca + ce)::DOUBLE ELSE 0.0 END AS instability FROM c)"""
_BULK = "b AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), u AS (SELECT src, dst FROM b UNION SELECT dst, src FROM b)"
SQL = {
    "distribution_stats": """WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS min, max(l_quantity) AS max, sum(l_quantity) AS total,
 quantile_cont(l_quantity, 0.05) AS p5, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1),
s AS (SELECT l.l_returnflag, sum(pow(l_quantity - mean, 3)) / any_value(n) / pow(any_value(std), 3) AS skewness, sum(pow(l_quantity - mean, 4)) / any_value(n) / pow(any_value(std), 4) - 3 AS kurtosis,
 count(*) FILTER (l_quantity < q1 - 1.5 * (q3 - q1) OR l_quantity > q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY 1)
SELECT m.l_returnflag, n, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(total, 6) AS total, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, p5, q1, median, q3, p95, q3 - q1 AS iqr, round(std / mean, 6) AS cv, outliers FROM m JOIN s USING (l_returnflag)""",
    "histogram": """WITH r AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi, count(*) AS t FROM part), g AS (SELECT unnest(range(10)) AS bin),
c AS (SELECT least(floor((p_size - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin, count(*) AS n FROM part, r GROUP BY 1)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 10), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 10), 6) AS high, coalesce(n, 0) AS n, round(coalesce(n, 0) / t::DOUBLE * 100, 6) AS share FROM g LEFT JOIN c USING (bin), r""",
    "entropy_by_segment": """WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS c FROM customer GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY c_mktsegment) AS n FROM c),
h AS (SELECT c_mktsegment, count(*) AS items, max(n)::BIGINT AS n, -sum(c / n * log2(c / n)) AS e FROM t GROUP BY 1)
SELECT c_mktsegment, items, n, round(CASE WHEN items > 1 THEN e ELSE 0 END, 6) AS entropy, round(CASE WHEN items > 1 THEN e / log2(items) ELSE 0 END, 6) AS normalized FROM h""",
    "inequality": """WITH v AS (SELECT sum(o_totalprice) AS v FROM orders GROUP BY o_custkey), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, row_number() OVER (ORDER BY v DESC) AS d, count(*) OVER () AS n, sum(v) OVER () AS t FROM v)
SELECT any_value(n) AS n, round(sum((2 * i - n - 1) * v) / (any_value(n) * any_value(t)), 6) AS gini, round(sum(v) FILTER (d <= 4) / any_value(t), 6) AS cr4, round(sum(v) FILTER (d <= 8) / any_value(t), 6) AS cr8, round(sum(pow(v / t, 2)), 6) AS herfindahl FROM r""",
    "coupling_martin": f"""WITH {_COUPLING}, k AS (SELECT n_name AS node, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS abstract FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
a AS (SELECT node, ca, ce, internal, instability, CASE WHEN coalesce(total, 0) > 0 THEN abstract / total::DOUBLE ELSE 0 END AS abstractness FROM i LEFT JOIN k USING (node)),
d AS (SELECT *, abs(abstractness + instability - 1) AS distance FROM a)
SELECT node, ca, ce, internal, round(instability, 6) AS instability, round(abstractness, 6) AS abstractness, round(distance, 6) AS distance,
 CASE WHEN abstractness < 0.2 AND instability < 0.2 THEN 'zone_of_pain' WHEN abstractness > 0.8 AND instability > 0.8 THEN 'zone_of_uselessness' WHEN distance < 0.1 THEN 'main_sequence' ELSE 'balanced' END AS zone FROM d""",
    "sdp_violations": f"""WITH {_COUPLING}, p AS (SELECT e.src, e.dst, a.instability AS si, b.instability AS di FROM e JOIN i a ON e.src = a.node JOIN i b ON e.dst = b.node WHERE e.src <> e.dst AND a.instability < b.instability)
SELECT src, dst, round(si, 6) AS src_instability, round(di, 6) AS dst_instability, round(di - si, 6) AS delta, CASE WHEN di - si > 0.5 THEN 'high' WHEN di - si > 0.25 THEN 'medium' ELSE 'low' END AS severity FROM p""",
    "propagation_factor": f"""WITH RECURSIVE e AS ({S.NATION_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT src AS node, count(*) AS reached FROM r WHERE src <> dst GROUP BY 1)
SELECT node, coalesce(reached, 0) AS reached, round(coalesce(reached, 0) / (SELECT count(*) FROM n)::DOUBLE, 6) AS factor FROM n LEFT JOIN c USING (node)""",
    "graph_bfs_depth2": f"WITH {_BULK}, a AS (SELECT DISTINCT dst AS node FROM u WHERE src = 's1'), o AS (SELECT DISTINCT u.dst AS node FROM u JOIN a ON u.src = a.node WHERE u.dst <> 's1' AND u.dst NOT IN (SELECT node FROM a)) SELECT node, 1 AS level FROM a UNION ALL SELECT node, 2 FROM o",
    "edge_cap": """WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS a, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS b FROM e) SELECT src, dst, weight FROM r WHERE a <= 20 AND b <= 20""",
    "timeline_cumulative": "SELECT bin, added, sum(added) OVER (ORDER BY bin)::BIGINT AS cumulative FROM (SELECT ts::DATE AS bin, count(*) AS added FROM events WHERE ts IS NOT NULL GROUP BY 1)",
    "activity_run_summary": """SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error,
 count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'signup') AS n_signup, round(sum(value), 2) AS duration, count(*) FILTER (try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) > 50) AS hits FROM events GROUP BY 1""",
    "lifecycle_class": """WITH g AS (SELECT o_custkey, count(*) AS changes, greatest(date_diff('day', min(o_orderdate)::DATE, DATE '1999-01-01'), 0)::INT AS age_days, date_diff('day', max(o_orderdate)::DATE, DATE '1999-01-01')::INT AS idle_days FROM orders GROUP BY 1)
SELECT *, round(CASE WHEN age_days > 0 THEN changes / (age_days / 30.44::DOUBLE) ELSE 0 END, 6) AS volatility, CASE WHEN age_days < 180 THEN 'new' WHEN age_days >= 1095 AND idle_days < 180 THEN 'legacy_hot' WHEN age_days >= 730 AND idle_days >= 180 THEN 'frozen'
 WHEN age_days >= 365 AND idle_days >= 180 THEN 'mature' WHEN idle_days < 90 THEN 'active' ELSE 'mature' END AS category FROM g""",
    "volumetry_risk": """WITH m AS (SELECT l_suppkey AS module, count(*) AS loc, avg(l_quantity) AS complexity, sum(l_quantity) AS volume, count(*) FILTER (l_returnflag = 'R' AND l_discount = 0.1 AND l_quantity >= 49) AS incidents FROM lineitem GROUP BY 1),
p AS (SELECT module, incidents, least(10.0::DOUBLE, loc / 2000::DOUBLE * 10) * 0.25::DOUBLE AS a, least(10.0::DOUBLE, complexity / 60 * 10) * 0.25::DOUBLE AS b, least(10.0::DOUBLE, volume / 40000 * 10) * 0.5::DOUBLE AS c FROM m),
s AS (SELECT *, CASE WHEN incidents > 0 THEN least(10.0::DOUBLE, a + b + c + incidents * 0.5::DOUBLE) ELSE a + b + c END AS r FROM p)
SELECT module, round(r, 6) AS risk_score, CASE WHEN r >= 7 THEN 'CRITICAL' WHEN r >= 5 THEN 'HIGH' WHEN r >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN a >= b AND a >= c THEN 'loc' WHEN b >= c THEN 'complexity' ELSE 'volume' END AS primary_factor FROM s""",
    "stream_activity_windows": """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""",
}
