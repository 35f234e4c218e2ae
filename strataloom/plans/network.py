"""Queries: firewall rules and findings, protected spans, address tags, gaps, densities, work left, lineage, files of concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import documents as D
from strataloom.operators import graph as G
from strataloom.operators import network as N
from strataloom.sources.tables import table

from . import documents
from . import sql as S
from .audit import main_edges

#: An iptables line for every order line, in SQL that both engines read.
_LINE = """CASE WHEN l_linenumber = 1 THEN ':' || CASE WHEN l_suppkey % 2 = 0 THEN 'INPUT' ELSE 'OUTPUT' END || CASE WHEN l_suppkey % 3 = 0 THEN ' ACCEPT' ELSE ' DROP' END || ' [0:0]' WHEN l_linenumber = 2 THEN '# comment'
ELSE '  -A INPUT' || CASE WHEN l_quantity > 25 THEN ' -s 10.0.0.0/8' ELSE '' END || CASE WHEN l_quantity < 10 THEN ' -d 10.1.1.1' ELSE '' END || ' -p tcp --dport ' || CASE WHEN l_quantity < 20 THEN '23' WHEN l_quantity < 30 THEN '3306:3307' ELSE '443' END || ' -j ' || CASE WHEN l_returnflag = 'R' THEN 'DROP' ELSE 'ACCEPT' END END"""
CODE = r"`[^`]+`|\[[^\]]+\]\([^)]+\)"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.expr(_LINE).alias("content"))


def firewall_rules(spark, sf):
    return N.firewall_rules(_lines(spark, sf))


def firewall_findings(spark, sf):
    return N.rule_findings(N.firewall_rules(_lines(spark, sf)))


def protected_spans(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(S.MARKDOWN.replace("VARCHAR(9)", "STRING")).alias("raw")).withColumn("p", N.protected(F.col("raw"), CODE))
    return rows.select("doc_id", F.size("p.spans").alias("spans"), F.sha2("p.text", 256).alias("sha256"), (N.restored(F.col("p.text"), F.col("p.spans")) == F.col("raw")).alias("same"))


def address_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(N.address_tags(F.col("url"))).alias("tag"))


def event_gaps(spark, sf):
    return N.gaps(table(spark, sf, "events"), "event_type", "ts", 3600)


def density_heatmap(spark, sf):
    return N.density(table(spark, sf, "documents"), "source", "lang").withColumns({c: F.round(c, 6) for c in ("of_row", "of_all")})


def pending_chunks(spark, sf):
    done = table(spark, sf, "labels").select("doc_id")
    return N.pending(table(spark, sf, "documents").select("doc_id", "source"), done, "doc_id")


def session_turns(spark, sf):
    """Turns, roles and characters of each conversation, and whether it is over eight turns."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return t.withColumn("over", F.col("turns") > 8)


def metric_totals(spark, sf):
    out = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))
    return out.withColumns({c: F.round(c, 4) for c in ("total", "least", "most", "mean")})


def lineage(spark, sf):
    """What each nation's main supplies come from, over all steps."""
    return G.reachable(main_edges(spark, sf))


def concept_files(spark, sf):
    docs = table(spark, sf, "documents")
    return D.mentions(docs, D.concepts(docs, 20)).select("concept", "doc_id")


QUERIES = [firewall_rules, firewall_findings, protected_spans, address_tags, event_gaps, density_heatmap, pending_chunks, session_turns, metric_totals, lineage, concept_files]

_OPTION = lambda o: f"coalesce(nullif(regexp_extract(c, '(?:^|\\s){o}\\s+(\\S+)', 1), ''), 'any')"
_RULES = rf"""l AS (SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS line, trim({_LINE}) AS c FROM lineitem), r AS (SELECT *, CASE WHEN starts_with(c, ':') THEN 'policy' ELSE 'rule' END AS type FROM l WHERE starts_with(c, ':') OR starts_with(c, '-A')),
x AS (SELECT file, line, type, CASE type WHEN 'rule' THEN regexp_extract(c, '^-A\s+(\S+)', 1) ELSE regexp_extract(c, '^:(\S+)', 1) END AS chain, CASE type WHEN 'rule' THEN {_OPTION('-s')} ELSE 'any' END AS source, CASE type WHEN 'rule' THEN {_OPTION('-d')} ELSE 'any' END AS destination, CASE type WHEN 'rule' THEN {_OPTION('-p')} ELSE 'any' END AS protocol,
 CASE type WHEN 'rule' THEN nullif(regexp_extract(c, '(?:^|\s)--dport\s+(\S+)', 1), '') END AS port, CASE WHEN CASE type WHEN 'rule' THEN regexp_extract(c, '(?:^|\s)-j\s+(\S+)', 1) IN ('DROP', 'REJECT') ELSE regexp_extract(c, '^:\S+\s+(\S+)', 1) = 'DROP' END THEN 'deny' ELSE 'permit' END AS action FROM r)"""
_PORTS = "(VALUES " + ", ".join(f"({p}, '{s}', '{v}')" for p, (s, v) in N.PORTS.items()) + ") AS d(number, service, severity)"
_MARK = chr(0x2999)
SQL = {
    "firewall_rules": f"WITH {_RULES} SELECT * FROM x",
    "firewall_findings": f"""WITH {_RULES}, o AS (SELECT * FROM x WHERE type = 'rule' AND action = 'permit') SELECT file, line, 'any_to_any' AS finding, 'high' AS severity FROM o WHERE source = 'any' AND destination = 'any'
UNION ALL SELECT file, line, 'port:' || service, severity FROM o JOIN {_PORTS} ON number = try_cast(regexp_extract(port, '^([0-9]+)', 1) AS INT)
UNION ALL SELECT file, 0, 'no_default_deny', 'medium' FROM x WHERE type = 'policy' GROUP BY file HAVING NOT bool_or(action = 'deny' AND chain IN ('INPUT', 'FORWARD'))""",
    "protected_spans": f"""WITH t AS (SELECT p_partkey AS doc_id, {S.MARKDOWN} AS raw FROM part), p AS (SELECT doc_id, regexp_extract_all(raw, {S.q(CODE)}) AS s, regexp_split_to_array(raw, {S.q(CODE)}) AS l FROM t)
SELECT doc_id, len(s)::INT AS spans, sha256(array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN x ELSE '{_MARK}' || (i - 1) || '{_MARK}' || x END), '')) AS sha256, true AS same FROM p""",
    "address_tags": r"""WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS p FROM pages), t AS (SELECT page_id, lower(regexp_extract(p, '\.([A-Za-z0-9]+)$', 1)) AS e, list_filter(regexp_split_to_array(lower(regexp_replace(p, '\.[A-Za-z0-9]+$', '')), '[/_.-]+'), lambda x: regexp_matches(x, '^[a-z]{3,}$')) AS w FROM p)
SELECT page_id, unnest(list_distinct(list_concat(CASE WHEN e <> '' THEN [e] ELSE [] END, w))) AS tag FROM t""",
    "event_gaps": "WITH g AS (SELECT event_type, ts AS start, (floor(epoch(lead(ts) OVER (PARTITION BY event_type ORDER BY ts))) - floor(epoch(ts)))::BIGINT AS seconds FROM events WHERE ts IS NOT NULL) SELECT * FROM g WHERE seconds > 3600",
    "density_heatmap": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source)::DOUBLE, 6) AS of_row, round(n / max(n) OVER ()::DOUBLE, 6) AS of_all FROM c",
    "pending_chunks": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "session_turns": "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(coalesce(text, '')))::BIGINT AS chars, count(*) > 8 AS over FROM conversations GROUP BY 1",
    "metric_totals": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean FROM events GROUP BY 1",
    "lineage": f"WITH RECURSIVE e AS ({S.MAIN_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r",
    "concept_files": f"WITH {documents._concepts(20)} SELECT concept, doc_id FROM m SEMI JOIN c USING (concept)",
}
