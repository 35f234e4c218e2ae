"""Queries: versioned memory, drift, recall and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.text import token_estimate
from strataloom.operators import memory as M
from strataloom.sources.tables import table

from . import sql as S


def current_items(spark, sf):
    return M.current(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"])


def item_revisions(spark, sf):
    return M.numbered_revisions(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).withColumn("revision", F.col("revision").cast("int"))


def _corpus(spark, sf, odd):
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    d = table(spark, sf, "documents").where(F.when(number != "", number.cast("int") % 2 == odd))
    rule = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("R"), F.floor(F.col("doc_id") / 2) % 400))
    return d.select(F.col("doc_id").alias("id"), rule.alias("rule_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.col("lang").alias("domain"))


def cross_corpus_drift(spark, sf):
    return M.drift(_corpus(spark, sf, 0), _corpus(spark, sf, 1))


def drift_report(spark, sf):
    return M.drift_report(_corpus(spark, sf, 0), _corpus(spark, sf, 1)).withColumn("drift_pct", F.round("drift_pct", 6))


def changed_files(spark, sf):
    d = table(spark, sf, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    path = F.concat(F.lit("doc/"), F.col("doc_id"))
    stored = d.where("doc_id % 10 != 3").select(F.when(F.col("doc_id") % 13 == 0, F.concat(path, F.lit(".old"))).otherwise(path).alias("path"), F.when(F.col("doc_id") % 11 == 0, F.lit("stale")).otherwise(sha).alias("sha256"))
    return M.changed_files(d.select(path.alias("path"), sha.alias("sha256")), stored)


def budgeted_recall(spark, sf):
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("unknown")).alias("domain"), F.coalesce("n_chars", F.lit(0)).alias("importance"), token_estimate(F.col("text")).alias("tokens"))
    return M.budgeted_recall(items, 60_000).withColumn("rank", F.col("rank").cast("int"))


def query_cycle(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'")
    return M.repeated_queries(turns, "conv_id", "turn", "text", 0.5).select("conv_id", "turn", "reason")


QUERIES = [current_items, item_revisions, cross_corpus_drift, drift_report, changed_files, budgeted_recall, query_cycle]

_CORPUS = """SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN 'R' || ((doc_id // 2) % 400) END AS rule_id, sha256(coalesce(text, '')) AS content_hash, lang AS domain FROM documents WHERE try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 = """
_DRIFT = f"""WITH a AS ({_CORPUS} 0), b AS ({_CORPUS} 1), r AS (SELECT rule_id, min(id) AS id FROM a WHERE rule_id IS NOT NULL GROUP BY 1), h AS (SELECT content_hash, min(id) AS id FROM a GROUP BY 1),
m AS (SELECT b.*, r.id AS rid, h.id AS hid FROM b LEFT JOIN r ON b.rule_id = r.rule_id LEFT JOIN h ON b.content_hash = h.content_hash),
o AS (SELECT CASE WHEN rid IS NULL AND hid IS NULL THEN 'added' WHEN rid IS NULL THEN 'unchanged' WHEN x.content_hash = m.content_hash THEN 'unchanged' ELSE 'modified' END AS status, coalesce(rid, hid) AS id_a, m.id AS id_b, m.domain FROM m LEFT JOIN a x ON x.id = m.rid),
d AS (SELECT * FROM o UNION ALL SELECT 'removed', id, NULL, domain FROM a WHERE id NOT IN (SELECT id_a FROM o WHERE id_a IS NOT NULL))"""
SQL = {
    "current_items": "SELECT user_id, ts, event_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "item_revisions": "SELECT o_custkey, o_orderkey, o_orderdate, (row_number() OVER w)::INT AS revision, lead(true, 1, false) OVER w AS superseded FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "cross_corpus_drift": f"{_DRIFT} SELECT * FROM d",
    "drift_report": f"{_DRIFT}, c AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged FROM d) SELECT *, round((added + removed + modified) / greatest((SELECT count(*) FROM a), (SELECT count(*) FROM b), 1)::DOUBLE * 100, 6) AS drift_pct FROM c",
    "changed_files": """WITH n AS (SELECT 'doc/' || doc_id AS path, sha256(coalesce(text, '')) AS now FROM documents), w AS (SELECT 'doc/' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.old' ELSE '' END AS path, CASE WHEN doc_id % 11 = 0 THEN 'stale' ELSE sha256(coalesce(text, '')) END AS was FROM documents WHERE doc_id % 10 <> 3)
SELECT path, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'deleted' WHEN now = was THEN 'unchanged' ELSE 'modified' END AS status FROM n FULL JOIN w USING (path)""",
    "budgeted_recall": """WITH i AS (SELECT doc_id AS id, coalesce(lang, 'unknown') AS domain, coalesce(n_chars, 0) AS importance, length(coalesce(text, '')) // 4 AS tokens FROM documents),
s AS (SELECT domain, count(*) AS n FROM i GROUP BY 1), qs AS (SELECT domain, n, least(n, greatest(3, least(25, floor(n / (SELECT sum(n) FROM s)::DOUBLE * 750)))) AS quota FROM s),
r AS (SELECT i.*, row_number() OVER (PARTITION BY domain ORDER BY importance DESC, id) AS rank FROM i), b AS (SELECT r.*, n FROM r JOIN qs USING (domain) WHERE rank <= quota),
z AS (SELECT *, sum(tokens) OVER (ORDER BY n, domain, rank) AS spent FROM b) SELECT domain, rank::INT AS rank, id, tokens FROM z WHERE spent <= 60000""",
    "query_cycle": f"""WITH t AS (SELECT conv_id, turn, text, {S.normalized()} AS nt, list_distinct({S.words()}) AS ws FROM conversations WHERE role = 'user'),
l AS (SELECT *, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS pw, row_number() OVER (PARTITION BY conv_id, nt ORDER BY turn) AS k FROM t)
SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN k > 1 THEN 'repeat' WHEN pw IS NOT NULL AND CASE WHEN len(ws) = 0 AND len(pw) = 0 THEN 1.0 ELSE len(list_intersect(ws, pw)) / (len(ws) + len(pw) - len(list_intersect(ws, pw)))::DOUBLE END >= 0.5 THEN 'similar' END AS reason FROM l""",
}
