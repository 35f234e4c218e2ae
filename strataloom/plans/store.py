"""Queries: upserts, counts, text statistics, exports, JSON checks, stems, titles, dangling links, peaks, neighbours in a dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import documents as D
from strataloom.operators import governance as G
from strataloom.operators import metrics as K
from strataloom.operators import store as T
from strataloom.sources.tables import table

from . import sql as S
from .audit import nation_edges


def upserted_items(spark, sf):
    """Customers' balances, changed by their orders; those whose last order failed leave."""
    base = table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"))
    changes = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.round("o_totalprice", 2).alias("balance"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("gone"))
    return T.upserted(base, changes, "c_custkey", "o_orderkey", "gone")


def store_counts(spark, sf):
    return T.counts_by(table(spark, sf, "documents"), ["lang", "source"])


def directory_stats(spark, sf):
    return T.text_statistics(table(spark, sf, "documents").where("source is not null"), ["source"])


def corpus_stats(spark, sf):
    return T.text_statistics(table(spark, sf, "documents"), [])


def json_findings(spark, sf):
    return T.json_findings(table(spark, sf, "events"), "event_id", "props", {"k": "string", "ref": "string"})


def stemmed_terms(spark, sf):
    return T.stemmed_terms(table(spark, sf, "documents"), 50)


def inferred_titles(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(S.MARKDOWN.replace("VARCHAR(9)", "STRING")).alias("text"), "p_brand")
    return rows.select("doc_id", T.title_of(F.col("text"), F.col("p_brand")).alias("title"))


def exported_lines(spark, sf):
    return T.export_lines(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("order at 10.0.0."), (F.col("o_orderkey") % 200).cast("string"), F.lit(" db.internal")).alias("note")), ["o_orderkey", "o_orderstatus"], "note", "S2")


def dangling_links(spark, sf):
    pages = table(spark, sf, "pages")
    return T.dangling(D.links(pages), pages)


def event_peaks(spark, sf):
    return T.peaks(table(spark, sf, "events"), "event_type", "ts", F.lit(1)).withColumns({"mean": F.round("mean", 6), "multiplier": F.round("multiplier", 6)})


def dependencies_of(spark, sf):
    return K.direct_neighbours(nation_edges(spark, sf)).withColumns({c: F.array_join(c, ",") for c in ("dependencies", "dependents")})


def word_frequencies(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


QUERIES = [upserted_items, store_counts, directory_stats, corpus_stats, json_findings, stemmed_terms, inferred_titles, exported_lines, dangling_links, event_peaks, dependencies_of, word_frequencies]

_STATS = r"""WITH t AS (SELECT source, coalesce(text, '') AS t FROM documents), e AS (SELECT source, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS l, CASE WHEN t = '' THEN 0 ELSE len(list_filter(string_split(t, chr(10)), lambda x: trim(x) = '')) END AS b, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS w, length(t) AS c FROM t)
SELECT {} count(*) AS files, sum(l)::BIGINT AS lines, sum(b)::BIGINT AS blank, sum(w)::BIGINT AS words, sum(c)::BIGINT AS chars, max(c)::INT AS longest FROM e {}"""


def _stem() -> str:
    return "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) > {len(s) + 2} THEN left(w, length(w) - {len(s)})" for s in T.SUFFIXES) + " ELSE w END"


def _redact(text: str, tier: str) -> str:
    for k in G.TIERS[tier]:
        text = f"regexp_replace({text}, {S.q(G.REDACT[k][0])}, {S.q(G.REDACT[k][1])}, 'g')"
    return text


_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
SQL = {
    "upserted_items": """WITH c AS (SELECT o_custkey AS c_custkey, round(o_totalprice, 2) AS balance, o_orderstatus = 'F' AS gone FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer ANTI JOIN c USING (c_custkey) UNION ALL SELECT c_custkey, balance FROM c WHERE NOT gone""",
    "store_counts": "SELECT 'lang' AS dimension, coalesce(lang, '(none)') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, '(none)'), count(*) FROM documents GROUP BY 2",
    "directory_stats": _STATS.format("source,", "WHERE source IS NOT NULL GROUP BY 1"),
    "corpus_stats": _STATS.format("", ""),
    "json_findings": f"""WITH f AS (SELECT event_id, CASE WHEN NOT coalesce(json_valid(props), false) THEN ['invalid'] ELSE list_filter([CASE WHEN props->>'$.k' IS NULL THEN 'missing:k' WHEN regexp_matches(props->>'$.k', '{_NUMBER}') THEN 'type:k' END, CASE WHEN props->>'$.ref' IS NULL THEN 'missing:ref' WHEN regexp_matches(props->>'$.ref', '{_NUMBER}') THEN 'type:ref' END], lambda x: x IS NOT NULL) END AS f FROM events) SELECT event_id, unnest(f) AS finding FROM f""",
    "stemmed_terms": f"WITH t AS (SELECT unnest({S.tokens()}) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t GROUP BY 1) SELECT {_stem()} AS stem, count(*) AS words, sum(n)::BIGINT AS uses FROM c GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 50",
    "inferred_titles": f"WITH t AS (SELECT p_partkey AS doc_id, p_brand, list_filter(string_split({S.MARKDOWN}, chr(10))[1:20], lambda x: regexp_matches(trim(x), '^#+\\s+.+')) AS h FROM part) SELECT doc_id, coalesce(trim(regexp_extract(trim(h[1]), '^#+\\s+(.+)', 1)), p_brand) AS title FROM t",
    "exported_lines": f"""WITH t AS (SELECT o_orderkey, o_orderstatus, 'order at 10.0.0.' || (o_orderkey % 200) || ' db.internal' AS note FROM orders) SELECT '{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","note":"' || {_redact('note', 'S2')} || '"}}' AS line FROM t""",
    "dangling_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1)) AS href FROM pages), b AS (SELECT page_id, regexp_replace(href, '#.*$', '') AS target FROM l) SELECT DISTINCT page_id, target FROM b WHERE target <> '' AND target NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)""",
    "event_peaks": """WITH h AS (SELECT event_type, hour(ts)::INT AS hour, count(*) AS v FROM events WHERE ts IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, hour) AS k FROM h)
SELECT event_type, max(hour) FILTER (k = 1) AS peak_hour, max(v)::BIGINT AS peak, round(avg(v), 6) AS mean, round(max(v) / avg(v), 6) AS multiplier FROM r GROUP BY 1""",
    "dependencies_of": f"WITH e AS ({S.NATION_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = node), '') AS dependencies, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE dst = node), '') AS dependents FROM n",
    "word_frequencies": r"WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: length(x) >= 4)) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
}
