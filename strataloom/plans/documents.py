"""Queries: document analytics and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.text import sentence_chunks as chunks_of
from strataloom.operators import documents as D
from strataloom.operators import governance as G
from strataloom.sources.tables import table

from . import sql as S


def top_concepts(spark, sf):
    return D.concepts(table(spark, sf, "documents"), 20)


def concept_cooccurrence(spark, sf):
    docs = table(spark, sf, "documents")
    return D.cooccurrence(docs, D.concepts(docs, 20))


def coverage_gaps(spark, sf):
    docs = table(spark, sf, "documents").where("source is not null")
    return D.coverage_gaps(docs, D.concepts(docs, 200), "source")


def duplicate_paragraphs(spark, sf):
    return D.repeated_parts(table(spark, sf, "documents"), D.PARAGRAPHS)


def repeated_lines(spark, sf):
    return D.repeated_parts(table(spark, sf, "documents"), D.LINES)


def near_duplicates_jaccard(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return D.similar_pairs(docs, 0.8).withColumn("similarity", F.round("similarity", 6))


def page_links(spark, sf):
    return D.links(table(spark, sf, "pages"))


def link_hosts(spark, sf):
    host = F.regexp_extract("href", "^https?://([^/?#]+)", 1)
    return D.links(table(spark, sf, "pages")).groupBy(F.when(host == "", "(local)").otherwise(host).alias("host")).agg(F.count("*").alias("links"))


def benchmark_overlap(spark, sf):
    return D.overlap(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 8).withColumn("share", F.round("share", 6))


def doc_quality(spark, sf):
    out = D.linguistic_quality(table(spark, sf, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("lexical", "regularity", "completeness", "quality")})


def sentence_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks_of(F.col("text"), 1000, 100)).alias("chunk", "content"))
    return rows.select("doc_id", "chunk", F.length("content").alias("chars"), F.sha2("content", 256).alias("sha256"))


def best_sentences(spark, sf):
    docs = table(spark, sf, "documents")
    return D.best_sentences(docs, D.concepts(docs, 20))


def pii_detect_counts(spark, sf):
    return G.entity_counts(table(spark, sf, "documents"))


def secret_policy(spark, sf):
    return G.policy(table(spark, sf, "documents"))


def redact_s0(spark, sf):
    return G.redacted(table(spark, sf, "documents"), "S0").select("doc_id", "changes", F.sha2("text", 256).alias("text_sha256"))


def redact_s2(spark, sf):
    return G.redacted(table(spark, sf, "documents"), "S2").select("doc_id", "changes", F.sha2("text", 256).alias("text_sha256"))


QUERIES = [top_concepts, concept_cooccurrence, coverage_gaps, duplicate_paragraphs, repeated_lines, near_duplicates_jaccard, page_links, link_hosts, benchmark_overlap, doc_quality, sentence_chunks, best_sentences, pii_detect_counts, secret_policy, redact_s0, redact_s2]


def _concepts(k: int, where: str = "") -> str:
    return f"m AS (SELECT doc_id, source, unnest(list_distinct({S.tokens(least=4)})) AS concept FROM documents {where}), c AS (SELECT concept, count(*) AS documents FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k})"


def _repeated(cut: str) -> str:
    part = f"regexp_split_to_array(coalesce(text, ''), '{cut}')"
    bare = r"regexp_replace(part, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
    return rf"""WITH p AS (SELECT doc_id, unnest({part}) AS part, generate_subscripts({part}, 1) AS pos FROM documents),
h AS (SELECT md5(regexp_replace(lower({bare}), '[ \t\n\r\f]+', ' ', 'g')) AS hash, doc_id, pos FROM p WHERE length({bare}) > 40),
g AS (SELECT *, count(*) OVER (PARTITION BY hash) AS copies, row_number() OVER (PARTITION BY hash ORDER BY doc_id, pos) AS k FROM h)
SELECT hash, copies, doc_id, pos::INT AS part FROM g WHERE k = 1 AND copies > 1"""


def _redacted(tier: str) -> str:
    t = "coalesce(text, '')"
    for k in G.TIERS[tier]:
        t = f"regexp_replace({t}, {S.q(G.REDACT[k][0])}, {S.q(G.REDACT[k][1])}, 'g')"
    marks = " + ".join(f"len(regexp_extract_all(t, {S.q(chr(92) + G.REDACT[k][1][:-1] + chr(92) + ']')}))" for k in G.TIERS[tier])
    return f"WITH r AS (SELECT doc_id, {t} AS t FROM documents) SELECT doc_id, ({marks})::BIGINT AS changes, sha256(t) AS text_sha256 FROM r"


_SHINGLES = "list_distinct([array_to_string(w[i:i+7], ' ') for i in range(1, len(w) - 6)])"
_LINKS = """WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1) AS h FROM pages), x AS (SELECT page_id, (generate_subscripts(h, 1) - 1)::INT AS pos, unnest(h) AS href FROM l)"""
_REASONS = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), {S.q('(?i)' + p)}) THEN '{g}:{n}' END" for g, many in G.RULES.items() for n, p in many.items())
SQL = {
    "top_concepts": f"WITH {_concepts(20)} SELECT * FROM c",
    "concept_cooccurrence": f"WITH {_concepts(20)}, k AS (SELECT doc_id, concept FROM m SEMI JOIN c USING (concept)) SELECT x.concept AS a, y.concept AS b, count(*) AS documents FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.concept < y.concept GROUP BY 1, 2",
    "coverage_gaps": f"WITH {_concepts(200, 'WHERE source IS NOT NULL')}, s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) SELECT source, concept FROM s, c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source = s.source AND m.concept = c.concept)",
    "duplicate_paragraphs": _repeated(D.PARAGRAPHS),
    "repeated_lines": _repeated(D.LINES),
    "near_duplicates_jaccard": f"""WITH t AS (SELECT min(doc_id) AS id, ws, len(ws) AS n FROM (SELECT doc_id, list_sort(list_distinct({S.words()})) AS ws FROM documents) WHERE len(ws) > 0 GROUP BY ws),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.ws, b.ws)) AS i, a.n + b.n AS n FROM t a JOIN t b ON a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n) SELECT a, b, round(i / (n - i)::DOUBLE, 6) AS similarity FROM p WHERE i / (n - i)::DOUBLE >= 0.8""",
    "page_links": f"{_LINKS} SELECT page_id, pos, href FROM x",
    "link_hosts": f"{_LINKS} SELECT CASE WHEN regexp_extract(href, '^https?://([^/?#]+)', 1) = '' THEN '(local)' ELSE regexp_extract(href, '^https?://([^/?#]+)', 1) END AS host, count(*) AS links FROM x GROUP BY 1",
    "benchmark_overlap": f"""WITH dw AS (SELECT doc_id, {S.words()} AS w FROM documents), iw AS (SELECT item_id, {S.words()} AS w FROM benchmark), d AS (SELECT doc_id, unnest({_SHINGLES}) AS g FROM dw), i AS (SELECT item_id, {_SHINGLES} AS s FROM iw), r AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM i)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n)::DOUBLE, 6) AS share FROM d JOIN r USING (g) GROUP BY 1, 2""",
    "doc_quality": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w,
 list_transform(list_filter(list_transform(regexp_split_to_array(t, '[.!?]+[ \t\n\r\f]+'), lambda s: regexp_replace(s, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda s: length(s) > 10), lambda s: length(s)::DOUBLE) AS l, regexp_replace(t, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS t FROM t),
f AS (SELECT doc_id, len(w)::INT AS words, CASE WHEN len(w) > 0 THEN least(1.0::DOUBLE, len(list_distinct(w)) / len(w)::DOUBLE / 0.6::DOUBLE) ELSE 0 END AS lexical, CASE WHEN len(l) > 1 THEN greatest(0::DOUBLE, 1 - list_aggregate(l, 'stddev_pop') / list_avg(l) * 0.5::DOUBLE) ELSE 0.5 END AS regularity,
 greatest(0::DOUBLE, 1 - CASE WHEN regexp_matches(t, '^\p{Ll}') THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?:;"'']$') THEN 0.1::DOUBLE ELSE 0 END) AS completeness FROM x)
SELECT doc_id, words, round(lexical, 6) AS lexical, round(regularity, 6) AS regularity, round(completeness, 6) AS completeness, round(CASE WHEN words < 10 THEN 0.3::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, 0.3::DOUBLE * lexical + 0.25::DOUBLE * regularity + 0.45::DOUBLE * completeness)) END, 6) AS quality FROM f""",
    "best_sentences": rf"""WITH {_concepts(20)}, p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents),
x AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS s FROM p), k AS (SELECT list(concept) AS k FROM c), h AS (SELECT doc_id, pos, len(list_intersect(list_distinct({S.tokens("s")}), k))::INT AS hits FROM x, k)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos))::INT AS rank, pos, hits FROM h WHERE hits > 0 QUALIFY rank <= 3""",
    "pii_detect_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), {S.q(p)}))::BIGINT AS n_{k}" for k, p in G.ENTITY.items()) + " FROM documents",
    "secret_policy": f"WITH r AS (SELECT doc_id, list_filter([{_REASONS}, CASE WHEN length(coalesce(text, '')) > 8000 THEN 'too_long' END], lambda x: x IS NOT NULL) AS r FROM documents) SELECT doc_id, CASE WHEN len(list_filter(r, lambda x: NOT starts_with(x, 'quarantine:'))) > 0 THEN 'reject' WHEN len(r) > 0 THEN 'quarantine' ELSE 'accept' END AS action, coalesce(array_to_string(r, ','), '') AS reasons FROM r",
    "redact_s0": _redacted("S0"),
    "redact_s2": _redacted("S2"),
}
