"""Queries: Markdown structure, findings, sanitizing and searches, over a Markdown text of every part and over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import markdown as M
from strataloom.operators import sanitize as Z
from strataloom.sources.tables import table

from . import sql as S

WORD = r"[A-Za-z]+tion[a-z]*"


def _texts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(S.MARKDOWN.replace("VARCHAR(9)", "STRING")).alias("text"))


def md_headings(spark, sf):
    return M.headings(_texts(spark, sf))


def md_contents(spark, sf):
    return M.contents(_texts(spark, sf))


def md_sections(spark, sf):
    return M.sections(_texts(spark, sf))


def md_code_blocks(spark, sf):
    return M.code_blocks(_texts(spark, sf))


def md_fingerprints(spark, sf):
    return M.fingerprints(_texts(spark, sf)).withColumn("digits", F.round("digits", 6))


def md_numbering(spark, sf):
    return M.numbering_findings(_texts(spark, sf), "Figure")


def md_front_matter(spark, sf):
    return M.front_matter(_texts(spark, sf))


def paragraph_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(M.paragraph_chunks(F.col("text"), 200)).alias("chunk", "content"))
    return rows.select("doc_id", "chunk", F.length("content").alias("chars"), F.sha2("content", 256).alias("sha256"))


def external_texts(spark, sf):
    return Z.sanitized(_texts(spark, sf)).select("doc_id", "paths", "ids", "stripped", F.sha2("content", 256).alias("sha256"))


def denied_keys(spark, sf):
    return Z.denied_keys(_texts(spark, sf))


def metrics_view(spark, sf):
    return _texts(spark, sf).select("doc_id", Z.metrics_only(F.col("text")).alias("content"))


def line_search(spark, sf):
    return Z.matching_lines(table(spark, sf, "documents"), WORD).select("doc_id", "line", "matches", F.length("content").alias("chars"))


def pattern_replace(spark, sf):
    return Z.replaced(table(spark, sf, "documents"), WORD, "<$0>").select("doc_id", "replacements", F.sha2("content", 256).alias("sha256"))


QUERIES = [md_headings, md_contents, md_sections, md_code_blocks, md_fingerprints, md_numbering, md_front_matter, paragraph_chunks, external_texts, denied_keys, metrics_view, line_search, pattern_replace]

_NL = "chr(10)"
_LINES = f"""t AS (SELECT p_partkey AS doc_id, {S.MARKDOWN} AS text FROM part), s AS (SELECT doc_id, string_split(text, {_NL}) AS l FROM t),
x AS (SELECT doc_id, generate_subscripts(l, 1)::INT AS line, unnest(l) AS content FROM s),
f AS (SELECT *, regexp_matches(content, {S.q(M.FENCE)})::INT AS fence FROM x), g AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY line) AS k FROM f),
n AS (SELECT *, k % 2 = 1 OR fence = 1 AS fenced FROM g),
h AS (SELECT doc_id, line, content, length(regexp_extract(content, {S.q(M.HEADING)}, 1))::INT AS level, trim(regexp_extract(content, {S.q(M.HEADING)}, 2)) AS title FROM n WHERE NOT fenced AND regexp_matches(content, {S.q(M.HEADING)}))"""


def _slug(title: str) -> str:
    for pattern, to in M.INLINE:
        title = f"regexp_replace({title}, {S.q(pattern)}, {S.q(to.replace('$', chr(92)))}, 'g')"
    bare = rf"regexp_replace(trim(lower({title})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g')"
    return rf"regexp_replace(regexp_replace({bare}, '\s+', '-', 'g'), '-+', '-', 'g')"


def _count(pattern: str) -> str:
    return f"len(list_filter(l, lambda x: regexp_matches(x, {S.q(pattern)})))::INT"


def _clean() -> str:
    text = "text"
    for p in Z.METADATA:
        text = f"regexp_replace({text}, {S.q(p)}, '', 'g')"
    return text


def _paths() -> tuple[str, str]:
    text, counts = "bare", []
    for p in Z.PATHS:
        counts.append(f"len(regexp_extract_all({text}, {S.q(p)}))")
        text = f"regexp_replace({text}, {S.q(p)}, '[PATH]/', 'g')"
    return text, " + ".join(counts)


_ROW, _SEP = S.q(M.TABLE_ROW), S.q(M.TABLE_SEPARATOR)
SQL = {
    "md_headings": f"WITH {_LINES} SELECT doc_id, line, level, title, {_slug('title')} AS anchor FROM h",
    "md_contents": f"""WITH {_LINES}, a AS (SELECT *, {_slug('title')} AS anchor FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY line) - 1 AS again FROM a)
SELECT doc_id, string_agg(repeat('  ', level - 1) || '- [' || title || '](#' || CASE WHEN again > 0 THEN anchor || '-' || again ELSE anchor END || ')', {_NL} ORDER BY line) AS toc FROM b WHERE level <= 3 GROUP BY 1""",
    "md_sections": f"""WITH {_LINES}, m AS (SELECT n.*, h.title, sum((h.line IS NOT NULL)::INT) OVER (PARTITION BY n.doc_id ORDER BY n.line) AS section FROM n LEFT JOIN h ON n.doc_id = h.doc_id AND n.line = h.line)
SELECT doc_id, section::BIGINT AS section, coalesce(max(title), '') AS title, min(line) AS first_line, count(*) AS lines, sum(length(content) + 1)::BIGINT AS chars FROM m GROUP BY 1, 2""",
    "md_code_blocks": f"WITH {_LINES}, b AS (SELECT *, CASE WHEN fence = 1 AND k % 2 = 0 THEN k // 2 ELSE (k + 1) // 2 END AS block FROM n WHERE fenced) SELECT doc_id, block::BIGINT AS block, min(line) AS first_line, (count(*) - sum(fence))::BIGINT AS lines FROM b GROUP BY 1, 2 HAVING sum(fence) = 2",
    "md_fingerprints": f"""WITH {_LINES}, p AS (SELECT *, regexp_matches(content, {_ROW}) OR regexp_matches(content, {_SEP}) AS tab FROM x), b AS (SELECT doc_id, count(*) FILTER (tab AND NOT coalesce(was, false)) AS tables FROM (SELECT *, lag(tab) OVER (PARTITION BY doc_id ORDER BY line) AS was FROM p) GROUP BY 1)
SELECT s.doc_id, len(l)::INT AS lines, list_max(list_transform(l, lambda x: length(x)))::INT AS longest, {_count(M.BULLET)} AS bullets, {_count(M.QUOTE)} AS quotes, len(list_filter(l, lambda x: regexp_matches(x, {_ROW}) AND NOT regexp_matches(x, {_SEP})))::INT AS table_rows, tables::INT AS tables, ({_count(M.FENCE)} // 2)::BIGINT AS fences,
 round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g'))::DOUBLE, 6) AS digits FROM s JOIN t USING (doc_id) JOIN b USING (doc_id)""".replace("\\\\s", "\\s"),
    "md_numbering": rf"""WITH {_LINES}, o AS (SELECT doc_id, content, unnest(regexp_extract_all(content, '(?i)\bFigure\s+([0-9]+)', 1)) AS number FROM x),
c AS (SELECT doc_id, number::INT AS number, count(*) AS n, bool_or(regexp_extract(content, '(?i)^Figure\s+([0-9]+):', 1) = number) AS defined FROM o GROUP BY 1, 2),
w AS (SELECT doc_id, unnest(range(1, max(number) + 1))::INT AS number FROM c GROUP BY 1)
SELECT doc_id, 'duplicate' AS finding, number FROM c WHERE n > 2 UNION ALL SELECT doc_id, 'broken_reference', number FROM c WHERE NOT defined UNION ALL SELECT doc_id, 'gap', number FROM w ANTI JOIN c USING (doc_id, number)""",
    "md_front_matter": rf"WITH {_LINES}, m AS (SELECT doc_id, unnest(string_split(regexp_extract(text, '(?s)^---\n(.*?)\n---\n', 1), {_NL})) AS l FROM t) SELECT doc_id, regexp_extract(l, '^([^:]+):', 1) AS key, trim(regexp_extract(l, '^[^:]+:(.*)$', 1)) AS value FROM m WHERE regexp_matches(l, '^[A-Za-z_][A-Za-z0-9_-]*:')",
    "external_texts": f"""WITH {_LINES}, a AS (SELECT doc_id, text, {_clean()} AS bare FROM t), b AS (SELECT *, {_paths()[0]} AS p, {_paths()[1]} AS paths FROM a),
c AS (SELECT *, list_sort(list_distinct(regexp_extract_all(p, {S.q(Z.FILE_ID)}))) AS i, len(list_distinct(regexp_extract_all(p, {S.q(Z.RUN_ID)}))) + len(list_distinct(regexp_extract_all(p, {S.q(Z.LONG_HASH)}))) AS other FROM b),
d AS (SELECT *, CASE WHEN len(i) > 0 THEN replace(p, i[1], '[DOC-A]') ELSE p END AS q FROM c)
SELECT doc_id, paths::BIGINT AS paths, (len(i) + other)::BIGINT AS ids, length(bare) < length(text) AS stripped, sha256(regexp_replace(regexp_replace(q, {S.q(Z.RUN_ID)}, '[RUN-ID]', 'g'), {S.q(Z.LONG_HASH)}, '[HASH]', 'g')) AS sha256 FROM d""",
    "denied_keys": "WITH " + _LINES + ", k AS (SELECT unnest([" + ", ".join(map(S.q, Z.DENIED)) + r"]) AS key) SELECT doc_id, key FROM t, k WHERE regexp_matches(text, '(?i)\b' || key || '\b')",
    "metrics_view": f"WITH {_LINES} SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda x: starts_with(x, '#') OR (contains(x, '|') AND (regexp_matches(x, {S.q(Z.METRIC_TABLE)}) OR regexp_matches(x, {S.q(Z.METRIC_RULE)}))) OR regexp_matches(x, {S.q(Z.METRIC)})), {_NL}), '') AS content FROM s",
    "line_search": f"WITH s AS (SELECT doc_id, string_split(text, {_NL}) AS l FROM documents), x AS (SELECT doc_id, generate_subscripts(l, 1)::INT AS line, unnest(l) AS content FROM s) SELECT doc_id, line, len(regexp_extract_all(content, {S.q(WORD)}))::INT AS matches, length(content)::INT AS chars FROM x WHERE regexp_matches(content, {S.q(WORD)})",
    "pattern_replace": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {S.q(WORD)}))::INT AS replacements, sha256(regexp_replace(coalesce(text, ''), {S.q(WORD)}, '<\\0>', 'g')) AS sha256 FROM documents",
}
