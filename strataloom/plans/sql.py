"""Pieces of DuckDB SQL that several twins share."""

from __future__ import annotations

from strataloom.functions.text import STOP_WORDS


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def tokens(text: str = "text", least: int = 2) -> str:
    stop = ", ".join(map(q, STOP_WORDS))
    cut = rf"regexp_split_to_array(lower(regexp_replace(coalesce({text}, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+')"
    return rf"list_filter({cut}, lambda x: length(x) >= {least} AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({stop}))"


def normalized(text: str = "text") -> str:
    bare = rf"regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_ \t\n\r\f]', '', 'g')"
    return rf"trim(regexp_replace({bare}, '[ \t\n\r\f]+', ' ', 'g'))"


def words(text: str = "text") -> str:
    return f"list_filter(string_split({normalized(text)}, ' '), lambda x: x <> '')"


def keyword_list(terms: list[str], k: int) -> str:
    """CTEs ending in kw (doc_id, score, rank)."""
    return f"""
kt AS (SELECT doc_id, {tokens()} AS t FROM documents),
kf AS (SELECT count(*) AS n, avg(len(t)) AS av FROM kt),
kq AS (SELECT w, count(*) AS c FROM (SELECT unnest([{', '.join(map(q, terms))}]) AS w) GROUP BY w),
km AS (SELECT doc_id, w, c, len(t) AS dl, len(list_filter(t, lambda x: x = w)) AS tf FROM kt, kq),
kd AS (SELECT w, count(*) AS df FROM km WHERE tf > 0 GROUP BY w),
ks AS (SELECT doc_id, sum(c * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / av))) AS score FROM km JOIN kd USING (w), kf WHERE tf > 0 GROUP BY doc_id),
kw AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ks QUALIFY rank <= {k})"""


def vector_list(query_id: int, k: int) -> str:
    """CTEs ending in vec (doc_id, score, rank)."""
    return f"""
vs AS (SELECT a.vec_id AS doc_id, coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {query_id} AND a.embedding IS NOT NULL),
vec AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= {k})"""


#: What the customers of each nation buy from the suppliers of each.
NATION_WEIGHTS = """SELECT cn.n_name AS src, sn.n_name AS dst, sum(l_quantity) AS weight FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2"""
#: The dependency graph of nations: pairs above the mean of all pairs; and of each nation its largest one.
NATION_EDGES = f"SELECT src, dst FROM ({NATION_WEIGHTS}) QUALIFY weight > avg(weight) OVER ()"
MAIN_EDGES = f"SELECT src, dst FROM ({NATION_WEIGHTS}) QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) = 1"


#: A Markdown text for every part, in SQL that both engines read.
MARKDOWN = """'---' || chr(10) || 'title: ' || p_name || chr(10) || 'brand: ' || p_brand || chr(10) || '---' || chr(10) || '# ' || p_name || chr(10) || chr(10)
|| 'See Figure ' || CAST(p_size % 4 + 1 AS VARCHAR(9)) || ' and Table 2.' || chr(10) || 'Figure 1: ' || p_type || chr(10) || 'Figure 3: ' || p_brand || ', not Figure 3' || chr(10) || chr(10)
|| '## Sizes & **Prices**, `' || p_brand || '`' || chr(10) || '| size | price |' || chr(10) || '|---|---|' || chr(10) || repeat('| ' || CAST(p_size AS VARCHAR(9)) || ' | 10 |' || chr(10), CAST(p_size % 6 AS INT))
|| '- ' || p_type || chr(10) || '1. one' || chr(10) || '> quoted ' || p_brand || chr(10) || '```' || chr(10) || '# not a heading F' || lpad(CAST(p_partkey AS VARCHAR(9)), 6, '0') || chr(10) || '```' || chr(10)
|| '## ' || p_name || chr(10) || 'total: ' || CAST(p_size AS VARCHAR(9)) || ' in /home/' || lower(substr(p_brand, 1, 5)) || '/x run_20240101_120000_ab for model ' || CAST(p_size AS VARCHAR(9)) || chr(10) || '#### Deep [link](http://x) ' || CAST(p_size AS VARCHAR(9))"""
