"""DuckDB twins of the queries that SQL can express."""

#: Unsigned CRC-32 of the decimal text {0}, bit by bit.
_CRC = """list_reduce(list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT), lambda acc, b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, b)), 4294967295)"""


def crc32(text: str) -> str:
    return f"xor({_CRC.format(text)}, 4294967295)"


def _value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*map(_value, ("doc_id", "source", "lang", "n_chars")), _value(text)]) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUN = "OVER (PARTITION BY tree, depth, idx // 16 ORDER BY idx ROWS BETWEEN {})"


def _nodes(name: str, leaves: str) -> str:
    """All levels of the trees over ``leaves`` (tree, idx, n, digest), each node with its siblings left and right."""
    return f"""{name}_levels(tree, depth, idx, n, digest) AS (
      SELECT tree, 0, idx, n, digest FROM {leaves}
      UNION ALL
      SELECT tree, depth + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name}_levels WHERE n > 1 GROUP BY tree, depth, idx // 16, n
    ), {name}_nodes AS (
      SELECT tree, depth, idx, n, digest, coalesce(string_agg(digest, '') {_RUN.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') AS l,
             coalesce(string_agg(digest, '') {_RUN.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') AS r FROM {name}_levels
    )"""


MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS changed FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, source AS tree, leaf AS digest FROM docs
), {_nodes("inner_", "leaves")}, subroots AS (
  SELECT 0 AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, digest FROM inner__levels WHERE n = 1
), {_nodes("outer_", "subroots")}, climbed(doc_id, tree, leaf, depth, idx, n, node, proof) AS (
  SELECT doc_id, tree, leaf, 0, idx, n, changed, '' FROM leaves
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, c.depth + 1, c.idx // 16, (c.n + 15) // 16, sha256(s.l || c.node || s.r), c.proof || s.l || s.r
  FROM climbed c JOIN inner__nodes s ON s.tree IS NOT DISTINCT FROM c.tree AND s.depth = c.depth AND s.idx = c.idx WHERE c.n > 1
), above(doc_id, leaf, subroot, depth, idx, n, node, proof) AS (
  SELECT c.doc_id, c.leaf, s.digest, 0, s.idx, s.n, c.node, c.proof FROM climbed c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.tree WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.depth + 1, c.idx // 16, (c.n + 15) // 16, sha256(s.l || c.node || s.r), c.proof || s.l || s.r
  FROM above c JOIN outer__nodes s ON s.depth = c.depth AND s.idx = c.idx WHERE c.n > 1
)
SELECT a.doc_id, a.leaf, a.subroot, o.digest AS root, sha256(a.proof) AS proof_sha256, a.node AS folded_root, a.node = o.digest AS verified
FROM above a, (SELECT digest FROM outer__levels WHERE n = 1) o WHERE a.n = 1
"""

_MADE = "CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END"
_COST = "lpad({0}::VARCHAR, 9, '0')"
_AND = "CASE WHEN lines = '' THEN '' ELSE lines || chr(10) END"

#: Ways over the turns: a row for each conversation, turn and state (0 nothing, 1 system, 2 user, 3 assistant) with its least
#: cost, audit and lines. Each turn comes after insertions (none, one, two), then one edit.
REPAIR = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM given, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM damaged
), turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND initial || coalesce(before, '') NOT IN ('us', 'au', 'ua')) AS illegal, count(*) AS n FROM turns GROUP BY conv_id
), ways(conv_id, i, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', '' FROM counted
  UNION ALL
  SELECT conv_id, i, state, min(cost), arg_min(audit, {_COST.format("cost")} || audit), arg_min(lines, {_COST.format("cost")} || audit) FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.to_state AS state, w.cost + e.cost AS cost, w.audit || e.letter AS audit, CASE WHEN e.letter = 'D' THEN w.lines ELSE {_AND.replace("lines", "w.lines")} || e.line END AS lines
    FROM (
      SELECT conv_id, i, state, cost, audit, lines FROM ways
      UNION ALL SELECT conv_id, i, CASE WHEN state = 2 THEN 3 ELSE 2 END, cost + 3, audit || 'I', {_AND} || {_MADE} || ':' FROM ways
      UNION ALL SELECT conv_id, i, 3, cost + 6, audit || 'II', {_AND} || 'user:' || chr(10) || 'assistant:' FROM ways WHERE state IN (0, 1)
    ) w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1, LATERAL (
      SELECT 'D' AS letter, w.state AS to_state, 4 AS cost, '' AS line
      UNION ALL SELECT 'R', CASE WHEN w.state = 2 THEN 3 ELSE 2 END, CASE t.fault WHEN 'truncated' THEN 6 ELSE 3 END, {_MADE.replace("state", "w.state")} || ':' || t.text WHERE t.fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT 'K', CASE t.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE t.fault WHEN 'truncated' THEN 3 ELSE 0 END, t.role || ':' || t.text
        WHERE t.fault NOT IN ('blank', 'duplicate') AND (t.initial = 's' AND w.state = 0 OR t.initial = 'u' AND w.state <> 2 OR t.initial = 'a' AND w.state = 2)
    ) e
  ) GROUP BY conv_id, i, state
), ended AS (
  SELECT w.conv_id, w.cost + 3 * strlen(tail) AS cost, w.audit || tail AS audit,
         CASE WHEN tail = '' THEN w.lines ELSE {_AND.replace("lines", "w.lines")} || CASE tail WHEN 'I' THEN 'assistant:' ELSE 'user:' || chr(10) || 'assistant:' END END AS lines
  FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i, LATERAL (SELECT CASE w.state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END AS tail)
), best AS (
  SELECT conv_id, min(cost) AS cost, arg_min(audit, {_COST.format("cost")} || audit) AS audit, arg_min(lines, {_COST.format("cost")} || audit) AS lines FROM ended GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL = {"op11_merkle": MERKLE, "op12_conversation_repair": REPAIR}
