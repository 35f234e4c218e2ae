"""Differences between versions: shortest scripts of line edits, and paths of JSON values."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.sources.tables import Cuts, written

_HUNK = "array<struct<old_start:int,old_lines:array<string>,new_start:int,new_lines:array<string>>>"


def lines_of(text: str | None) -> list[str]:
    """Lines with their ends, so that joined they are the text."""
    out, at, text = [], 0, text or ""
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append(text[at:end])
        at = end
    return out


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising run of ``values``."""
    ends, last, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        before[i] = last[k - 1] if k else -1
        ends[k : k + 1], last[k : k + 1] = [v], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _middle(a: list, b: list) -> tuple[int, int, int]:
    """(edits, x, y): a shortest script's length and a place half-way along it, from both ends in linear space."""
    n, m = len(a), len(b)
    front, back, odd = {1: 0}, {1: 0}, (n - m) % 2
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = front.get(k + 1, -1) if k == -d or (k != d and front.get(k - 1, -1) < front.get(k + 1, -1)) else front.get(k - 1, -1) + 1
            at = x
            while x < n and 0 <= x - k < m and a[x] == b[x - k]:
                x += 1
            front[k] = x
            if odd and abs(n - m - k) < d and x + back.get(n - m - k, -1) >= n:
                return 2 * d - 1, at, at - k
        for k in range(-d, d + 1, 2):
            x = back.get(k + 1, -1) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back.get(k - 1, -1) + 1
            while x < n and 0 <= x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                x += 1
            back[k] = x
            if not odd and abs(n - m - k) <= d and x + front.get(n - m - k, -1) >= n:
                return 2 * d, n - x, m - x + k
    raise AssertionError("the ways from both ends meet")


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in order."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        edits, x, y = _middle(a[i:j], b[k:m])
        if edits > 1 and (x, y) not in ((0, 0), (j - i, m - k)):
            todo += [(i, i + x, k, k + y), (i + x, j, k + y, m)]
        else:  # one line more on one side, or no way on: what is left of the shorter side is looked for in order
            short, long_ = (range(i, j), range(k, m)) if j - i <= m - k else (range(k, m), range(i, j))
            at = 0
            for s in short:
                same = next((t for t in long_[at:] if (a[s] == b[t] if j - i <= m - k else a[t] == b[s])), None)
                if same is not None:
                    found.append((s, same) if j - i <= m - k else (same, s))
                    at = long_.index(same) + 1
    return sorted(found)


def script(old: list[str], new: list[str], anchors: bool = True) -> list[tuple]:
    """Hunks (old_start, old_lines, new_start, new_lines), places from 0: what to put for what.

    With ``anchors``, lines that are once in both texts are matched first, as many as keep their order, and a shortest script
    is made of each piece between them; without, one of the whole.
    """
    pairs: list[tuple[int, int]] = []
    if anchors:
        once = lambda lines: {v: i for i, v in enumerate(lines)} if len(set(lines)) == len(lines) else {v: i for i, v in enumerate(lines) if counts[v] == 1}
        where = []
        for lines in (old, new):
            counts: dict[str, int] = {}
            for v in lines:
                counts[v] = counts.get(v, 0) + 1
            where.append(once(lines))
        both = [(i, where[1][v]) for v, i in where[0].items() if v in where[1]]
        pairs = [both[p] for p in _rising([j for _, j in both])]
    kept, i, j = [], 0, 0
    for x, y in [*pairs, (len(old), len(new))]:
        kept += [(i + p, j + q) for p, q in matched(old[i:x], new[j:y])] + ([(x, y)] if x < len(old) or y < len(new) else [])
        i, j = x + 1, y + 1
    out, i, j = [], 0, 0
    for x, y in [*kept, (len(old), len(new))]:
        if i < x or j < y:
            out.append((i, old[i:x], j, new[j:y]))
        i, j = x + 1, y + 1
    return out


def patched(old: list[str], hunks: list[tuple]) -> list[str]:
    """The new lines: the old ones with every hunk put in."""
    out, at = [], 0
    for start, gone, _, come in hunks:
        out += [*old[at:start], *come]
        at = start + len(gone)
    return out + old[at:]


def line_counts(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, additions, deletions, changed) of ``line_differences``, without its hunks."""

    def run(batches):
        for batch in batches:
            come, gone = [], []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                hunks = script(lines_of(x), lines_of(y)) if (x or "") != (y or "") else []
                come.append(sum(len(h[3]) for h in hunks))
                gone.append(sum(len(h[1]) for h in hunks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(come, pa.int32()), pa.array(gone, pa.int32())], names=["_key", "additions", "deletions"])

    kind = pairs.schema[key].dataType.simpleString()
    got = pairs.select(F.col(key).alias("_key"), F.col(old).cast("string"), F.col(new).cast("string")).mapInArrow(run, f"_key {kind}, additions int, deletions int")
    return got.select(F.col("_key").alias(key), "additions", "deletions", (F.col("additions") + F.col("deletions") > 0).alias("changed"))


def line_differences(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, hunks, additions, deletions, changed) of each row's two texts.

    ``hunks`` has for each change the old and new place (from 0) and lines (with their ends). A null text is empty. Rows that
    repeat are each looked at. One pair of texts is worked on in one task, in memory by its lines.
    """

    def run(batches):
        for batch in batches:
            rows = [script(lines_of(x), lines_of(y)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            hunks = pa.array([[{"old_start": a, "old_lines": gone, "new_start": b, "new_lines": come} for a, gone, b, come in r] for r in rows], pa.list_(pa.struct([("old_start", pa.int32()), ("old_lines", pa.list_(pa.string())), ("new_start", pa.int32()), ("new_lines", pa.list_(pa.string()))])))
            yield pa.RecordBatch.from_arrays([batch.column(0), hunks], names=["_key", "hunks"])

    kind = pairs.schema[key].dataType.simpleString()
    got = pairs.select(F.col(key).alias("_key"), F.col(old).cast("string"), F.col(new).cast("string")).mapInArrow(run, f"_key {kind}, hunks {_HUNK}")
    total = lambda part: F.aggregate("hunks", F.lit(0), lambda n, h: n + F.size(h[part]))
    return got.select(F.col("_key").alias(key), "hunks", total("new_lines").alias("additions"), total("old_lines").alias("deletions"), (F.size("hunks") > 0).alias("changed"))


def json_paths(rows: DataFrame, key: str, column: str, most_rounds: int = 200) -> DataFrame:
    """(key, path, kind, value): the leaves of each row's JSON, level by level; empty objects and arrays are leaves.

    ``kind`` is that of the parsed value, so a number and a text of the same letters differ. A text that is no JSON is one leaf
    ``$`` of kind ``invalid``, a null has none. As many rounds as the deepest value has levels.
    """
    cuts = Cuts(rows.sparkSession)
    kind = F.lower(F.regexp_extract(F.expr("schema_of_variant(v)"), "^[A-Z]+", 0))
    parsed = rows.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.lit("$").alias("path"), F.expr(f"try_parse_json(`{column}`)").alias("v"), F.col(column).alias("raw"))
    leaf = lambda df: df.select("key", "path", kind.alias("kind"), F.expr("to_json(v)").alias("value"))
    found = [parsed.where("v is null").select("key", "path", F.lit("invalid").alias("kind"), F.col("raw").alias("value"))]
    level = parsed.where("v is not null").select("key", "path", F.expr("to_json(v)").alias("t"))
    for _ in range(most_rounds):
        level = cuts.written(level, "json-level")
        if level.isEmpty():
            break
        now = level.withColumn("v", F.expr("parse_json(t)"))
        inner = F.rlike("t", F.lit(r"^(\{.+\}|\[.+\])$"))
        found.append(leaf(now.where(~inner)))
        e = now.where(inner).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inside"))
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("name")))
        level = e.select("key", F.concat("path", step).alias("path"), F.expr("to_json(inside)").alias("t"))
    else:
        raise RuntimeError(f"values were still nested after {most_rounds} levels")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = written(out.select(F.col("key").alias(key), "path", "kind", "value"), "json-paths")
    cuts.clear()
    return out


def json_differences(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, path, change, old, new): leaves that are only in the new JSON (added), only in the old (removed), or differ in kind or value (changed).

    Keys are unique. A null text has no leaves.
    """
    side = lambda c: json_paths(pairs, key, c).select(key, "path", F.struct("kind", "value").alias(f"_{c}"))
    both = side(old).join(side(new), [key, "path"], "full")
    a, b = F.col(f"_{old}"), F.col(f"_{new}")
    change = F.when(a.isNull(), "added").when(b.isNull(), "removed").when(a != b, "changed")
    return both.withColumn("change", change).where("change is not null").select(key, "path", "change", a["value"].alias("old"), b["value"].alias("new"))
