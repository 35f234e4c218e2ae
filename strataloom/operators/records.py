"""Records over time and in order: chained logs, merged items, placeholders, budgets, drift grids, controls, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_hash(*parts: Column) -> Column:
    """Digest of an entry of a chained log: its fields and the digest before it, joined by bars; nulls are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def verify_chain(log: DataFrame, chain: str, order: str, fields: list[str]) -> DataFrame:
    """``log`` (with prev_hash and hash) with ``linked`` (prev_hash is the hash before it in its chain, or empty for the first) and ``intact`` (hash fits the fields)."""
    before = F.lag("hash").over(Window.partitionBy(chain).orderBy(order))
    out = log.withColumn("linked", F.coalesce("prev_hash", F.lit("")) == F.coalesce(before, F.lit("")))
    return out.withColumn("intact", F.coalesce(F.col("hash") == entry_hash(*[F.col(f) for f in fields], F.col("prev_hash")), F.lit(False)))


def merged(items: DataFrame, key: str) -> DataFrame:
    """One item for each key: (key, members, id, content, tags, confidence).

    Content and id are of the member with the highest confidence, then the longest content, then the smallest id. Tags are
    united without regard to case, each in its smallest spelling, sorted. Pre-aggregated: only the tags' different
    spellings and one best row travel for each key and task.
    """
    best = items.groupBy(key).agg(F.count("*").alias("members"), F.max(F.struct("confidence", F.length(F.coalesce("content", F.lit(""))).alias("n"), (-F.col("id")).alias("minus"), "content")).alias("best"))
    spelt = items.select(key, F.explode("tags").alias("tag")).groupBy(key, F.lower("tag").alias("low")).agg(F.min("tag").alias("tag"))
    tags = spelt.groupBy(key).agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    out = best.join(tags, key, "left")
    return out.select(key, "members", (-F.col("best.minus")).alias("id"), F.col("best.content").alias("content"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("best.confidence").alias("confidence"))


def placeholders(values: DataFrame, scope: str, kind: str, value: str, order: str) -> DataFrame:
    """(scope, kind, value, number, placeholder): each different value of a kind numbered from 1 by where it is first seen, ties by value."""
    first = values.where(F.col(value).isNotNull()).groupBy(scope, kind, value).agg(F.min(order).alias("first"))
    number = F.row_number().over(Window.partitionBy(scope, kind).orderBy("first", value))
    return first.withColumn("number", number).select(scope, kind, value, "number", F.concat(F.lit("["), F.upper(kind), F.lit("_"), F.lpad(F.col("number").cast("string"), 4, "0"), F.lit("]")).alias("placeholder"))


def within_budget(items: DataFrame, group: str, order: list, tokens: str, budget: int) -> DataFrame:
    """Items before the first one with which the running sum of tokens passes the budget of their group, with ``used``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def drift_grid(items: DataFrame, row: str, column: str, changed: Column) -> DataFrame:
    """(row, column, n, pct) of all combinations of the two labels, with the share of changed items; missing ones are 0."""
    counts = items.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"), F.count_if(changed).alias("c"))
    grid = counts.select(row).distinct().crossJoin(counts.select(column).distinct())  # labels, few by nature: the result has this size
    out = grid.join(counts, [row, column], "left")
    return out.select(row, column, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("c") / F.col("n") * 100, F.lit(0.0)).alias("pct"))


def tool_latency(calls: DataFrame, tool: str, value: str, failed: Column) -> DataFrame:
    """(tool, calls, errors, mean, worst, p95) of each tool; p95 is the value at index floor(0.95 n) in order, the largest for fewer than 20."""
    n = F.count(value)
    stats = calls.groupBy(tool).agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"), F.avg(value).alias("mean"), F.max(value).alias("worst"), n.alias("n"))
    counts = calls.where(F.col(value).isNotNull()).groupBy(tool, value).agg(F.count("*").alias("c"))  # equal values once
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(tool).orderBy(value))).join(stats.select(tool, "n"), tool)
    p95 = upto.where(F.col("upto") > F.floor(F.col("n") * 0.95)).groupBy(tool).agg(F.min(value).alias("p"))
    return stats.join(p95, tool, "left").select(tool, "calls", "errors", "mean", "worst", F.when(F.col("n") >= 20, F.col("p")).otherwise(F.col("worst")).alias("p95"))


def control_ratio(checks: DataFrame, framework: str, control: str, passed: Column) -> DataFrame:
    """(framework, controls, passed, ratio): a control passes if all its checks do; an unknown check counts as failed."""
    each = checks.groupBy(framework, control).agg(F.bool_and(F.coalesce(passed, F.lit(False))).alias("ok"))
    return each.groupBy(framework).agg(F.count("*").alias("controls"), F.count_if("ok").alias("passed")).withColumn("ratio", F.col("passed") / F.col("controls"))


def line_windows(docs: DataFrame, size: int = 40, overlap: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, first, last, content): windows of ``size`` lines, ``overlap`` shared with the next; lines count from 0. An empty text has none."""
    lines = F.split(F.col(text), "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    cut = docs.where(F.coalesce(text, F.lit("")) != "").select("doc_id", lines.alias("l"), F.explode(starts).alias("first"))
    return cut.select("doc_id", "first", (F.least(F.col("first") + size, F.size("l")) - 1).alias("last"), F.array_join(F.slice("l", F.col("first") + 1, F.lit(size)), "\n").alias("content"))


def heading_jumps(headings: DataFrame) -> DataFrame:
    """(doc_id, line, level, before) of headings more than one level below the heading before them."""
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("line"))
    return headings.withColumn("before", before).where(F.col("level") > F.col("before") + 1).select("doc_id", "line", "level", "before")


def outline(headings: DataFrame) -> DataFrame:
    """``headings`` (doc_id, line, level 1 to 3) with the section number ("2.1.3") and the last line before the next heading of that level or above (null: to the end)."""
    doc = Window.partitionBy("doc_id").orderBy("line")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    ones = headings.withColumn("n1", F.sum((F.col("level") == 1).cast("int")).over(upto))
    # Numbers start anew at the last heading above: counts so far, less those at that heading, so one order serves all.
    counted = ones.withColumns({f"c{k}": F.sum((F.col("level") == k).cast("int")).over(upto) for k in (2, 3)})
    since = lambda k: F.col(f"c{k}") - F.coalesce(F.max(F.when(F.col("level") < k, F.col(f"c{k}"))).over(upto), F.lit(0))
    threes = counted.select("doc_id", "line", "level", "n1", since(2).alias("n2"), since(3).alias("n3"))
    back = Window.partitionBy("doc_id").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda k: F.min(F.when(F.col("level") <= k, F.col("line"))).over(back)
    end = F.when(F.col("level") == 1, at(1)).when(F.col("level") == 2, at(2)).otherwise(at(3)) - 1
    number = F.concat_ws(".", "n1", F.when(F.col("level") >= 2, F.col("n2")), F.when(F.col("level") >= 3, F.col("n3")))
    return threes.select("doc_id", "line", "level", number.alias("number"), end.alias("until"))
