"""Markdown texts line by line: headings, anchors, contents, sections, fences, tables, numbered figures, references, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes a line a fence, a heading, a table row, a table's separator, a list item or a quotation.
FENCE = r"^\s*(?:`{3,}|~{3,})"
HEADING = r"^(#{1,6})\s+(.+?)(?:\s+#*)?$"
TABLE_ROW = r"^\s*\|.+\|"
TABLE_SEPARATOR = r"^\s*\|?[\s\-:]+\|[\s\-:|]+\|?\s*$"
BULLET = r"^\s*(?:[-*+]|\d+[.)]) "
QUOTE = r"^\s*>"
#: Marks that are taken off a title before its anchor is made, in this order.
INLINE = ((r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*{1,2}([^*]+)\*{1,2}", "$1"), (r"_{1,2}([^_]+)_{1,2}", "$1"))


def slug(title: Column) -> Column:
    """Anchor of a title: marks and punctuation off, lower case, blanks as hyphens, hyphens once."""
    for pattern, to in INLINE:
        title = F.regexp_replace(title, pattern, to)
    bare = F.regexp_replace(F.trim(F.lower(title)), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), r"-+", "-")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line, content, fenced) of every line, from 1; fences are marked with what they hold."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "content"))
    fence = F.rlike("content", F.lit(FENCE)).cast("int")
    before = F.sum(fence).over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line"), "content", ((before % 2 == 1) | (fence == 1)).alias("fenced"))


def headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line, level, title, anchor) of headings outside fences."""
    rows = lines(docs, text).where(~F.col("fenced") & F.rlike("content", F.lit(HEADING)))
    title = F.trim(F.regexp_extract("content", HEADING, 2))
    return rows.select("doc_id", "line", F.length(F.regexp_extract("content", HEADING, 1)).alias("level"), title.alias("title"), slug(title).alias("anchor"))


def contents(docs: DataFrame, deepest: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, toc): a nested list of links to the headings; an anchor that occurs again gets a number."""
    h = headings(docs, text)
    again = F.row_number().over(Window.partitionBy("doc_id", "anchor").orderBy("line")) - 1
    h = h.withColumn("anchor", F.when(again > 0, F.concat_ws("-", "anchor", again.cast("string"))).otherwise(F.col("anchor"))).where(F.col("level") <= deepest)
    item = F.concat(F.expr("repeat('  ', level - 1)"), F.lit("- ["), F.col("title"), F.lit("](#"), F.col("anchor"), F.lit(")"))
    return h.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", item.alias("item")))), lambda x: x["item"]), "\n").alias("toc"))


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, section, title, first_line, lines, chars): a text cut at its headings; section 0 is what comes before the first."""
    rows = lines(docs, text)
    is_head = ~F.col("fenced") & F.rlike("content", F.lit(HEADING))
    number = F.sum(is_head.cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))
    rows = rows.withColumn("head", is_head).withColumn("section", number)
    title = F.max(F.when(F.col("head"), F.trim(F.regexp_extract("content", HEADING, 2))))
    return rows.groupBy("doc_id", "section").agg(F.coalesce(title, F.lit("")).alias("title"), F.min("line").alias("first_line"), F.count("*").alias("lines"), F.sum(F.length("content") + 1).alias("chars"))


def code_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, block, first_line, lines) of closed fenced blocks; lines without the fences."""
    rows = lines(docs, text)
    fence = F.rlike("content", F.lit(FENCE)).cast("int")
    rows = rows.withColumn("fence", fence).withColumn("k", F.sum(fence).over(Window.partitionBy("doc_id").orderBy("line")))
    open_ = F.when(F.col("fence") == 1, (F.col("k") + 1) / 2).otherwise((F.col("k") + 1) / 2)
    block = F.floor(F.when((F.col("fence") == 1) & (F.col("k") % 2 == 0), F.col("k") / 2).otherwise(open_))
    inside = rows.where("fenced").withColumn("block", block)
    return inside.groupBy("doc_id", "block").agg(F.min("line").alias("first_line"), F.sum("fence").alias("fences"), (F.count("*") - F.sum("fence")).alias("lines")).where("fences = 2").drop("fences")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lines, longest, bullets, quotes, table_rows, tables, fences, digits): shape of each text; digits is their share of what is not blank."""
    t = F.coalesce(text, F.lit(""))
    rows = docs.select("doc_id", t.alias("t"), F.split(t, "\n").alias("l"))
    count = lambda p: F.size(F.filter("l", lambda x: F.rlike(x, F.lit(p))))
    table = lambda x: F.rlike(x, F.lit(TABLE_ROW)) | F.rlike(x, F.lit(TABLE_SEPARATOR))
    begins = F.size(F.filter("l", lambda x, i: table(x) & ((i == 0) | ~table(F.get("l", i - 1)))))
    solid = F.length(F.regexp_replace("t", r"\s", ""))
    return rows.select(
        "doc_id", F.size("l").alias("lines"), F.array_max(F.transform("l", F.length)).alias("longest"), count(BULLET).alias("bullets"), count(QUOTE).alias("quotes"),
        F.size(F.filter("l", lambda x: F.rlike(x, F.lit(TABLE_ROW)) & ~F.rlike(x, F.lit(TABLE_SEPARATOR)))).alias("table_rows"), begins.alias("tables"), F.floor(count(FENCE) / 2).alias("fences"),
        F.when(solid > 0, F.length(F.regexp_replace("t", "[^0-9]", "")) / solid).otherwise(0.0).alias("digits"),
    )


def numbered(docs: DataFrame, word: str, text: str = "text") -> DataFrame:
    """(doc_id, number, n, defined): how often "word N" occurs, and whether a line starts with it and a colon."""
    rows = lines(docs, text)
    pattern = rf"(?i)\b{word}\s+([0-9]+)"
    found = rows.select("doc_id", "content", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("number"))
    own = F.regexp_extract("content", rf"(?i)^{word}\s+([0-9]+):", 1)
    return found.groupBy("doc_id", F.col("number").cast("int").alias("number")).agg(F.count("*").alias("n"), F.bool_or(own == F.col("number")).alias("defined"))


def numbering_findings(docs: DataFrame, word: str, text: str = "text") -> DataFrame:
    """(doc_id, finding, number): numbers used more than twice, missing from 1 up to the largest, or referred to and never defined."""
    n = numbered(docs, word, text)
    twice = n.where("n > 2").select("doc_id", F.lit("duplicate").alias("finding"), "number")
    broken = n.where("not defined").select("doc_id", F.lit("broken_reference").alias("finding"), "number")
    wanted = n.groupBy("doc_id").agg(F.max("number").alias("top")).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("number"))
    gap = wanted.join(n.select("doc_id", "number"), ["doc_id", "number"], "left_anti").select("doc_id", F.lit("gap").alias("finding"), "number")
    return twice.unionByName(broken).unionByName(gap)


def front_matter(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, value) of "key: value" lines between the two --- that a text starts with."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^---\n(.*?)\n---\n", 1)
    rows = docs.select("doc_id", F.explode(F.split(head, "\n")).alias("l")).where(F.rlike("l", F.lit(r"^[A-Za-z_][A-Za-z0-9_-]*:")))
    return rows.select("doc_id", F.regexp_extract("l", r"^([^:]+):", 1).alias("key"), F.trim(F.regexp_extract("l", r"^[^:]+:(.*)$", 1)).alias("value"))


def paragraph_chunks(text: Column, most_tokens: int = 1800) -> Column:
    """Chunks of whole paragraphs of at most ``most_tokens`` (a quarter of the characters of each); a longer paragraph is a chunk of its own."""
    parts = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\n\s*\n"))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("now"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, p: Column) -> Column:
        size = F.floor(F.length(p) / 4)
        full = acc["now"].isNotNull() & (acc["n"] + size > most_tokens)
        fresh = F.struct(F.concat(acc["out"], F.array(acc["now"])).alias("out"), p.alias("now"), size.alias("n"))
        more = F.struct(acc["out"].alias("out"), F.concat_ws("\n\n", acc["now"], p).alias("now"), (acc["n"] + size).alias("n"))
        return F.when(full, fresh).otherwise(more)

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["now"].isNotNull(), F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]))
