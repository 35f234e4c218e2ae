"""Stores as tables: upserts and deletions by key, counts by dimension, statistics of corpora, exports, JSON checks, links that lead nowhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import index_tokens
from strataloom.operators.governance import redact

#: Suffixes that a stem loses, the first that fits, if more than two letters stay.
SUFFIXES = ("ing", "ed", "er", "est", "ly", "s", "es", "ies")


def upserted(base: DataFrame, changes: DataFrame, key: str, version: str, gone: str) -> DataFrame:
    """``base`` with the newest change of every key (by ``version``) in place of its row; keys whose newest change is ``gone`` leave.

    ``changes`` has the columns of ``base``, ``version`` and the flag ``gone``; a change of an unknown key adds a row.
    """
    last = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1")
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(~F.coalesce(F.col(gone), F.lit(False))).select(*base.columns))


def counts_by(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) of every value of every dimension, in one pass."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("value")) for d in dimensions])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def text_statistics(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Files, lines, blank lines, words and characters, and the longest file, of each group (of all, without ``by``)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n")
    each = docs.select(*by, F.when(t == "", 0).otherwise(F.size(lines)).alias("l"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).alias("b"), F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("w"), F.length(t).alias("c"))
    return each.groupBy(*by).agg(F.count("*").alias("files"), F.sum("l").alias("lines"), F.sum(F.when(F.col("l") > 0, F.col("b")).otherwise(0)).alias("blank"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.max("c").alias("longest"))


def json_findings(rows: DataFrame, key: str, column: str, fields: dict[str, str]) -> DataFrame:
    """(key, finding) of texts that are no JSON object, and of required fields that are missing or of another type (``number`` or ``string``)."""
    raw = F.coalesce(F.col(column), F.lit(""))
    whole = F.expr(f"try_parse_json(coalesce(`{column}`, ''))").isNotNull() & F.startswith(F.trim(raw), F.lit("{"))

    def one(name: str, kind: str) -> Column:
        value = F.get_json_object(raw, f"$.{name}")
        wrong = ~F.rlike(value, F.lit(r"^-?[0-9]+(\.[0-9]+)?$")) if kind == "number" else F.rlike(value, F.lit(r"^-?[0-9]+(\.[0-9]+)?$"))
        return F.when(value.isNull(), F.lit(f"missing:{name}")).when(wrong, F.lit(f"type:{name}"))

    found = F.when(~whole, F.array(F.lit("invalid"))).otherwise(F.array_compact(F.array(*[one(n, k) for n, k in fields.items()])))
    return rows.select(key, F.explode(found).alias("finding"))


def stem(word: Column) -> Column:
    """The word without the first suffix that fits."""
    fits = lambda s: F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 2)
    return reduce(lambda other, s: F.when(fits(s), F.left(word, F.length(word) - len(s))).otherwise(other), reversed(SUFFIXES), word)


def stemmed_terms(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(stem, words, uses): the ``k`` most used stems, and of how many different words."""
    words = docs.select(F.explode(index_tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(stem(F.col("w")).alias("stem")).agg(F.count("*").alias("words"), F.sum("n").alias("uses")).orderBy(F.desc("uses"), "stem").limit(k)


def title_of(text: Column, other: Column) -> Column:
    """The first heading within the first 20 lines, or the other."""
    head = F.filter(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), lambda x: F.rlike(F.trim(x), F.lit(r"^#+\s+.+")))
    return F.coalesce(F.trim(F.regexp_extract(F.trim(F.get(head, F.lit(0))), r"^#+\s+(.+)", 1)), other)


def export_lines(rows: DataFrame, columns: list[str], text: str, tier: str) -> DataFrame:
    """(line): a JSON object of each row; the text redacted for its reader's tier."""
    return rows.select(F.to_json(F.struct(*columns, redact(F.col(text), tier).alias(text)), {"ignoreNullFields": "false"}).alias("line"))


def dangling(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (page_id, href) to no known page (url); fragments do not count."""
    bare = links.withColumn("target", F.regexp_replace("href", "#.*$", "")).where("target != ''")
    return bare.join(pages.select(F.col("url").alias("target")).distinct(), "target", "left_anti").select("page_id", "target").distinct()


def peaks(events: DataFrame, by: str, ts: str, value: Column) -> DataFrame:
    """(by, peak_hour, peak, mean, multiplier): the busiest hour of the day (the earlier of equals) against the mean of the hours with anything."""
    hours = events.where(F.col(ts).isNotNull()).groupBy(by, F.hour(ts).alias("hour")).agg(F.sum(value).alias("v"))
    out = hours.groupBy(by).agg(F.min_by("hour", F.struct(-F.col("v"), F.col("hour"))).alias("peak_hour"), F.max("v").alias("peak"), F.avg("v").alias("mean"))
    return out.withColumn("multiplier", F.when(F.col("mean") > 0, F.col("peak") / F.col("mean")).otherwise(0.0))
