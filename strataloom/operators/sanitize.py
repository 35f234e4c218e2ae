"""What leaves: paths, ids and metadata taken out of texts, keys that must not appear, metric lines only, searches line by line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that no external output may hold.
DENIED = ("llm_trace", "call_hash", "inputs_merkle_root", "run_id", "endpoint", "model", "cache_status", "prompt_tokens", "completion_tokens", "digest", "prompt_hash", "response_hash", "sovereignty", "model_digest", "cache_key")
#: Paths that are redacted.
PATHS = (r"/home/[^/\s]+/", r"/Users/[^/\s]+/", r"C:\\Users\\[^\\]+\\", r"/tmp/[^/\s]+/", r"/var/[^/\s]+/")
#: Blocks of metadata.
METADATA = (r"(?s)^---\n.*?\n---\n", r"(?s)^\+\+\+\n.*?\n\+\+\+\n", r"(?is)<!--\s*PROVENANCE.*?-->", r"(?s)```metadata\n.*?\n```", r"(?s)```json:metadata\n.*?\n```", r"(?s)```sovereignty\n.*?\n```")
#: Ids of files, runs and contents.
FILE_ID, RUN_ID, LONG_HASH = r"F[0-9]{6}", r"run_[0-9]{8}_[0-9]{6}_[a-f0-9]+", r"\b[a-f0-9]{40,}\b"
#: Lines that hold a metric.
METRIC_TABLE, METRIC_RULE, METRIC = r"\|\s*[0-9]", r"^\s*\|[-:| ]+\|", r"(?i)(?:count|total|score|time|duration|size):\s*[0-9]"


def without_metadata(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), METADATA, text)


def without_paths(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, "[PATH]/"), PATHS, text)


def with_letters(text: Column) -> Column:
    """File ids as [DOC-A], [DOC-B] and so on, in their order (after 26 again from A); runs and long hashes by their marks."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(FILE_ID), F.lit(0))))
    pairs = F.transform(ids, lambda x, i: F.struct(x.alias("id"), F.concat(F.lit("[DOC-"), F.chr((F.lit(65) + i % 26).cast("long")), F.lit("]")).alias("mark")))
    named = F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["id"], p["mark"]))
    return F.regexp_replace(F.regexp_replace(named, RUN_ID, "[RUN-ID]"), LONG_HASH, "[HASH]")


def sanitized(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, raw, content, paths, ids, stripped): texts, null ones as empty, what external readers get of them, and what was taken out."""
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("raw")).withColumn("bare", without_metadata(F.col("raw")))
    paths = F.lit(0)
    step = F.col("bare")
    for p in PATHS:
        paths, step = paths + F.regexp_count(step, F.lit(p)), F.regexp_replace(step, p, "[PATH]/")
    rows = rows.select("doc_id", "raw", "bare", paths.cast("long").alias("paths"), without_paths(F.col("bare")).alias("t"))
    different = lambda p: F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(p), F.lit(0))))
    ids = different(FILE_ID) + different(RUN_ID) + different(LONG_HASH)
    return rows.select("doc_id", "raw", with_letters(F.col("t")).alias("content"), "paths", ids.cast("long").alias("ids"), (F.length("bare") < F.length("raw")).alias("stripped"))


def denied_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key): keys that a text holds as words, quoted or not. A pattern is tried only on texts that hold its letters."""
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("t")).withColumn("low", F.lower("t"))
    hit = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(k)) & F.rlike("t", F.lit(rf"(?i)\b{k}\b")), F.lit(k)) for k in DENIED]))
    return rows.select("doc_id", F.explode(hit).alias("key"))


def metrics_only(text: Column) -> Column:
    """Headings, rows of numbers, and lines with a metric."""
    keep = lambda x: F.startswith(x, F.lit("#")) | (F.contains(x, F.lit("|")) & (F.rlike(x, F.lit(METRIC_TABLE)) | F.rlike(x, F.lit(METRIC_RULE)))) | F.rlike(x, F.lit(METRIC))
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), keep), "\n")


def matching_lines(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, line, matches, content) of every line that the pattern matches, from 1."""
    rows = docs.where(F.rlike(F.coalesce(text, F.lit("")), F.lit(pattern))).select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    return rows.where(F.rlike("content", F.lit(pattern))).select("doc_id", (F.col("pos") + 1).alias("line"), F.regexp_count("content", F.lit(pattern)).alias("matches"), "content")


def replaced(docs: DataFrame, pattern: str, to: str, text: str = "text") -> DataFrame:
    """(doc_id, replacements, content)."""
    t = F.coalesce(text, F.lit(""))
    return docs.select("doc_id", F.regexp_count(t, F.lit(pattern)).alias("replacements"), F.regexp_replace(t, pattern, to).alias("content"))
