"""Versioned memory items: current state, revisions, drift between corpora, changed files, budgeted recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(revisions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of every key (upsert over an append-only table): a grouped maximum, so nothing is sorted."""
    rest = [c for c in revisions.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return revisions.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, "row.*")


def numbered_revisions(revisions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows with their revision number from 1 and whether a later one supersedes them."""
    w = Window.partitionBy(key).orderBy(*order)
    return revisions.withColumn("revision", F.row_number().over(w)).withColumn("superseded", F.lead(F.lit(True), 1, False).over(w))


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(status, id_a, id_b, domain) of items (id, rule_id, content_hash, domain) of a baseline ``a`` against ``b``.

    An item of ``b`` meets the first item of ``a`` with its rule; without a rule that ``a`` has, the first with its content.
    """
    by_rule = a.where("rule_id is not null").groupBy("rule_id").agg(F.min(F.struct("id", "content_hash")).alias("m"))
    by_hash = a.groupBy("content_hash").agg(F.min("id").alias("h_id"))
    met = b.join(by_rule, "rule_id", "left").join(by_hash, "content_hash", "left")
    id_a = F.when(F.col("m").isNotNull(), F.col("m.id")).otherwise(F.col("h_id"))
    same = F.when(F.col("m").isNotNull(), F.col("m.content_hash") == F.col("content_hash")).otherwise(True)
    of_b = met.select(F.when(id_a.isNull(), "added").when(same, "unchanged").otherwise("modified").alias("status"), id_a.alias("id_a"), F.col("id").alias("id_b"), "domain")
    gone = a.join(of_b.select(F.col("id_a").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    return of_b.unionByName(gone.select(F.lit("removed").alias("status"), F.col("id").alias("id_a"), F.lit(None).cast("long").alias("id_b"), "domain"))


def drift_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts by status and the percentage of changes over the larger corpus."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    got = drift(a, b).agg(n("added"), n("removed"), n("modified"), n("unchanged"))
    total = max(a.count(), b.count(), 1)
    return got.withColumn("drift_pct", (F.col("added") + F.col("removed") + F.col("modified")) / total * 100)


def changed_files(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status) of the files of a registry (path, sha256) against the stored hashes: new, modified, unchanged, deleted."""
    both = registry.select("path", F.col("sha256").alias("now")).join(stored.select("path", F.col("sha256").alias("was")), "path", "full")
    return both.select("path", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "unchanged").otherwise("modified").alias("status"))


def budgeted_recall(items: DataFrame, max_tokens: int = 12_000, least: int = 3, most: int = 25) -> DataFrame:
    """(domain, rank, id, tokens) of the items (id, domain, importance, tokens) that a token budget takes.

    Each domain's quota is its share of a rough number of items (80 tokens each), between ``least`` and ``most``; the best
    by importance, then id, are its candidates. Domains are filled from the smallest on, until an item does not fit.
    """
    rough = max_tokens // 80
    sizes = items.groupBy("domain").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a domain
    sizes = sizes.withColumn("quota", F.least("n", F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("n") / total * rough)))))
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("importance"), "id"))
    best = items.withColumn("rank", rank).where(F.col("rank") <= most).join(sizes, "domain").where("rank <= quota")  # at most ``most`` rows a domain
    spent = F.sum("tokens").over(Window.orderBy("n", "domain", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return best.withColumn("spent", spent).where(F.col("spent") <= max_tokens).select("domain", "rank", "id", "tokens")


def repeated_queries(turns: DataFrame, session: str, order: str, text: str, threshold: float = 0.9) -> DataFrame:
    """Turns with ``reason``: empty, repeat (of any earlier one of its session, normalized), similar (to the one before), or null."""
    from strataloom.functions.text import jaccard, normalized, word_set

    w = Window.partitionBy(session).orderBy(order)
    rows = turns.withColumn("_norm", normalized(F.col(text))).withColumn("_set", word_set(F.col(text)))
    before = F.row_number().over(Window.partitionBy(session, "_norm").orderBy(order)) > 1
    alike = jaccard(F.col("_set"), F.lag("_set").over(w)) >= threshold
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return rows.withColumn("reason", F.when(blank, "empty").when(before, "repeat").when(alike, "similar")).drop("_norm", "_set")
