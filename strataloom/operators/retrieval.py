"""Keyword, vector and fused search over whole tables, and a kept keyword index."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.measures import cosine
from strataloom.functions.text import index_tokens
from strataloom.sources.tables import Cuts, exists


def bm25(docs: DataFrame, terms: list[str], text: str = "text", doc_id: str = "doc_id", k: int | None = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score, rank) of the ``k`` best documents; a term given twice counts twice, ties go to the smaller id.

    Only counts of the query's terms leave the scan: one pass gives the corpus figures (documents, mean length, document
    frequencies), a second one scores; no postings are shuffled.
    """
    tokens = docs.select(F.col(doc_id).alias("doc_id"), index_tokens(F.col(text)).alias("t"))
    wanted = sorted(set(terms))
    times = lambda w: F.size(F.filter("t", lambda x: x == w))
    counted = tokens.select("doc_id", F.size("t").alias("len"), *[times(w).alias(f"tf{i}") for i, w in enumerate(wanted)])
    figures = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
    n, avg = figures["n"], figures["avg"] or 1.0

    def part(i: int, w: str) -> Column:
        df = figures[f"df{i}"]
        idf = F.log(F.lit((n - df + 0.5) / (df + 0.5) + 1))
        tf = F.col(f"tf{i}")
        return terms.count(w) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / avg))

    hits = counted.where(reduce(Column.__or__, [F.col(f"tf{i}") > 0 for i in range(len(wanted))], F.lit(False)))
    scored = hits.select("doc_id", reduce(Column.__add__, [part(i, w) for i, w in enumerate(wanted)], F.lit(0.0)).alias("score"))
    return ranked(scored, k)


class KeywordIndex:
    """Postings kept as Parquet under a folder: (term, doc_id, tf, length), sorted by term within each file; term frequencies, ids and corpus figures of every batch.

    A task that reads texts writes the postings of its own, so none are shuffled: as many sorted files as tasks, each of a bounded
    share of the texts, and a term that is in most documents is in all of them. A search looks up its terms' frequencies, then
    reads of each file the row groups and pages that may hold its terms. Every row is a document; rows that repeat an id are
    scored each, and the scores of one id are summed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> KeywordIndex:
        """Add documents; ids that are in the index already are left out. A null text has no terms, but is a document."""
        tokens = docs.select(F.col(doc_id).alias("doc_id"), F.sort_array(index_tokens(F.col(text))).alias("t")).withColumn("length", F.size("t"))
        known = self._read("ids", "doc_id " + tokens.schema["doc_id"].dataType.simpleString())
        tokens = tokens.join(known, "doc_id", "left_anti") if known is not None else tokens
        cuts, batch = Cuts(self.spark), uuid.uuid4().hex
        tokens = cuts.written(tokens, "keyword-tokens")
        n, words, different = tokens.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.countDistinct("doc_id")).first()
        # Equal terms follow each other, so a term's uses are the distance from its first place to the next term's.
        first = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get("t", i - 1)), i)), lambda i: i.isNotNull())
        runs = tokens.withColumn("at", first).select("doc_id", "length", "t", "at", F.posexplode("at").alias("k", "i"))
        tf = F.coalesce(F.get("at", F.col("k") + 1), F.col("length")) - F.col("i")
        rows = runs.select(F.get("t", F.col("i")).alias("term"), "doc_id", tf.cast("int").alias("tf"), "length")
        rows.sortWithinPartitions("term", "doc_id").write.parquet(f"{self.path}/postings/batch={batch}")
        held = F.count("*") if n == different else F.countDistinct("doc_id")  # ids that repeat, or are null, are counted as such
        own = self.spark.read.schema(rows.schema).parquet(f"{self.path}/postings/batch={batch}").groupBy("term").agg(F.count("*").alias("df"), held.alias("documents"), F.sum("tf").alias("uses"))
        own.sortWithinPartitions("term").write.mode("append").parquet(f"{self.path}/terms")
        tokens.select("doc_id").write.mode("append").parquet(f"{self.path}/ids")
        self.spark.createDataFrame([(n, words)], "n long, words long").coalesce(1).write.mode("append").parquet(f"{self.path}/figures")
        cuts.clear()
        return self

    def _read(self, name: str, schema: str) -> DataFrame | None:
        """A table of the index; none before the first batch."""
        if not exists(self.spark, f"{self.path}/{name}"):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").drop("batch")

    def terms(self) -> DataFrame:
        """(term, df, documents, uses): rows and different ids that hold each term, and how often they do."""
        return self.spark.read.parquet(f"{self.path}/terms").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "documents", "uses")])

    def figures(self) -> DataFrame:
        """One row: documents and mean length."""
        return self.spark.read.parquet(f"{self.path}/figures").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("mean"))

    def search(self, terms: list[str], k: int | None = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(doc_id, score, rank) as of ``bm25``."""
        wanted, whole = sorted(set(terms)), self.figures().first()
        here = F.col("term").isin(wanted)
        often = {r["term"]: r["df"] for r in self.terms().where(here).select("term", "df").collect()}  # a row a term
        weight = F.lit(0.0)
        for t, df in often.items():
            weight = F.when(F.col("term") == t, terms.count(t) * math.log((whole["n"] - df + 0.5) / (df + 0.5) + 1)).otherwise(weight)
        part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(whole["mean"])))
        return ranked(self.postings().where(here).groupBy("doc_id").agg(F.sum(part).alias("score")), k)


def vector_search(vectors: DataFrame, query: list[float], k: int | None = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(doc_id, score, rank) of the ``k`` vectors with the largest cosine to ``query``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return ranked(vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).alias("doc_id"), cosine(F.col(vector), q).alias("score")), k)


def ranked(scored: DataFrame, k: int | None) -> DataFrame:
    """The ``k`` best rows (a top-k, not a global sort) with their rank from 1."""
    best = scored.orderBy(F.desc("score"), "doc_id")
    best = best.limit(k) if k else best
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def _both(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    a = keyword.select("doc_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    b = vector.select("doc_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    return a.join(b, "doc_id", "full")


def fuse_rrf(keyword: DataFrame, vector: DataFrame, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two result lists (doc_id, score, rank)."""
    score = F.coalesce(1 / (rrf_k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1 / (rrf_k + F.col("vector_rank")), F.lit(0.0))
    return ranked(_both(keyword, vector).withColumn("score", score), k)


def fuse_weighted(keyword: DataFrame, vector: DataFrame, k: int = 10, weight: float = 0.5) -> DataFrame:
    """Keyword scores over their maximum and vector scores, weighted."""
    top = F.max("bm25_score").over(Window.partitionBy())  # result lists are a few rows
    both = _both(keyword, vector).withColumn("top", F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0)))
    score = weight * F.coalesce(F.col("bm25_score") / F.col("top"), F.lit(0.0)) + (1 - weight) * F.coalesce("vector_score", F.lit(0.0))
    return ranked(both.withColumn("score", score).drop("top"), k)


def fuse_interleave(keyword: DataFrame, vector: DataFrame, k: int = 10) -> DataFrame:
    """Turns: the next unseen keyword result, then the next unseen vector result; the score falls by 1/k a place."""
    ordered = lambda df: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"]).alias("ids"))  # noqa: E731  k rows
    lists = ordered(keyword).select(F.col("ids").alias("a"), F.lit(1).alias("one")).join(ordered(vector).select(F.col("ids").alias("b"), F.lit(1).alias("one")), "one")

    def turn(acc: Column, i: Column) -> Column:
        fresh = lambda c: F.filter(c, lambda x: ~F.array_contains(acc, x))
        return F.concat(acc, F.slice(F.when(i % 2 == 1, fresh(F.col("a"))).otherwise(fresh(F.col("b"))), 1, 1))

    out = lists.select(F.aggregate(F.sequence(F.lit(1), F.lit(2 * k)), F.slice(F.col("a"), 1, 0), turn).alias("ids"))
    places = out.select(F.posexplode(F.slice("ids", 1, k)).alias("pos", "doc_id"))
    return places.select("doc_id", (1 - F.col("pos") / k).alias("score"), (F.col("pos") + 1).alias("rank"))


def rerank_by_keyword(keyword: DataFrame, vector: DataFrame, k: int = 10) -> DataFrame:
    """Of the 2k first vector results: score times one plus the keyword score over its maximum."""
    top = keyword.agg(F.max("score").alias("top")).withColumn("one", F.lit(1))
    own = keyword.select("doc_id", F.col("score").alias("bm25_score"))
    rows = vector.where(F.col("rank") <= 2 * k).withColumn("one", F.lit(1)).join(top, "one", "left").join(own, "doc_id", "left")
    boost = 1 + F.coalesce(F.col("bm25_score") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0))
    return ranked(rows.select("doc_id", (F.col("score") * boost).alias("score")), k)


def rerank_by_vector(keyword: DataFrame, vector: DataFrame, k: int = 10) -> DataFrame:
    """Of the 2k first keyword results: score times one plus the vector score."""
    own = vector.select("doc_id", F.col("score").alias("vector_score"))
    rows = keyword.where(F.col("rank") <= 2 * k).join(own, "doc_id", "left")
    return ranked(rows.select("doc_id", (F.col("score") * (1 + F.coalesce("vector_score", F.lit(0.0)))).alias("score")), k)


def contains_all(docs: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Rows in which every term occurs in some column, whatever the case."""
    any_of = lambda t: reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t.lower())) for c in columns])
    return docs.where(reduce(Column.__and__, [any_of(t) for t in terms], F.lit(True)))
