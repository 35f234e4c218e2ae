"""A corpus pipeline of five stages: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import Cuts, table, written
from strataloom.llm.ngram_join import ngram_join
from strataloom.llm.packing import pack, pieces
from strataloom.llm.quality import quality
from strataloom.llm.queries import TOKENIZERS
from strataloom.llm.secrets import secret_scan
from strataloom.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null text is scored as an empty one, a null doc_id like any other; repeated rows get one score and stay or go
    together. Other columns than those of documents are dropped. An empty table gives an empty one.
    """
    return quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Documents without an id all stay, and so do those without words and rows that repeat the kept id. Other columns than
    those of documents are dropped. An empty table gives an empty one.
    """
    kept = ngram_join(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; a text without any stays as it is, one of which nothing is left goes.

    A null text stays null, a null id counts as the smallest, rows that repeat id and text are one document and all stay.
    Other columns than those of documents are dropped. An empty table gives an empty one.
    """
    out = substring_dedup(docs.select(*COLUMNS)).where("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark of its kind.

    A text without any, a null one too, stays as it is; rows are looked at one by one, so ids and repeats do not matter.
    Other columns than those of documents are dropped. An empty table gives an empty one.
    """
    out = secret_scan(docs.select(*COLUMNS))
    changed = F.size("secrets") > 0
    return out.withColumn("text", F.when(changed, F.col("redacted_text")).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of at most 2048 tokens.

    A null text is an empty one (its end mark is packed), a null id is kept, repeated rows are pieces of their own. An
    empty table gives no sequences.
    """
    return pack(written(pieces(docs.select("doc_id", "text"), f"{TOKENIZERS}/word_bpe_49k.json"), "pack-pieces"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: No SQL twin: learnt scores, inferred grammars and a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has read is removed once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        cut = Cuts(spark)
        docs = cut.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.clear()
        before = cut
    return STAGES[-1][1](spark, docs, sf_dir)
