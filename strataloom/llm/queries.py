"""The registered queries of the training-data operators, thin over the operators themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

TOKENIZERS = "/opt/tokenizers"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    from .secrets import secret_scan

    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), redacted=False)
    of = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "format")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when repeated windows are removed."""
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every query vector."""
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """Ids of every document, and the text that they decode to, as digests."""
    from .bpe_tables import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path)


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    from .packing import pack, pieces

    return pack(written(pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path), "pack-pieces"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    from .pii import BASE, find_pii

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from .quality import quality

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), with_text=False).select("doc_id", "held_out", "score", "predicted")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate vectors."""
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place under the root of all, and whether a changed text still leads there."""
    from .merkle import fold, leaf_digest, proof_digest, prove

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    digest = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    leaves = docs.select("doc_id", "source", digest(F.col("text")).alias("leaf"), F.when(tampered, digest(lowered)).alias("changed"))
    proved = prove(leaves, "source", ["doc_id"]).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with the faults that the contract plants by a checksum of their place."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair, and a digest of what that leaves."""
    from .conversations import repair

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damaged(given))
    all_of = lambda df, tag: df.withColumnRenamed("conv_id", tag)
    out = given.select("conv_id").distinct().join(all_of(done.found, "f"), F.col("conv_id").eqNullSafe(F.col("f")), "left")
    out = out.join(all_of(done.digests(), "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found of every query vector."""
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_secret_scan, op3_substring_dedup, op4_topk, op5_bpe, op6_packing, op7_pii, op8_warc, op9_quality, op10_embedding_dedup, op11_merkle, op12_conversation_repair, op13_ann)}


def oracle_sql() -> dict[str, str]:
    from .twins import SQL

    return SQL
