"""Encoding and decoding of document tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Vocabulary, codec, ship_lexicon


def _rows(df: DataFrame, used: str, out: tuple[str, ...]) -> DataFrame:
    keep = [F.col(f"`{c}`") for c in df.columns if c != used and c not in out]
    return df.select(F.struct(*keep).alias("_row"), F.col(used).alias("_used"))


def encode_table(docs: DataFrame, tokenizer_path: str, words: list[bytes] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of ``text``; a null text is an empty one. Rows are independent of each other."""
    name = ship_lexicon(docs.sparkSession, Vocabulary(tokenizer_path), words)
    rows = _rows(docs, "text", ("ids",))

    def run(batches):
        c = codec(tokenizer_path, name)
        for batch in batches:
            got = [c.encode(t or "").astype(np.int32) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))], names=["_row", "ids"])

    return rows.mapInArrow(run, T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])).select("_row.*", "ids")


def decode_table(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``; null ids are none. Rows are independent of each other."""
    rows = _rows(encoded, "ids", ("text",))

    def run(batches):
        c = codec(tokenizer_path, None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["_row", "text"])

    return rows.mapInArrow(run, T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("text", T.StringType())])).select("_row.*", "text")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, words: list[bytes] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, its ids decoded again, and both digested.

    A null text is an empty one. Rows are independent of each other; only doc_id and text of ``docs`` are read.
    """
    name = ship_lexicon(docs.sparkSession, Vocabulary(tokenizer_path), words)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        c = codec(tokenizer_path, name)
        decimal = [str(i) for i in range(len(c.vocab.bytes_of))]
        for batch in batches:
            out = [[], [], []]
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "").tolist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
