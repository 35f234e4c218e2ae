"""Every registered query of the subpackage over a whole small scale, against the plain versions."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataloom.llm import queries as Q
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_ngram_join(spark, docs):
    got = by_id(Q.op1_ngram_join(spark, SF))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.near_duplicates(docs)


def test_secret_scan(spark, docs):
    got = by_id(Q.op2_secret_scan(spark, SF))
    assert len(got) == len(docs)
    for i, text in docs:
        want, r = brute.secrets(text), got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(want[k]) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == brute.secrets_digest(text)
        spans = set(filter(None, r["spans"].split(",")))
        assert spans >= {f"{k}:{a}:{b}" for v in want.values() for k, a, b in v}


def test_substring_dedup(spark, docs):
    got = by_id(Q.op3_substring_dedup(spark, SF))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == brute.kept_words(docs)


def test_topk(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in Q.op4_topk(spark, SF).collect())
    assert got == brute.best(vectors)


def test_bpe(spark, docs):
    tok = Tokenizer.from_file(f"{Q.TOKENIZERS}/byte_bpe_50k.json")
    got = by_id(Q.op5_bpe(spark, SF))
    assert len(got) == len(docs)
    for i, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def packed_well(rows, docs, tok, seq_len=2048):
    """Pieces cover each document's ids once, sequences are gapless; returns the share of padding."""
    import zlib

    whole = {i: np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs}
    own, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(whole[r["doc_id"]])
    for spans, total in [(own[i], len(x)) for i, x in whole.items()] + [(s, None) for s in seqs.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= seq_len
    used = sum(map(len, whole.values()))
    padded = 0
    for s in seqs.values():
        n = sum(x for _, x in s)
        padded += 0 if n & (n - 1) == 0 else seq_len - n
    return padded / (used + padded)


def test_packing(spark, docs):
    tok = Tokenizer.from_file(f"{Q.TOKENIZERS}/word_bpe_49k.json")
    assert packed_well(Q.op6_packing(spark, SF).collect(), docs, tok) < 0.02


def test_pii(spark, docs):
    got = by_id(Q.op7_pii(spark, SF))
    assert len(got) == len(docs)
    for i, text in docs:
        want = brute.personal(text)
        assert got[i]["base_sha256"] == brute.digest(want), i
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, got[i]["spans"].split(","))) >= {f"{k}:{a}:{b}" for k, a, b in want}


def test_warc(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in Q.op8_warc(spark, SF).collect())
    assert got == brute.archived(pages)


def test_quality_learns_from_the_other_rows_only(spark):
    sf = "/root/testdata/sf0.01"
    got = by_id(Q.op9_quality(spark, sf))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == brute.is_held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(labels[i], r["predicted"]) for i, r in got.items() if i in labels and r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) >= 0.9


def test_embedding_dedup(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = by_id(Q.op10_embedding_dedup(spark, SF), "vec_id")
    want = brute.vector_groups(vectors)
    assert set(got) == set(want)
    links = sum(n for n, _ in want.values())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * links
    assert all(r["n_links"] <= want[i][0] and r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert sum(r["component_id"] == want[i][1] for i, r in got.items()) >= 0.99 * len(want)
