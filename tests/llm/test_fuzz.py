"""Random texts over the alphabets that the patterns are about, against the plain versions."""

from __future__ import annotations

import random

from strataloom.llm import queries as Q
from strataloom.llm.pii import find_pii
from strataloom.llm.secrets import secret_scan
from strataloom.llm.substring_dedup import substring_dedup
from strataloom.llm.ngram_join import ngram_join
from tests.llm import brute
from tests.llm.test_edges import by_id


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)


def test_personal_data(spark):
    r = random.Random(11)
    bits = ["a", "@", ".", "-", "_", "+", " ", "(", ")", "0", "1", "25", "255", "256", "0255", "4111 1111 1111 1111", "4111-1111-1111-1111", "\U0001f600", "é", "\n", "x@y.z", "10.0.0.1", "+1 555", "4012888888881881", "55555"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    got = by_id(find_pii(table(spark, texts)))
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["pii"] if s["kind"] in ("email", "ip", "card", "phone")] == brute.personal(t), t


def test_secrets(spark):
    r = random.Random(12)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ſecret", "toKen", ":", "=", " ", '"', "'", "\t", "abcdef", "0123456789", "deadbeef", "AKIA", "AKIAABCDEFGHIJ", "Z9", "+/=", "_.-", "é", "\U0001f600"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    got = by_id(secret_scan(table(spark, texts)))
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["secrets"] if s["kind"] != "format"] == sorted((s for v in brute.secrets(t).values() for s in v), key=lambda s: (s[1], ("assign", "access", "hex").index(s[0]))), t


def test_repeated_windows_and_links(spark):
    r = random.Random(13)
    words = ["A", "a", "b", "c", "\x1cd", " ", "e f", "İ"]
    few = lambda n: " ".join(r.choice(words[:3]) for _ in range(n))
    parts = [" ".join(r.choice(words) for _ in range(r.randrange(15, 60))) for _ in range(12)]
    texts = [r.choice([" ", "\n", "\t \r"]).join(r.choice([r.choice(parts), few(r.randrange(1, 30))]) for _ in range(r.randrange(1, 5))) for _ in range(300)]
    docs = list(enumerate(texts))
    df = table(spark, texts)
    import hashlib

    digest = lambda x: hashlib.sha256((x["kept_text"] or "").encode()).hexdigest()
    assert {i: (x["n_words"], x["n_removed"], digest(x)) for i, x in by_id(substring_dedup(df)).items()} == brute.kept_words(docs)
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in by_id(ngram_join(df)).items()} == brute.near_duplicates(docs)


def test_round_trip_digests_of_odd_texts(spark):
    import hashlib

    from tokenizers import Tokenizer

    from strataloom.llm.bpe_tables import round_trip_digests

    path = f"{Q.TOKENIZERS}/byte_bpe_50k.json"
    tok = Tokenizer.from_file(path)
    r = random.Random(14)
    bits = ["'s", "'LL", "don't", " ", "  ", "\n", "\r\n", "\t", " ", " ", "1234", "½", "é", "é", "世界", "\U0001f468‍\U0001f469", "<|endoftext|>", "<|", "|>", "_", "abc", "ABC", "zqxjk", "\x00", "﻿", "ﬁ", "٣", "!?", "---"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(2000)]
    got = by_id(round_trip_digests(table(spark, texts), path))
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), repr(t)
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest(), repr(t)
