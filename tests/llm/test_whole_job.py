"""Places where an operator once did less than its whole job, against plain versions."""

from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from strataloom.llm import queries as Q
from strataloom.llm.embedding_dedup import embedding_dedup
from strataloom.llm.packing import WordEncoder
from strataloom.llm.secrets import automata, find_spans, labelled_credentials
from tests.llm import brute


def test_packing_of_decomposed_accents():
    path = f"{Q.TOKENIZERS}/word_bpe_49k.json"
    tok, enc = Tokenizer.from_file(path), WordEncoder(path)
    for text in ("cafe\u0301", "Andre\u0301,", "un cafe\u0301. Andre\u0301, voila\u0300!", "\u0130,", "\u0915\u093c, \u0958,", "\u1100\u1161\u11a8.", "\u039f\u03a3, caf\u00e9,"):
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_credentials_of_every_kind_in_ordinary_places():
    """New credentials (another seed, some without a digit); about one in a hundred scores below all of the labelled ones."""
    models = automata()
    for kind, tokens in labelled_credentials(seed=99).items():
        for before, after in (("", ""), ("PAT=", ""), ("https://host/", ""), ("use ", ".")):
            found = sum((len(before), len(before) + len(t)) in [s[:2] for s in find_spans(before + t + after, models)] for t in tokens)
            assert found >= 0.97 * len(tokens), (kind, before, after, found)
    assert find_spans("sk_live_" + "QwErTyUiOpAsDfGhJkLzXcVb", models) == [(0, 32, "format")]
    assert find_spans("https://example.com/some-long_path/of/words.html well-known_identifier_names", models) == []


def test_ordinary_tokens_are_no_credentials():
    r, models = random.Random(3), automata()
    low = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10)))
    make = [
        lambda: "_".join(low() for _ in range(4)),
        lambda: f"https://{low()}.com/{low()}/{low()}?id={r.randrange(10**6)}",
        lambda: "".join(low().capitalize() for _ in range(4)),
        lambda: f"{low()}-{r.randrange(2000, 2030)}-{r.randrange(1, 13):02d}-{low()}_{low()}.tar.gz",
        lambda: "com." + ".".join(low() for _ in range(4)) + low().capitalize() + "Factory",
        lambda: low() + "=" + "".join(r.choice("0123456789") for _ in range(18)),
        lambda: "-".join(f"{r.randrange(16**n):0{n}X}" for n in (8, 4, 4, 4, 12)),
        lambda: f"/usr/lib/{low()}/{low()}.so.{r.randrange(10)}.{r.randrange(10)}",
    ]
    wrong = [t for f in make for t in (f() for _ in range(1000)) if any(k == "format" for *_, k in find_spans(t, models))]
    assert len(wrong) <= 0.001 * 8000, wrong[:5]


def crowded_vectors():
    """A third in a cone of mutual cosine about 0.64, and pairs at 0.952 within it and outside."""
    r = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    axis, wide = np.eye(64)[:1], unit(r.standard_normal((1400, 64)))
    cone = unit(0.8 * axis + 0.6 * unit(r.standard_normal((700, 64))))
    first = np.concatenate([wide, cone])[::7]
    aside = r.standard_normal(first.shape)
    aside = unit(aside - (aside * first).sum(axis=1, keepdims=True) * first)
    near = 0.952 * first + np.sqrt(1 - 0.952**2) * aside
    return [(i, v.tolist()) for i, v in enumerate(np.concatenate([wide, cone, near]))]


def test_embedding_links_do_not_depend_on_partitions(spark):
    rows = crowded_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()
    want, got = brute.vector_groups(rows), {}
    try:
        for parts in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got[parts] = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding_dedup(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got[1] == got[8] == got[200]
    assert sum(got[8][i] == want[i] for i in want) >= 0.99 * len(want)
