"""The pipeline, stage by stage over whole inputs against plain versions of the same decisions."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from strataloom.llm import queries as Q
from strataloom.llm.common import table, written
from tests.llm import brute
from tests.llm.test_contract import packed_well

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """The input of every stage and the last one's result, each as rows."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        out.append(docs.collect())
        docs = written(stage(spark, docs, SF), f"test-{name}")
    return [*out, docs.collect()]


def texts(rows):
    out = {r["doc_id"]: r["text"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_quality_keeps_what_it_predicts(spark, stages):
    kept = {r["doc_id"] for r in Q.op9_quality(spark, SF).where("predicted = 1").collect()}
    assert texts(stages[1]) == {i: t for i, t in texts(stages[0]).items() if i in kept} and 0 < len(kept) < len(stages[0])


def test_one_of_each_group_stays(stages):
    groups = brute.near_duplicates(list(texts(stages[1]).items()))
    assert texts(stages[2]) == {i: t for i, t in texts(stages[1]).items() if groups[i][1] == i}


def test_repeated_passages_go(stages):
    before, after = texts(stages[2]), texts(stages[3])
    want = brute.kept_words(list(before.items()))
    assert set(after) == {i for i, (n, gone, _) in want.items() if n == 0 or gone < n}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][2] if want[i][1] else t == before[i] for i, t in after.items())
    assert any(gone for _, gone, _ in want.values())


def test_no_secret_is_left_and_no_other_text_changes(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(after) == set(before)
    assert not any(any(brute.secrets(t).values()) for t in after.values())
    assert any(any(brute.secrets(t).values()) for t in before.values())
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4] if r["text"] != before[r["doc_id"]])


def test_packing_holds_all_that_is_left(stages):
    packed_well(stages[5], list(texts(stages[4]).items()), Tokenizer.from_file(f"{Q.TOKENIZERS}/word_bpe_49k.json"))


def test_run_gives_the_stages_rows(spark, stages):
    assert sorted(P.run(spark, SF).collect()) == sorted(stages[5])


def test_stages_over_nulls_extra_columns_and_nothing(spark):
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (None, "token: abcdefghijklm here", None, None, None), (None, None, None, None, None), (3, "some plain words of a text that stays as it is", "en", "s", 46), (3, "some plain words of a text that stays as it is", "en", "s", 46)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("score", "secrets", "kept_text", "component_id", "n_words", "predicted")})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == P.COLUMNS, name
        n = out.count()
        assert n <= len(rows) and (name == "quality" or n == len(rows)), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert P.pack_sequences(spark, docs, SF).count() == len(rows) and P.pack_sequences(spark, docs.limit(0), SF).count() == 0
