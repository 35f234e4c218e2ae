"""Prefix groups and subtrees of substring dedup: every length of prefix gives the brute-force repeats, and only words decide."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from strataloom.llm import substring_dedup as S
from strataloom.llm.ngram_join import ngram_join
from strataloom.llm.words import sequence_hashes, word_hashes
from tests.llm import brute


@pytest.fixture(scope="module")
def docs():
    """A line that nearly all documents hold, among other words, and passages that some do."""
    r = random.Random(21)
    word = lambda: f"w{r.randrange(5000)}"
    line = "all rights reserved by the owners of this page".split()
    passages = [[word() for _ in range(r.randrange(25, 70))] for _ in range(5)]
    out = []
    for i in range(240):
        parts = [[word() for _ in range(r.randrange(0, 60))], line if i % 10 else [], r.choice(passages) if i % 3 == 0 else [word()]]
        r.shuffle(parts)
        out.append((i, " ".join(w for p in parts for w in p)))
    return out


@pytest.mark.parametrize("hot", [1, 30, 20_000])
def test_groups_of_every_prefix_length(spark, docs, monkeypatch, hot):
    """The bound is read where the prefixes are counted: run that step's tasks with another one."""
    monkeypatch.setattr(S, "HOT", hot)
    import pyarrow as pa

    rows = sorted((i, i * 7 + 1, t) for i, t in docs)
    halves = [rows[::2], rows[1::2]]
    counted, known, sent, starts = [], {}, [], {}
    tables = [pa.table({"_id": [x[0] for x in h], "_hash": [x[1] for x in h], "text": [x[2] for x in h]}) for h in halves]
    for p, t in enumerate(tables):
        counted.append(S._count_prefixes(3)((pa.scalar(p),), t))
    one = pa.concat_tables(counted).sort_by("bucket")
    for batch in S._known(one.to_batches()):
        for part, cold, hot_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
            known.setdefault(part, []).append((part, cold, hot_))
    for p, t in enumerate(tables):
        sent.append(S._send(3)((pa.scalar(p),), t, S._table(S._KNOWN_SCHEMA, known[p])))
    kinds = {k for t in sent for k in t.column("kind").to_pylist()}
    assert (S._WHOLE in kinds) == (hot < 20_000) and (S._STRETCH in kinds) == (hot > 1)
    for batch in S._subtrees(pa.concat_tables(sent).sort_by([("bucket", "ascending"), ("kind", "ascending")]).to_batches()):
        for i, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            starts.setdefault(i, []).append(x)
    want = brute.kept_words(docs)
    for i, t in docs:
        gone = np.zeros(len(t.split()), dtype=bool)
        for s in np.frombuffer(b"".join(starts.get(i, [])), "<u4").tolist():
            gone[s : s + 20] = True
        left = " ".join(w for w, g in zip(t.split(), gone) if not g)
        assert (int(gone.sum()), hashlib.sha256(left.encode()).hexdigest()) == want[i][1:]
    assert any(n for _, n, _ in want.values())


def test_ranks_are_the_order_of_the_words():
    """Windows that differ in one word only, in any place, get ranks of their own; equal ones share one."""
    r = random.Random(5)
    base = [f"x{r.randrange(40)}" for _ in range(20)]
    windows = [list(base), list(base)]
    for i in range(20):
        windows.append([*base[:i], "changed", *base[i + 1 :]])
    h, _ = word_hashes([" ".join(w) for w in windows])
    rank = S._ranks(h)[::20]
    assert rank[0] == rank[1] and len(set(rank.tolist())) == 21
    order = sorted(range(len(windows)), key=lambda i: h[20 * i : 20 * i + 20].tolist())
    assert np.all(np.diff(rank[order].astype(np.int64)) >= 0)


def test_equal_prefix_hashes_of_different_words_do_not_join_windows():
    """Stretches that meet in one group by chance, under one prefix, stay apart by their words."""
    ids, hashes = np.arange(2, dtype="<i8"), np.arange(2, dtype="<i8")
    words = np.arange(40, dtype="<u8")
    runs = np.zeros(2, dtype=S._RUN)
    runs["doc"], runs["count"] = [0, 1], 1
    blob = b"".join([np.asarray([2, 2, 40], "<i8").tobytes(), ids.tobytes(), hashes.tobytes(), runs.tobytes(), words.tobytes()])
    rows = S._table(S._SENT_SCHEMA, [(0, S._STRETCH, None, None, blob)])
    assert list(S._subtrees(rows.to_batches())) == []


def test_word_hashes_tell_words_apart():
    r = random.Random(8)
    words = [a + b for a in "abcdefghij" for b in ("", *"abcdefghij0123456789\u00e9\u4e16")] + ["".join(r.choice("ab") for _ in range(n)) for n in range(1, 400)] + ["0" * n for n in range(1, 300)]
    h, n = word_hashes([" ".join(words), None, "", " \n\t", "A b\x1cc \x85d"])
    assert n.tolist() == [len(words), 0, 0, 0, 3]
    of = {}
    for w, x in zip(words, h.tolist()):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)
    assert word_hashes(["Ab \u00c9A"], lower=True)[0].tolist() == word_hashes(["ab \u00c9a"])[0].tolist()
    long = " ".join(f"w{i % 999}" for i in range(700_000)) + " " + "z" * 2_500_000 + " end"
    h, n = word_hashes(["a", long, "b end"])
    assert n.tolist() == [1, 700_002, 2] and h[1] == h[1 + 999 * 600] and h[-1] == h[-3] and len(set(h.tolist())) == 999 + 4


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that a polynomial hash modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_and_runs_made_to_collide(spark, n):
    a, b = thue_morse(n)
    h, _ = word_hashes([f"{a} {b}"])
    assert h[0] != h[1]
    runs = [" ".join({"a": "yes", "b": "no"}[c] for c in t[:16]) for t in (a, b)]
    x, y = (sequence_hashes(word_hashes([r])[0], 16) for r in runs)
    assert x != y
    before = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{before} {a}"), (2, f"{before} {b}")], "doc_id long, text string")
    assert [r["n_removed"] for r in S.substring_dedup(docs).collect()] == [0, 0]
    docs = spark.createDataFrame([(1, f"{a} x y z t"), (2, f"{b} x y z t"), (3, f"{a} x y z t {b} x y z t")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (6, 3)}
