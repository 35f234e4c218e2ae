"""The Merkle manifest against a plain tree in Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strataloom.llm import queries as Q
from strataloom.llm.merkle import fold, leaf_digest, proof_digest, prove

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each leaf its siblings (left, right) from its level up."""
    steps: list[list[tuple[str, str]]] = [[] for _ in nodes]
    at, level = list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, where in enumerate(at):
            run, place = runs[where // fanout], where % fanout
            steps[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
        at, level = [w // fanout for w in at], [sha("".join(r)) for r in runs]
    return level[0], steps


def manifest(rows, fanout=16):
    """rows (doc_id, source, lang, n_chars, text) -> sorted results of the query."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: (sorted(by[s], key=lambda x: x[:3]),) for s in order}
    for s in order:
        inner[s] += climb([x[2] for x in inner[s][0]], fanout)
    root, above = climb([inner[s][1] for s in order], fanout)
    out = []
    for s, up in zip(order, above):
        leaves, subroot, steps = inner[s]
        for (_, _, leaf, r), own in zip(leaves, steps):
            proof = own + up
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                at = leaf_of(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in proof:
                at = sha(left + at + right)
            out.append((r[0], leaf, subroot, root, sha("".join(left + right for left, right in proof)), at, at == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r[c] for c in NAMES) for r in Q.op11_merkle(spark, SF).collect()), key=repr)
    assert got == manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def run(spark, rows, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA + ", tree string, proof int").repartition(3).write.parquet(f"{at}/documents.parquet")
    return sorted((tuple(r[c] for c in NAMES) for r in Q.op11_merkle(spark, at).collect()), key=repr)


def test_nulls_repeats_and_uneven_trees(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else "big" if i % 3 else "é", None if i % 5 == 0 else "en", i, f"Text {i}" if i % 4 else None) for i in range(300)]
    rows += [(1000, "lone", "de", None, ""), (None, "big", "en", 1, "A" * 200_000), (5, "é", "en", 5, "again"), (5, "é", "en", 5, "again"), (-3, "", "x", 0, "Z é")]
    rows += [(2000 + i, f"s{i:02d}", "en", 1, "Same") for i in range(40)]  # a tree of trees of three levels
    assert run(spark, [(*r, "x", 1) for r in rows], tmp_path) == manifest(rows)


def test_empty_and_single(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == []
    one = [(7, None, None, None, None)]
    got = run(spark, [(*r, None, None) for r in one], tmp_path / "one")
    assert got == manifest(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_any_change_is_seen(spark):
    rows = spark.range(50).select("id", (F.col("id") % 3).cast("string").alias("g"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    leaves = rows.withColumn("leaf", leaf_digest(F.col("id"), F.col("g"), F.col("text")))
    done = prove(leaves, "g", ["id"], fanout=2)
    other = leaf_digest(F.col("id"), F.col("g"), F.concat("text", F.lit("!")))
    seen = done.agg(F.min(fold(F.col("leaf"), F.col("proof")) == F.col("root")), F.max(fold(other, F.col("proof")) == F.col("root")), F.countDistinct(proof_digest(F.col("proof"))), F.countDistinct("root")).first()
    assert tuple(seen) == (True, False, 50, 1)
