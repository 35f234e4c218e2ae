"""The repair of conversations against a plain search over edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from strataloom.llm import conversations
from strataloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for c, t, r, x in rows:
        shown = [" " if v is None else str(v) for v in (c, t)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 1:
            x = ""
        if kind == 2:
            x = re.sub("[.!?]", "", x)
        if kind == 4:
            r = "user"
        out += [(c, t, r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def search(turns):
    """(cost, audit, lines) of the cheapest edits over (role, text, must go, extra): all states, all insertions."""
    best = {"": (0, "", ())}

    def keep(at, state, way):
        if state not in at or way[:2] < at[state][:2]:
            at[state] = way

    def with_insertions(at):
        at = dict(at)
        for _ in range(3):
            for state, (cost, audit, lines) in list(at.items()):
                made = "assistant" if state == "u" else "user"
                keep(at, made[0], (cost + 3, audit + "I", (*lines, f"{made}:")))
        return at

    for role, text, must_go, extra in turns:
        after = {}
        for state, (cost, audit, lines) in with_insertions(best).items():
            keep(after, state, (cost + 4, audit + "D", lines))
            if must_go:
                continue
            made = "assistant" if state == "u" else "user"
            keep(after, made[0], (cost + 3 + extra, audit + "R", (*lines, f"{made}:{text}")))
            if role[:1] == made[0] or (role[:1] == "s" and state == ""):
                keep(after, role[:1], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
        best = after
    return min((w for s, w in with_insertions(best).items() if s in ("", "a")), key=lambda w: w[:2])


def plain(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults, judged = set(), [], []
        for _, _, role, text in turns:
            core = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
            seen.add((role, text))
            judged.append((role, text, faults[-1] in ("blank", "duplicate"), 3 if faults[-1] == "truncated" else 0))
        cost, audit, lines = search(judged)
        there = [t for _, t, _, _ in turns if t is not None]
        broken = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), broken, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, m int")
    df.repartition(4).write.mode("overwrite").parquet(f"{at}/conversations.parquet")
    got = Q.op12_conversation_repair(spark, at).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in NAMES) for r in got}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in Q.op12_conversation_repair(spark, SF).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("block,fan", [(8, 4), (256, 64)])
def test_random_long_and_null(spark, tmp_path, monkeypatch, block, fan):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", fan)
    rng = random.Random(block)
    rows = []
    for conv, n in [(1, 500), (None, 40), *((c, rng.randint(1, 9)) for c in range(2, 60))]:
        for t in range(n):
            role = rng.choice(["user", "assistant", "system", "tool", None, "assistant", "user", ""])
            text = rng.choice(["", "Hello.", f"Is it {t}?", f"cut {t}", " \n\t", None, f"Yes {t}. ", f"Fine {t % 50}.", f"é {t}!", "a\nb."])
            rows.append((conv, rng.choice([t, t, t, None, t // 2]), role, text))
    assert run(spark, rows, tmp_path) == plain(rows)


def test_hot_conversation_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    df = spark.range(1000).selectExpr("0L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Turn ', id, '.') as text")
    done = conversations.repair(df)
    assert done.turns.count() >= 1000 / 16
    assert [(r["role"], r["text"]) for r in done.rows().orderBy("place").collect()] == [("assistant" if i % 2 else "user", f"Turn {i}.") for i in range(1000)]
    assert done.found.first()["audit"] == "K" * 1000


def test_long_text_nothing_left_and_no_rows(spark, tmp_path):
    dropped = next(c for c in range(10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(dropped, 1, "user", "Gone."), (dropped + 1, None, None, None), (dropped + 2, 3, "user", "word " * 100_000 + ".")]
    got = run(spark, rows, tmp_path / "a")
    assert got == plain(rows) and got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, [], tmp_path / "b") == {}
