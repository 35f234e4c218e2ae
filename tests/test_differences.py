"""Scripts put in give the new text and are shortest; JSON leaves against a walk."""

import json
import random

import pytest

from strataloom.operators import differences as D


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_scripts(seed):
    r = random.Random(seed)
    for _ in range(150):
        a = [r.choice("abcdefgh"[: r.randint(1, 8)]) + "\n" for _ in range(r.randint(0, 25))]
        b = [x for x in a if r.random() < 0.7]
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.choice("abcxyz") + "\n")
        assert len(D.matched(a, b)) == longest(a, b)
        for anchors in (True, False):
            hunks = D.script(a, b, anchors)
            assert D.patched(a, hunks) == b
            if not anchors:
                assert sum(len(h[1]) + len(h[3]) for h in hunks) == len(a) + len(b) - 2 * longest(a, b)


def test_line_differences(spark):
    rows = [(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "new\n"), (3, "same\n", "same\n"), (4, "x\n" * 3000, "x\n" * 2990 + "y"), (5, None, None)]
    got = {r["id"]: r for r in D.line_differences(spark.createDataFrame(rows, "id long, old string, new string"), "id", "old", "new").collect()}
    for i, old, new in rows:
        hunks = [(h["old_start"], h["old_lines"], h["new_start"], h["new_lines"]) for h in got[i]["hunks"]]
        assert "".join(D.patched(D.lines_of(old), hunks)) == (new or "")
    assert (got[1]["additions"], got[1]["deletions"], got[3]["changed"], got[5]["changed"]) == (3, 2, False, False)
    assert (got[4]["additions"], got[4]["deletions"]) == (1, 10)


def walk(v, path="$"):
    if isinstance(v, dict) and v:
        return {p: x for k, c in v.items() for p, x in walk(c, f"{path}.{k}").items()}
    if isinstance(v, list) and v:
        return {p: x for k, c in enumerate(v) for p, x in walk(c, f"{path}[{k}]").items()}
    return {path: v}


def made(r, depth=0):
    kind = r.random()
    if depth < 4 and kind < 0.3:
        return {k: made(r, depth + 1) for k in r.sample("abcd", r.randint(0, 3))}
    if depth < 4 and kind < 0.5:
        return [made(r, depth + 1) for _ in range(r.randint(0, 3))]
    return r.choice([1, 2, "1", "x", True, None, "", [], {}])


def test_json_differences(spark):
    r = random.Random(3)
    rows = [(i, made(r), made(r)) for i in range(60)]
    df = spark.createDataFrame([*((i, json.dumps(a), json.dumps(b)) for i, a, b in rows), (100, "{", "{}"), (101, None, "1")], "id long, old string, new string")
    got = {(x["id"], x["path"]): x["change"] for x in D.json_differences(df, "id", "old", "new").collect()}
    want = {(100, "$"): "changed", (101, "$"): "added"}
    for i, a, b in rows:
        a, b = walk(a), walk(b)
        for p in a.keys() | b.keys():
            if p not in a or p not in b:
                want[i, p] = "added" if p not in a else "removed"
            elif json.dumps(a[p]) != json.dumps(b[p]):
                want[i, p] = "changed"
    assert got == want
    assert D.json_differences(df.limit(0), "id", "old", "new").collect() == []
