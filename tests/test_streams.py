"""Streams with state: a restart changes nothing, late rows, plain loops."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataloom.streaming import stateful as T
from strataloom.streaming.activity import drained

START = dt.datetime(2024, 1, 1)
SCHEMA = "session long, at timestamp, place long, action string, is_error boolean, nodes long"


def turns(seed, n=400):
    r = random.Random(seed)
    nodes, out = defaultdict(int), []
    for i in range(n):
        s = r.randrange(6)
        nodes[s] += r.random() < 0.4
        action = r.choice(["ls", " LS ", "cat  a", "grep", "ls", "cat a"])
        out.append((s, START + dt.timedelta(seconds=20 * i), i, action, r.random() < 0.4, nodes[s]))
    return out


def files(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")


def stream(spark, folder):
    return T.with_state_store(spark).readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(folder)


def plain(rows):
    own, out = defaultdict(list), []
    for s, _, _, action, error, nodes in sorted(rows, key=lambda r: (r[1], r[2])):
        own[s].append((" ".join(action.split()).lower(), error, nodes))
        found = T.failure_of(own[s], T.REPEATS, T.STALL, T.ERRORS)
        if found:
            out.append((s, len(own[s]), *found))
    return sorted(out)


def test_watch_restarted_is_as_one_run(spark, tmp_path):
    rows = turns(1)
    parts = [rows[:150], rows[150:300], rows[300:]]
    files(spark, f"{tmp_path}/in", parts[:2])
    drained(T.watched(stream(spark, f"{tmp_path}/in"), idle=10**9), f"{tmp_path}/out")
    spark.createDataFrame(parts[2], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part=2")
    got = drained(T.watched(stream(spark, f"{tmp_path}/in"), idle=10**9), f"{tmp_path}/out")
    assert sorted(tuple(r) for r in got.drop("batch").collect()) == plain(rows)


def test_late_and_idle(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    first = [(1, at(1000), 1, "ls", False, 1), (1, at(1001), 2, "ls", False, 1), (2, at(1000), 3, "a", True, 1)]
    second = [(1, at(900), 4, "ls", False, 1), (1, at(1100), 5, "LS", False, 1), (2, at(9000), 6, "b", True, 2), (2, at(100), 7, "b", True, 2)]
    third = [(1, at(9100), 8, "ls", False, 1), (None, at(9100), 9, "ls", False, 1)]
    fourth = [(3, at(100), 10, "q", False, 1), (2, at(9200), 11, "b", True, 2)]
    files(spark, f"{tmp_path}/in", [first, second, third, fourth])
    got = sorted(tuple(r) for r in drained(T.watched(stream(spark, f"{tmp_path}/in"), "10 minutes", 3_600_000), f"{tmp_path}/out").drop("batch").collect())
    # Seconds 900 and 100 are before their sessions' last turns; both sessions have ended before their next. Session 3 is behind the watermark and dropped.
    assert got == [(1, 2, "late", "ls"), (1, 3, "idle", ""), (1, 3, "repetition_loop", "ls"), (2, 1, "idle", ""), (2, 1, "late", "b")]


@pytest.mark.parametrize("history", [7, 1000])
def test_histories(spark, tmp_path, history):
    rows = turns(2, 120)
    files(spark, f"{tmp_path}/in", [rows[:50], rows[50:]])
    labels = F.when(F.col("session") < 3, F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.col("action")))
    seen = stream(spark, f"{tmp_path}/in").select(F.lit("n").alias("name"), labels.alias("labels"), "at", "place", F.when(F.col("place") % 11 > 0, F.col("nodes") * 1.5).alias("value"))
    last = {}
    for r in drained(T.metric_histories(seen, history), f"{tmp_path}/out", "update").orderBy("batch").collect():
        last[r["metric"]] = tuple(r)[1:9]
    own = defaultdict(list)
    for s, at, place, action, _, nodes in rows:
        if place % 11:
            own[f"n{{a={action},z=1}}" if s < 3 else "n"].append(nodes * 1.5)
    assert last.keys() == own.keys()
    for metric, values in own.items():
        assert last[metric][0] == pytest.approx(sum(values))
        assert last[metric][1:] == pytest.approx(T.figures(values[-history:]))


def test_due(spark, tmp_path):
    rows = [(i % 2, START, i // 2 % 7, "x", False, 0) for i in range(60)]
    files(spark, f"{tmp_path}/in", [rows[:8], rows[8:20], rows[20:]])
    items = stream(spark, f"{tmp_path}/in").select(F.col("session").cast("string").alias("scope"), F.col("place").alias("id"))
    got = sorted(tuple(r) for r in drained(T.consolidation_due(items, 6), f"{tmp_path}/out", "update").drop("batch").collect())
    assert got == [("0", 1, 7), ("0", 2, 7), ("1", 1, 7), ("1", 2, 7)]
