"""Streams with state a key: failure watch, metric histories, a trigger for consolidation.

State is kept by ``transformWithState`` (it needs the RocksDB provider, see ``with_state_store``): values, lists and maps for
each key, bounded whatever the length of the stream, with timers and times to live. A query that is started again from its
checkpoint goes on where it was.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The runner that Spark starts for state on the driver's side has no path to this package: send these classes whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns of one action, turns without progress and errors in a row that count as failures.
REPEATS, STALL, ERRORS = 3, 4, 3
HISTORY = 1000  # values of a metric that are kept
_TURN = "action string, is_error boolean, nodes long"
_WATCHED = "session long, turn long, failure string, detail string"
_MEASURED = "metric string, total double, count long, min double, max double, mean double, median double, p95 double, p99 double"
_DUE = "scope string, round long, items long"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, set to keep stream state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def failure_of(turns: list[tuple], repeats: int, stall: int, errors: int) -> tuple[str, str] | None:
    """The first failure that the last turns (action, is_error, nodes) show: errors in a row, one action again and again, a circle of two or three, no progress."""
    actions = [t[0] for t in turns]
    if len(turns) >= errors and all(t[1] for t in turns[-errors:]):
        return "explicit_error", actions[-1]
    if len(turns) >= repeats and len(set(actions[-repeats:])) == 1:
        return "repetition_loop", actions[-1]
    for n in (2, 3):
        if len(turns) >= 2 * n and actions[-2 * n : -n] == actions[-n:]:
            return "circular_pattern", " > ".join(actions[-n:])
    if len(turns) >= stall and turns[-1][2] is not None and turns[-1][2] == turns[-stall][2]:
        return "progress_stall", str(stall)
    return None


class _Watch(StatefulProcessor):
    def __init__(self, repeats: int, stall: int, errors: int, idle_ms: int):
        self.limits, self.idle, self.keep = (repeats, stall, errors), idle_ms, max(6, repeats, stall, errors)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", _TURN)
        self.at = handle.getValueState("at", "turn long, last long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, last, timer = self.at.get() if self.at.exists() else (0, -1, -1)
        turns = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        out = []
        for r in sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: (r.ms, r.place)):
            if r.ms < last:
                out.append((key[0], turn, "late", r.action))
                continue
            if last >= 0 and r.ms >= last + self.idle:
                out.append((key[0], turn, "idle", ""))
                turn, turns = 0, []
            turn, last = turn + 1, int(r.ms)
            turns = [*turns, (r.action, bool(r.is_error), None if pd.isna(r.nodes) else int(r.nodes))][-self.keep :]
            found = failure_of(turns, *self.limits)
            if found:
                out.append((key[0], turn, *found))
        self.turns.put(turns)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = last + self.idle
        self.handle.registerTimer(timer)
        self.at.update((turn, last, timer))
        yield pd.DataFrame(out, columns=["session", "turn", "failure", "detail"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn = self.at.get()[0] if self.at.exists() else 0
        self.turns.clear()
        self.at.clear()
        yield pd.DataFrame([(key[0], turn, "idle", "")], columns=["session", "turn", "failure", "detail"])

    def close(self) -> None:
        pass


def watched(events: DataFrame, late: str = "10 minutes", idle: str | int = 3_600_000, repeats: int = REPEATS, stall: int = STALL, errors: int = ERRORS) -> DataFrame:
    """(session, turn, failure, detail) of a stream (session, at, place, action, is_error, nodes): what each turn shows to have failed.

    Turns go by time, then place. One that comes before the session's last turn is ``late`` and counts for nothing; one behind
    the watermark is dropped. A session without turns for ``idle`` milliseconds of event time ends: ``idle``, its state is
    removed, and a later turn is its first again. Actions are compared in lower case, single spaces. The state of a session is
    its last few turns.
    """
    action = F.lower(F.trim(F.regexp_replace(F.coalesce("action", F.lit("")), r"\s+", " ")))
    rows = events.where("session is not null and at is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    rows = rows.select(F.col("session").cast("long").alias("session"), "at", F.unix_millis("at").alias("ms"), F.col("place").cast("long").alias("place"), action.alias("action"), F.coalesce("is_error", F.lit(False)).alias("is_error"), F.col("nodes").cast("long").alias("nodes"))
    return rows.groupBy("session").transformWithStateInPandas(_Watch(repeats, stall, errors, int(idle)), _WATCHED, "Append", "eventTime")


def figures(values: list[float]) -> tuple:
    """count, min, max, mean, median and the 95th and 99th percentile (the largest while there are fewer than 20 and 100)."""
    v, n = sorted(values), len(values)
    middle = v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2
    return n, v[0], v[-1], sum(v) / n, middle, v[int(n * 0.95)] if n >= 20 else v[-1], v[int(n * 0.99)] if n >= 100 else v[-1]


def _sum(values) -> float:
    """Rounded once; as plain sums go where that overflows or infinite values meet."""
    try:
        return math.fsum(values)
    except (OverflowError, ValueError):
        return float(sum(values))


class _Histories(StatefulProcessor):
    def __init__(self, history: int):
        self.history = history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total double")
        self.values = handle.getListState("values", "at long, place long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame([tuple(v) for v in self.values.get()] if self.values.exists() else [], columns=["at", "place", "value"])
        sums = [self.total.get()[0] if self.total.exists() else 0.0]
        for b in rows:  # of each frame only its sum and its last values stay
            new = pd.DataFrame({"at": b["ms"].astype("int64"), "place": b["place"].astype("int64"), "value": b["value"].astype("float64")})
            sums.append(_sum(new["value"]))
            kept = pd.concat([kept, new], ignore_index=True).sort_values(["at", "place", "value"]).tail(self.history) if len(kept) else new.sort_values(["at", "place", "value"]).tail(self.history)
        held = list(zip(kept["at"].astype("int64").tolist(), kept["place"].astype("int64").tolist(), kept["value"].tolist()))
        total = _sum(sums)
        self.total.update((total,))
        self.values.put(held)
        yield pd.DataFrame([(key[0], total, *figures([v for *_, v in held]))], columns=["metric", "total", "count", "min", "max", "mean", "median", "p95", "p99"])

    def close(self) -> None:
        pass


def metric_key(name, labels) -> F.Column:
    """``name{a=1,b=2}``: a metric's name with its labels (a map) in order; the name alone without any."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(name, F.lit("{"), pairs, F.lit("}"))).otherwise(name)


def metric_histories(observations: DataFrame, history: int = HISTORY) -> DataFrame:
    """(metric, total, count, min, ...) of a stream (name, labels map, at, place, value), anew for each metric with new values.

    ``total`` sums all values, the figures are of the last ``history`` ones by time, then place. Null values count for
    nothing. The state of a metric is its total and that many values.
    """
    rows = observations.where("name is not null and value is not null")
    rows = rows.select(metric_key(F.col("name"), F.col("labels")).alias("metric"), F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value"))
    return rows.where("ms is not null").groupBy("metric").transformWithStateInPandas(_Histories(history), _MEASURED, "Update", "None")


class _Due(StatefulProcessor):
    def __init__(self, threshold: int, ttl_ms: int | None):
        self.threshold, self.ttl = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "id long", "one boolean", self.ttl)
        self.rounds = handle.getValueState("rounds", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = np.asarray([k[0] for k in self.waiting.keys()], np.int64)
        fresh, few = np.zeros(0, np.int64), []
        for b in rows:  # eight bytes for each different id of a batch; frames are joined once they are as many as what there is
            few.append(np.unique(b["id"].to_numpy(np.int64)))
            if sum(map(len, few)) >= len(fresh):
                fresh, few = np.unique(np.concatenate([fresh, *few])), []
        fresh = np.unique(np.concatenate([fresh, *few]))
        waiting = len(np.union1d(before, fresh))
        out = []
        if waiting < self.threshold:
            for i in fresh.tolist():
                self.waiting.updateValue((i,), (True,))
        else:
            n = (self.rounds.get()[0] if self.rounds.exists() else 0) + 1
            self.rounds.update((n,))
            self.waiting.clear()
            out.append((key[0], n, waiting))
        yield pd.DataFrame(out, columns=["scope", "round", "items"])

    def close(self) -> None:
        pass


def consolidation_due(items: DataFrame, threshold: int = 20, ttl_ms: int | None = None) -> DataFrame:
    """(scope, round, items) of a stream of new items (scope, id): once as many different ones wait as the threshold, after which none wait.

    An item that comes again while it waits counts once; with ``ttl_ms`` it stops waiting after that time. The state of a
    scope is less than the threshold and one batch.
    """
    rows = items.where("scope is not null and id is not null").select(F.col("scope").cast("string").alias("scope"), F.col("id").cast("long").alias("id"))
    return rows.groupBy("scope").transformWithStateInPandas(_Due(threshold, ttl_ms), _DUE, "Update", "processingTime" if ttl_ms else "None")
