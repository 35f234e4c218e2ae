"""How much work is done: what is read once, kept small, or not done at all."""

from __future__ import annotations

import tracemalloc
import types

import numpy as np
import pandas as pd
import pytest

from strataloom.streaming import stateful as T


class _Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    put = update


class _Map:
    def __init__(self):
        self.held, self.writes = {}, 0

    def keys(self):
        return iter(list(self.held))

    def updateValue(self, key, value):
        self.writes += 1
        self.held[key] = value

    def clear(self):
        self.held = {}


def test_items_that_are_due_at_once_are_never_written():
    waiting, rounds = _Map(), _Value()
    due = T._Due(20, None)
    due.init(types.SimpleNamespace(getMapState=lambda *a: waiting, getValueState=lambda *a: rounds))
    feed = lambda ids: list(due.handleInputRows(("s",), iter([pd.DataFrame({"id": np.asarray(i, np.int64)}) for i in ids]), None))[0].values.tolist()
    assert feed([range(100), range(50, 150)]) == [["s", 1, 150]] and waiting.writes == 0
    assert feed([[1, 2, 1]]) == [] and waiting.writes == 2
    assert feed([range(2, 20)]) == [] and waiting.writes == 20
    assert feed([[1], [20]]) == [["s", 2, 20]] and waiting.held == {}


def test_histories_keep_the_last_values_only():
    values, total = _Value(), _Value()
    of = T._Histories(5)
    of.init(types.SimpleNamespace(getListState=lambda *a: values, getValueState=lambda *a: total))
    frame = lambda k: pd.DataFrame({"ms": np.arange(k, k + 10_000)[::-1], "place": np.arange(10_000), "value": np.full(10_000, 0.1)})
    tracemalloc.start()
    got = list(of.handleInputRows(("m",), (frame(k) for k in range(0, 400_000, 10_000)), None))[0].iloc[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["count"] == 5 and got["total"] == pytest.approx(40_000, abs=1e-9) and peak < 10e6
    assert [v[0] for v in values.row] == list(range(399_995, 400_000)) and values.row[0][1] == 4
    more = pd.DataFrame({"ms": [399_999, 1], "place": [-1, 0], "value": [9.0, float("inf")]})
    last = list(of.handleInputRows(("m",), iter([more]), None))[0].iloc[0]
    assert last["max"] == 9.0 and last["total"] == float("inf") and len(values.row) == 5
