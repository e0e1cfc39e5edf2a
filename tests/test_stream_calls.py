"""How often the ordered folds ask the state store, which is a call to another process each time."""

import collections
import itertools

import pandas as pd

from tidemark.streaming.processors import InOrder


class Store:
    def __init__(self, calls):
        self.calls, self.value, self.map = calls, None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls["get"] += 1
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.calls["containsKey"] += 1
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.calls["updateValue"] += 1
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(list(self.map))


class Handle:
    def __init__(self):
        self.calls = collections.Counter()
        self.stores = [Store(self.calls), Store(self.calls)]

    def getValueState(self, *_):
        return self.stores[0]

    def getMapState(self, *_):
        return self.stores[1]


class Log(InOrder):
    COLUMNS = {"x": "string"}

    def step(self, key, state, row):
        return {"ordinal": state["next"], "x": row[0]}


def rows(*ordinals):
    return pd.DataFrame({"ordinal": list(ordinals), "x": [f"r{o}" for o in ordinals]})


def run(log, *batches):
    frames = [list(log.handleInputRows(("a",), iter(b), None)) for b in batches]
    return [r["ordinal"] for f in itertools.chain(*frames) for _, r in f.iterrows()]


def test_rows_in_turn_ask_nothing():
    handle, log = Handle(), Log()
    log.init(handle)
    assert run(log, [rows(*range(500, 1000)), rows(*range(500))], [rows(*range(1000, 2000))]) == list(range(2000))
    assert handle.calls["containsKey"] == handle.calls["updateValue"] == 0


def test_rows_ahead_wait_in_the_store():
    for held in (2, 10_000):
        handle, log = Handle(), Log()
        log.HELD = held
        log.init(handle)
        # A gap over two micro-batches, a row that comes twice while it waits, a repeat of a past row.
        found = run(log, [rows(3, 4, 5), rows(0, 4)], [rows(7, 4, 3)], [rows(2, 0), rows(1)], [rows(6, 5)])
        assert found == list(range(8))
        assert not handle.stores[1].map
