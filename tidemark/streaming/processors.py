"""Stateful per-key folds for live streams. Each keeps a small state and equals its batch twin at the end.

Rows of a source may arrive out of order across files; those ahead of their turn wait in map state.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.hashing import EMPTY_ROOT, ZERO_HASH
from tidemark.operators.captured import OUTAGE, REPLAY


class InOrder(StatefulProcessor):
    """Feeds the rows of a key to ``step`` by contiguous ordinal; repeats of past ordinals are dropped.

    Each question to the state store is a call to another process, so the state counts the rows that wait there (``ahead``) and
    a row in turn asks nothing. Rows ahead of their turn are held here while the micro-batch lasts, at most HELD of them.

    Subclasses set STATE (a JSON-able start value), FIRST (the first ordinal) and COLUMNS (name -> type).
    """

    STATE: dict[str, Any] = {}
    FIRST = 0
    COLUMNS: dict[str, str] = {}
    HELD = 10_000
    wait_ms = 0  # how long a missing ordinal holds up those after it; 0: for ever

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "state string")
        fields = ", ".join(f"{name} {kind}" for name, kind in self.COLUMNS.items())
        self.waiting = handle.getMapState("waiting", "ordinal bigint", fields)
        self.held: dict[int, tuple] = {}

    def step(self, key: str, state: dict, row: tuple) -> dict | None:
        raise NotImplementedError

    def finish(self, key: str, state: dict, outputs: list[dict]) -> list[dict]:
        """What a micro-batch emits for the key; by default what its steps gave."""
        return outputs

    def lost(self, key: str, state: dict, first: int, last: int) -> dict | None:
        """The row that reports ordinals which did not arrive in time."""
        raise NotImplementedError

    def _start(self) -> dict:
        return {"next": self.FIRST, **json.loads(json.dumps(self.STATE))}

    def _take(self, key: str, state: dict, row: tuple, outputs: list[dict]) -> None:
        out = self.step(key, state, row)
        state["next"] += 1
        if out is not None:
            outputs.append(out)

    def _load(self) -> dict:
        stored = self.current.get()
        if stored is None:
            return self._start() | {"ahead": 0}
        state = json.loads(stored[0])
        if "ahead" not in state:  # stored heads, and checkpoints from before rows were counted
            state["ahead"] = sum(1 for _ in self.waiting.keys())
        return state

    def _drain(self, key: str, state: dict, outputs: list[dict]) -> None:
        while True:
            place = (state["next"],)
            row = self.held.pop(state["next"], None)
            if state["ahead"] and self.waiting.containsKey(place):
                row = row or tuple(self.waiting.getValue(place))
                self.waiting.removeKey(place)
                state["ahead"] -= 1
            if row is None:
                return
            self._take(key, state, row, outputs)

    def _put_by(self, state: dict) -> None:
        """Writes the rows held here to the state store."""
        known = state["ahead"]
        for ordinal, row in self.held.items():
            if not known or not self.waiting.containsKey((ordinal,)):
                state["ahead"] += 1
            self.waiting.updateValue((ordinal,), row)
        self.held = {}

    def _watch(self, state: dict, now_ms: int) -> None:
        """Sets the timer for the next missing ordinal, if rows wait behind one."""
        if not self.wait_ms:
            return
        behind = state["ahead"] > 0
        if behind and state.get("held") != state["next"]:
            state["held"], state["until"] = state["next"], now_ms + self.wait_ms
            self.handle.registerTimer(state["until"])
        elif not behind:
            state.pop("held", None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A missing ordinal is reported and given up once its time has passed, so what waits behind it is bounded by that time."""
        state = self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        outputs: list[dict] = []
        if state.get("held") == state["next"] and now >= state["until"]:
            ahead = min((k[0] for k in self.waiting.keys()), default=None)
            if ahead is not None:
                gone = self.lost(key[0], state, state["next"], ahead - 1)
                state["next"] = ahead
                if gone is not None:
                    outputs.append(gone)
                self._drain(key[0], state, outputs)
        self._watch(state, now)
        emitted = self.finish(key[0], state, outputs) if outputs else []
        self.current.update((json.dumps(state),))
        if emitted:
            yield pd.DataFrame(emitted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, self.held = self._load(), {}
        outputs: list[dict] = []
        names = list(self.COLUMNS)
        for chunk in rows:
            columns = [(c.where(c.notna(), None) if c.hasnans else c).tolist() for c in (chunk[n] for n in names)]
            for ordinal, *row in sorted(zip(chunk["ordinal"].tolist(), *columns), key=lambda r: r[0]):
                if ordinal == state["next"]:
                    self._take(key[0], state, tuple(row), outputs)
                    if self.held or state["ahead"]:
                        self._drain(key[0], state, outputs)
                elif ordinal > state["next"]:
                    self.held[int(ordinal)] = tuple(row)
                    if len(self.held) >= self.HELD:
                        self._put_by(state)
        self._put_by(state)
        if self.wait_ms:
            self._watch(state, timerValues.getCurrentProcessingTimeInMs())
        emitted = self.finish(key[0], state, outputs)
        self.current.update((json.dumps(state),))
        if emitted:
            yield pd.DataFrame(emitted)

    def close(self) -> None:
        pass


def push_leaf(stack: list[str], size: int, leaf: bytes) -> None:
    """Adds leaf number ``size`` (from 0) to the roots of perfect subtrees kept on the stack."""
    node = leaf
    while size & 1:
        node = hashlib.sha256(b"\x01" + bytes.fromhex(stack.pop()) + node).digest()
        size >>= 1
    stack.append(node.hex())


def stack_root(stack: list[str]) -> str:
    if not stack:
        return EMPTY_ROOT
    root = bytes.fromhex(stack[-1])
    for left in reversed(stack[:-1]):
        root = hashlib.sha256(b"\x01" + bytes.fromhex(left) + root).digest()
    return root.hex()


class ChainProcessor(InOrder):
    """Chain check and Merkle root of each source as frames arrive: one provisional row per micro-batch."""

    STATE = {"hash": ZERO_HASH, "seq": 0, "kind": None, "message": None, "stack": [], "records": 0}
    FIRST = 1
    COLUMNS = {"record_bytes": "binary", "claimed_hash": "string"}
    OUTPUT = "source_id string, records bigint, seq_last bigint, chain_valid boolean, kind string, message string, root string"

    def __init__(self, wait_ms: int = 0):
        self.wait_ms = wait_ms

    def lost(self, key, state, first, last):
        if state["kind"] is None:
            state["kind"], state["message"] = "lost", f"chain: entries {first} to {last} did not arrive"
        return {}  # the verdict row of this batch tells

    def step(self, key, state, row):
        data, claimed = bytes(row[0]), row[1]
        computed = hashlib.sha256(data).hexdigest()
        push_leaf(state["stack"], state["records"], hashlib.sha256(b"\x00" + data).digest())
        state["records"] += 1
        if state["kind"] is None:
            self._check(state, data, claimed, computed)
        return None

    def _check(self, state, data, claimed, computed) -> None:
        expected = state["seq"] + 1
        record = None
        if computed != claimed:
            fault = "hash", f"chain: seq {expected} hash mismatch: claimed {claimed} computed {computed}"
        else:
            try:
                record = json.loads(data)
            except ValueError:
                record = None
            if not isinstance(record, dict):
                fault = "parse", "chain: record does not parse"
            elif state["records"] > 1 and record["seq"] != expected:
                fault = "gap", f"chain: sequence gap: expected seq {expected}, got {record['seq']}"
            elif record["prev_hash"] != state["hash"]:
                fault = "link", f"chain: seq {record['seq']} prev_hash mismatch: expected {state['hash']}, got {record['prev_hash']}"
            else:
                state["hash"], state["seq"] = computed, record["seq"]
                return
        state["kind"], state["message"] = fault

    def finish(self, key, state, outputs):
        return [{"source_id": key, "records": state["records"], "seq_last": state["seq"], "chain_valid": state["kind"] is None,
                 "kind": state["kind"], "message": state["message"], "root": stack_root(state["stack"])}]


class SealProcessor(InOrder):
    """Intake: numbers, chains and seals. Emits a row per record, with the root where a segment closes.

    A segment closes at max_records, before a record that finds it max_age old, or by the processing-time timer
    when nothing more arrives. The rows of the query's checkpoint are the state after a restart. A query that starts anew goes
    on from stored heads: source_id, last_seq, last_hash, segment and stack (roots of the perfect subtrees, left to right).
    Ordinals that do not arrive within wait_ms are left out and reported by a row with lost_from and lost_to.
    """

    STATE = {"hash": ZERO_HASH, "seq": 0, "stack": [], "segment": 0, "pending": 0, "opened": 0}
    COLUMNS = {"time_ns": "bigint", "body_head": "string", "body_tail": "string"}
    OUTPUT = ("source_id string, seq bigint, segment bigint, record_bytes binary, record_hash string, sealed boolean, "
              "sealed_to bigint, root string, lost_from bigint, lost_to bigint")
    BLANK = dict.fromkeys(("seq", "segment", "record_bytes", "record_hash", "sealed_to", "root", "lost_from", "lost_to"))

    def __init__(self, max_records: int, max_age_ns: int, idle_ms: int = 0, wait_ms: int = 0):
        self.max_records, self.max_age_ns, self.idle_ms, self.wait_ms = max_records, max_age_ns, idle_ms, wait_ms

    def handleInitialState(self, key, initialState, timerValues) -> None:
        head = initialState.iloc[0]
        state = self._start() | {"seq": int(head["last_seq"]), "hash": head["last_hash"], "segment": int(head["segment"]), "stack": list(head["stack"])}
        self.current.update((json.dumps(state),))

    def lost(self, key, state, first, last):
        return {"source_id": key, "sealed": False, **self.BLANK, "lost_from": first, "lost_to": last}

    def step(self, key, state, row):
        time_ns, head, tail = row
        closed_to = closed_root = None
        if state["pending"] and time_ns - state["opened"] >= self.max_age_ns:
            closed_to, closed_root = state["seq"], stack_root(state["stack"])
            self._close(state)
        if not state["pending"]:
            state["opened"] = time_ns
        state["seq"] += 1
        data = f'{head}{state["seq"]}{tail}{state["hash"]}"}}'.encode()
        state["hash"] = hashlib.sha256(data).hexdigest()
        push_leaf(state["stack"], state["seq"] - 1, hashlib.sha256(b"\x00" + data).digest())
        state["pending"] += 1
        segment = state["segment"]
        if state["pending"] >= self.max_records:
            closed_to, closed_root = state["seq"], stack_root(state["stack"])
            self._close(state)
        return {"source_id": key, "seq": state["seq"], "segment": segment, "record_bytes": data, "record_hash": state["hash"],
                "sealed": closed_to is not None, "sealed_to": closed_to, "root": closed_root, "lost_from": None, "lost_to": None}

    @staticmethod
    def _close(state) -> None:
        state["segment"] += 1
        state["pending"] = 0

    def handleInputRows(self, key, rows, timerValues):
        yield from super().handleInputRows(key, rows, timerValues)
        if self.idle_ms:
            state = json.loads(self.current.get()[0])
            state["idle_at"] = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.current.update((json.dumps(state),))
            self.handle.registerTimer(state["idle_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        state = json.loads(self.current.get()[0])
        # A timer set before the last rows came is an old one.
        if self.idle_ms and state["pending"] and timerValues.getCurrentProcessingTimeInMs() >= state["idle_at"]:
            row = {"source_id": key[0], "sealed": True, **self.BLANK, "segment": state["segment"], "sealed_to": state["seq"], "root": stack_root(state["stack"])}
            self._close(state)
            self.current.update((json.dumps(state),))
            yield pd.DataFrame([row])


class OutageProcessor(InOrder):
    """Outage and replay pairing as records arrive; emits a row per closed outage."""

    STATE = {"seq": None, "time": None}
    FIRST = 1
    COLUMNS = {"event_type": "string", "seq": "bigint", "time_ns": "bigint"}
    OUTPUT = "source_id string, outage_seq bigint, replay_seq bigint, buffered bigint, outage_ns bigint, lost_from bigint, lost_to bigint"

    def __init__(self, wait_ms: int = 0):
        self.wait_ms = wait_ms

    def lost(self, key, state, first, last):
        # What happened in between is not known: an open outage is not paired across it.
        state["seq"] = state["time"] = None
        return {"source_id": key, "outage_seq": None, "replay_seq": None, "buffered": None, "outage_ns": None, "lost_from": first, "lost_to": last}

    def step(self, key, state, row):
        kind, seq, time_ns = row
        if kind == OUTAGE:
            state["seq"], state["time"] = int(seq), int(time_ns)
        elif kind == REPLAY and state["seq"] is not None:
            out = {"source_id": key, "outage_seq": state["seq"], "replay_seq": int(seq),
                   "buffered": max(int(seq) - state["seq"] - 1, 0), "outage_ns": int(time_ns) - state["time"],
                   "lost_from": None, "lost_to": None}
            state["seq"] = state["time"] = None
            return out
        return None


class SilenceProcessor(StatefulProcessor):
    """Silences over the limit, as soon as the watermark shows them: a row without an end when the limit has passed since the
    last heartbeat, and a row with its end once a later heartbeat is final.

    Heartbeats wait until the watermark has passed them, as earlier ones may still come; the watermark's delay bounds them.
    """

    OUTPUT = "source_id string, start_us bigint, end_us bigint"

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, told boolean")
        self.waiting = handle.getMapState("waiting", "at bigint", "n int")

    def handleInputRows(self, key, rows, timerValues):
        for chunk in rows:
            times = sorted(set(chunk["at_us"].tolist()))
            for at in times:
                self.waiting.updateValue((int(at),), (1,))
            if times:
                self._wake(times[0])
        return iter([])

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-int(at_us) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, told = self.last.get() if self.last.exists() else (None, False)
        found, ahead = [], None
        for (at,) in sorted(self.waiting.keys()):
            if at > now:
                ahead = at
                break
            if last is not None and at - last > self.limit_us:
                found.append((key[0], last, at))
            last, told = at, False
            self.waiting.removeKey((at,))
        if ahead is not None:
            self._wake(ahead)
        if last is not None:
            if not told and now - last > self.limit_us:
                found.append((key[0], last, None))
                told = True
            elif not told:
                self._wake(last + self.limit_us + 1)
            self.last.update((last, told))
        if found:
            yield pd.DataFrame(found, columns=["source_id", "start_us", "end_us"])

    def close(self):
        pass


class ForkProcessor(StatefulProcessor):
    """Append-only acceptance per origin, in receipt order."""

    OUTPUT = "origin string, pos bigint, size bigint, root string, status string"

    def init(self, handle):
        self.head = handle.getValueState("head", "size bigint, root string")

    def handleInputRows(self, key, rows, timerValues):
        size, root = self.head.get() if self.head.exists() else (None, None)
        # Judged in receipt order as a whole: the trigger's size bounds what a micro-batch brings for one origin.
        batch = pd.concat(list(rows)).sort_values("pos")
        statuses = []
        for new_size, new_root in zip(batch["size"].tolist(), batch["root"].tolist()):
            if size is None or new_size > size:
                size, root, status = int(new_size), new_root, "accepted"
            elif new_size < size:
                status = "tree size decreased"
            else:
                status = "repeated" if new_root == root else "different root at same tree size"
            statuses.append(status)
        yield pd.DataFrame({"origin": key[0], "pos": batch["pos"], "size": batch["size"], "root": batch["root"], "status": statuses})
        if size is not None:
            self.head.update((size, root))

    def close(self):
        pass


class HeadProcessor(StatefulProcessor):
    """Emits the head of an origin once per micro-batch, and only when it has grown."""

    OUTPUT = "origin string, size bigint, root string"

    def init(self, handle):
        self.last = handle.getValueState("last", "size bigint")

    def handleInputRows(self, key, rows, timerValues):
        known = self.last.get()[0] if self.last.exists() else -1
        best = None
        for chunk in rows:
            top = chunk.sort_values(["size", "pos"]).iloc[-1]
            if int(top["size"]) > (best[0] if best else known):
                best = int(top["size"]), top["root"]
        if best:
            self.last.update((best[0],))
            yield pd.DataFrame([{"origin": key[0], "size": best[0], "root": best[1]}])

    def close(self):
        pass


def transform(stream: DataFrame, key: str, processor: StatefulProcessor, timers: str = "None", initial: DataFrame | None = None) -> DataFrame:
    # The process that prepares a stateful query does not get the shipped package, so processors travel by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode=timers,
        initialState=initial.groupBy(key) if initial is not None else None)
