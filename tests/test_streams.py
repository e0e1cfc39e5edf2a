"""Live streams that stop, wait and go on: restarts, timers, lost ordinals, silences."""

import hashlib
import json
import os
import time

from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.streaming import live
from tidemark.streaming.run import run_available, stream_table, use_rocksdb

EVENTS = "source_id string, ordinal bigint, time_ns bigint, body_head string, body_tail string"


def events(spark, *rows):
    return spark.createDataFrame([(s, o, o * 10, '{"source_id":"' + s + '","seq":', ',"prev_hash":"') for s, o in rows], EVENTS)


def chained(sources):
    """The frames of whole sources, built one after the other."""
    out = {}
    for s, n in sources.items():
        previous = "0" * 64
        for i in range(1, n + 1):
            data = f'{{"source_id":"{s}","seq":{i},"prev_hash":"{previous}"}}'
            previous = hashlib.sha256(data.encode()).hexdigest()
            out[s, i] = previous
    return out


class Inbox:
    """A stream over files that come in one after the other, run to the end of what is there each time."""

    def __init__(self, spark, make):
        self.spark, self.make = spark, make
        self.inbox, self.home = scratch_path(spark, "inbox"), scratch_path(spark, "stream")

    def bring(self, rows, until=None):
        """With timers a stream never ends by itself: it is then stopped once ``until`` holds for what it has written."""
        rows.coalesce(1).write.mode("append").parquet(self.inbox)
        if until:
            return self.wait_for(until)
        written = run_available(self.make(stream_table(self.spark, self.inbox, 1)), "test", target=f"{self.home}/out", checkpoint=f"{self.home}/checkpoint")
        return written.collect()


    def wait_for(self, until):
        use_rocksdb(self.spark)
        stream = self.make(stream_table(self.spark, self.inbox, 1))
        query = (stream.writeStream.format("parquet").option("path", f"{self.home}/out").option("checkpointLocation", f"{self.home}/checkpoint")
                 .trigger(processingTime="300 milliseconds").start())
        try:
            for _ in range(60):
                time.sleep(0.5)
                assert query.exception() is None
                if os.path.exists(f"{self.home}/out/_spark_metadata"):
                    found = self.spark.read.schema(stream.schema).parquet(f"{self.home}/out").collect()
                    if until(found):
                        return found
        finally:
            query.stop()
        raise AssertionError("the stream did not get there")


def test_intake_survives_a_restart(spark):
    inbox = Inbox(spark, lambda s: live.live_intake(s, max_records=3, max_age_ns=10**15))
    inbox.bring(events(spark, ("a", 0), ("a", 1), ("a", 4)))
    rows = inbox.bring(events(spark, ("a", 2), ("a", 3), ("a", 3), ("b", 0)))
    assert {(r["source_id"], r["seq"]): r["record_hash"] for r in rows} == chained({"a": 5, "b": 1})
    assert [(r["source_id"], r["sealed_to"]) for r in rows if r["sealed"]] == [("a", 3)]


def test_intake_goes_on_from_stored_heads(spark):
    whole = chained({"a": 9, "b": 4, "new": 2})
    heads = [("a", 6, whole["a", 6], 2, [])]
    stored = []
    previous = "0" * 64
    for i in range(1, 7):
        data = f'{{"source_id":"a","seq":{i},"prev_hash":"{previous}"}}'
        previous = hashlib.sha256(data.encode()).hexdigest()
        stored.append(("a", i, bytearray(data.encode()), previous))
    frames = spark.createDataFrame(stored, "source_id string, seq bigint, record_bytes binary, record_hash string")
    found = live.stored_heads(frames, spark.createDataFrame([("a", 2)], "source_id string, segments int"))
    head = found.first()
    assert (head["last_seq"], head["last_hash"], head["segment"], len(head["stack"])) == (6, heads[0][2], 2, 2)
    inbox = Inbox(spark, lambda s: live.live_intake(s, max_records=3, max_age_ns=10**15, heads=found))
    rows = inbox.bring(events(spark, *[("a", i) for i in range(3)], ("new", 0), ("new", 1)))
    assert {(r["source_id"], r["seq"]): r["record_hash"] for r in rows} == {k: v for k, v in whole.items() if k[0] == "new" or k[0] == "a" and k[1] > 6}
    # The root at the seal is that of all nine records, the stored ones included.
    sealed = next(r for r in rows if r["sealed"] and r["source_id"] == "a")
    from tests.test_storing import root_of

    datas = []
    previous = "0" * 64
    for i in range(1, 10):
        data = f'{{"source_id":"a","seq":{i},"prev_hash":"{previous}"}}'.encode()
        previous = hashlib.sha256(data).hexdigest()
        datas.append(hashlib.sha256(b"\x00" + data).digest())
    assert (sealed["sealed_to"], sealed["segment"], sealed["root"]) == (9, 2, root_of(datas).hex())


def test_an_idle_source_is_sealed(spark):
    inbox = Inbox(spark, lambda s: live.live_intake(s, max_records=100, max_age_ns=10**15, idle_ms=1500))
    rows = inbox.bring(events(spark, ("a", 0), ("a", 1)), lambda found: any(r["sealed"] for r in found))
    assert [(r["source_id"], r["sealed_to"], r["seq"]) for r in rows if r["sealed"]] == [("a", 2, None)]
    # The stream was stopped; what comes after the restart opens the next segment.
    rows = inbox.bring(events(spark, ("a", 2)), lambda found: any(r["seq"] == 3 for r in found))
    assert {(r["source_id"], r["seq"]): (r["segment"], r["record_hash"]) for r in rows if r["seq"]} == {
        k: (0 if k[1] < 3 else 1, v) for k, v in chained({"a": 3}).items()}


def test_a_lost_ordinal_is_named_and_the_rest_goes_on(spark):
    inbox = Inbox(spark, lambda s: live.live_intake(s, max_records=100, max_age_ns=10**15, wait_ms=1500))
    lost = lambda found: sorted((r["lost_from"], r["lost_to"]) for r in found if r["lost_from"] is not None)
    rows = inbox.bring(events(spark, ("a", 0), ("a", 3), ("a", 4), ("a", 7)), lambda found: len(lost(found)) == 2)
    assert lost(rows) == [(1, 2), (5, 6)]
    # What comes too late is dropped.
    rows = inbox.bring(events(spark, ("a", 2), ("b", 0)), lambda found: any(r["source_id"] == "b" for r in found))
    assert {(r["source_id"], r["seq"]): r["record_hash"] for r in rows if r["seq"]} == chained({"a": 4, "b": 1})


def test_a_lost_frame_ends_the_chain(spark):
    def frames(*rows):
        made, previous = {}, "0" * 64
        for i in range(1, 6):
            data = json.dumps({"seq": i, "prev_hash": previous}).encode()
            previous = hashlib.sha256(data).hexdigest()
            made[i] = ("a", i, bytearray(data), previous)
        return spark.createDataFrame([made[i] for i in rows], "source_id string, ordinal bigint, record_bytes binary, claimed_hash string")

    inbox = Inbox(spark, lambda s: live.live_chain(s, wait_ms=1500))
    rows = inbox.bring(frames(1, 2, 5), lambda found: any(r["kind"] == "lost" for r in found))
    told = next(r for r in rows if r["kind"] == "lost")
    assert (told["message"], told["records"], told["chain_valid"]) == ("chain: entries 3 to 4 did not arrive", 3, False)


def test_silences_are_told_when_the_limit_passes(spark):
    def beats(*rows):
        return spark.createDataFrame(rows, "source_id string, s bigint").select("source_id", F.timestamp_seconds("s").alias("at"))

    inbox = Inbox(spark, lambda s: live.live_silences(s, 100 * 10**6, "10 seconds"))
    told = lambda rows: sorted(((r["source_id"], r["start_us"] // 10**6, None if r["end_us"] is None else r["end_us"] // 10**6) for r in rows), key=str)
    assert told(inbox.bring(beats(("a", 1000), ("b", 1000), ("a", 1050)))) == []
    # Out of order within the delay, and a source that falls silent: it is told before any heartbeat ends the silence.
    rows = told(inbox.bring(beats(("b", 1130), ("b", 1080), ("a", 1150), ("b", 1200))))
    assert rows == []
    rows = told(inbox.bring(beats(("b", 1290))))
    assert rows == [("a", 1150, None)]
    rows = told(inbox.bring(beats(("a", 1295), ("b", 1400))))
    assert rows == sorted([("a", 1150, None), ("a", 1150, 1295)], key=str)
