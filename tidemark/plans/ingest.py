"""Segment intake: every delivery is judged, and what is accepted is appended together with its receipts.

A delivery is a segment row and its frames. The rules are those of a store that takes one delivery after the other: the
segment row (range, root, checkpoint), whether it is stored already, the frames in their order, and whether its id is taken.
Here all deliveries of a batch are judged at once; only which of several good deliveries comes first depends on others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chain import parsed_frames
from tidemark.operators.intake import DELIVERY_KEY, MAX_FRAME_BYTES, MAX_SEGMENT_BYTES, MAX_SEGMENT_FRAMES, OK, first_rule, frame_status, segment_status
from tidemark.sources.ledger import Conflict, Ledger
from tidemark.sources.store import materialise

SEGMENT_ROWS = "segment_id string, source_id string, seq_first bigint, seq_last bigint, root binary, checkpoint string"
FRAME_ROWS = "segment_id string, source_id string, seq bigint, record_bytes binary, record_hash string"
RECEIPT_ROWS = "delivery bigint, segment_id string, status string, acked_seq bigint"
ACCEPTED, DUPLICATE, TAKEN = "accepted", "duplicate", "id_taken"
_SEGMENT = ["segment_id", "source_id", "seq_first", "seq_last", "root", "checkpoint"]


def content_status(deliveries: DataFrame, frames: DataFrame, max_frames: int = MAX_SEGMENT_FRAMES, max_bytes: int = MAX_SEGMENT_BYTES,
                   max_frame_bytes: int = MAX_FRAME_BYTES) -> DataFrame:
    """delivery, content (the first fault of its frames, in their order), caps (the first cap it breaks): ok where there is none.

    ``frames(delivery, position from 0, record_bytes, claimed_hash)``. Frames past the cap are counted and not looked at, so
    a delivery's window is bounded however long it is.
    """
    counts = frames.groupBy("delivery").agg(F.count("*").alias("frames"))
    # Frames are hashed and parsed where they lie; only the facts about them are shuffled and put in order, not their bytes.
    looked = parsed_frames(frames.where(F.col("position") < max_frames).withColumn("frame", frame_status(max_frame_bytes))).select(
        "delivery", "position", "frame", "parse_error", F.octet_length("record_bytes").cast("bigint").alias("bytes"),
        F.col("record.source_id").alias("record_source"), F.col("record.seq").alias("record_seq"))
    looked = looked.withColumn("so_far", F.sum("bytes").over(Window.partitionBy("delivery").orderBy("position")))
    claims = deliveries.select("delivery", "source_id", "seq_first")
    capped = F.col("so_far") > max_bytes
    fault = first_rule([
        (capped, "too_many_bytes"),
        (F.col("frame") == "digest_length", "digest_length"),
        (F.col("frame") == "frame_length", "frame_length"),
        (F.col("frame") == "hash_mismatch", "hash_mismatch"),
        (F.col("parse_error"), "bad_record"),
        (~F.col("record_source").eqNullSafe(F.col("source_id")), "other_source"),
        (~F.col("record_seq").eqNullSafe(F.col("seq_first") + F.col("position")), "out_of_order"),
    ])
    judged = looked.join(claims, "delivery").select("delivery", "position", capped.alias("capped"), fault.alias("fault"))
    first = judged.groupBy("delivery").agg(
        F.min_by("fault", F.when(F.col("fault") != OK, F.col("position"))).alias("fault"), F.bool_or("capped").alias("capped"))
    n = F.coalesce("frames", F.lit(0).cast("bigint"))
    many = n > max_frames
    rows = deliveries.select("delivery", "seq_first", "seq_last").join(counts, "delivery", "left").join(first, "delivery", "left")
    found = F.when(F.col("fault").isNotNull() & (F.col("fault") != OK), F.col("fault")).when(many, F.lit("too_many_frames")).when(
        F.col("seq_first") + n - 1 != F.col("seq_last"), F.lit("short_range")).otherwise(F.lit(OK))
    caps = F.when(F.coalesce("capped", F.lit(False)), F.lit("too_many_bytes")).when(many, F.lit("too_many_frames")).otherwise(F.lit(OK))
    return rows.select("delivery", found.alias("content"), caps.alias("caps"))


def _winners(good: DataFrame) -> DataFrame:
    """Of good deliveries, those that a store would accept one after the other: the first of its key and of its id.

    A delivery that is first for both is accepted, the others of that key and id are out, and what is left goes on. Ids
    normally belong to one key, so that the first round is the last.
    """
    taken, left = [], good.select("delivery", "segment_id", *DELIVERY_KEY)
    while True:
        by_key = left.groupBy(*DELIVERY_KEY).agg(F.min("delivery").alias("first_of_key"))
        by_id = left.groupBy("segment_id").agg(F.min("delivery").alias("first_of_id"))
        won = left.join(by_key, DELIVERY_KEY).join(by_id, "segment_id").where("delivery = first_of_key and delivery = first_of_id")
        taken.append(materialise(won.select("delivery", "segment_id", *DELIVERY_KEY), "intake-won"))
        left = materialise(left.join(taken[-1].select(*DELIVERY_KEY), DELIVERY_KEY, "left_anti").join(taken[-1].select("segment_id"), "segment_id", "left_anti"), "intake-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def judge_deliveries(deliveries: DataFrame, frames: DataFrame, stored: DataFrame, **caps: int) -> DataFrame:
    """The deliveries (delivery, a number in order of arrival, and the segment's columns) with their status."""
    rows = deliveries.select("delivery", *_SEGMENT).withColumns({"meta": segment_status(), "segment_id": F.lower("segment_id")})
    rows = materialise(rows.join(content_status(deliveries, frames, **caps), "delivery"), "intake-judged")
    good = rows.where((F.col("meta") == OK) & (F.col("content") == OK))
    good = good.join(stored.select(*DELIVERY_KEY), DELIVERY_KEY, "left_anti").join(stored.select("segment_id"), "segment_id", "left_anti")
    won = _winners(good)

    def since(keys: list[str], out: str) -> DataFrame:
        """From which delivery on the keys are taken; before all of them if they are stored."""
        before = stored.select(*keys, F.lit(None).cast("bigint").alias(out)).unionByName(won.select(*keys, F.col("delivery").alias(out)))
        return before.groupBy(*keys).agg(F.min(F.coalesce(out, F.lit(-(1 << 62)))).alias(out))

    rows = rows.join(since(DELIVERY_KEY, "key_since"), DELIVERY_KEY, "left").join(since(["segment_id"], "id_since"), "segment_id", "left")
    status = (F.when(F.col("meta") != OK, F.col("meta"))
              .when(F.col("key_since") < F.col("delivery"), F.when(F.col("caps") != OK, F.col("caps")).otherwise(F.lit(DUPLICATE)))
              .when(F.col("content") != OK, F.col("content"))
              .when(F.col("id_since") < F.col("delivery"), F.lit(TAKEN)).otherwise(F.lit(ACCEPTED)))
    return rows.select("delivery", *_SEGMENT, status.alias("status"))


def ingest(ledger: Ledger, deliveries: DataFrame, frames: DataFrame, writer: str, batch: int, **caps: int) -> DataFrame:
    """Judges a batch, appends what is accepted, and returns its receipts (delivery, segment_id, status, acked_seq).

    A batch that is in already is not judged again: its receipts are read back. If another writer commits meanwhile, the
    batch is judged again against what is stored then, so a segment is never stored twice.
    """
    while True:
        done = ledger.applied(writer, batch)
        if done:
            return ledger.read("receipts", RECEIPT_ROWS, done)
        version = ledger.version()
        stored = ledger.read("segments", SEGMENT_ROWS, upto=version)
        judged = materialise(judge_deliveries(deliveries, frames, stored, **caps), "intake-status")
        accepted = judged.where(F.col("status") == ACCEPTED)
        kept = frames.join(accepted.select("delivery", "segment_id", "source_id", "seq_first"), "delivery").select(
            "segment_id", "source_id", (F.col("seq_first") + F.col("position")).alias("seq"), "record_bytes", F.lower("claimed_hash").alias("record_hash"))
        acked = F.when(F.col("status").isin(ACCEPTED, DUPLICATE), F.col("seq_last"))
        parts = {"segments": accepted.select(*_SEGMENT), "frames": kept, "receipts": judged.select("delivery", "segment_id", "status", acked.alias("acked_seq"))}
        try:
            ledger.append(parts, writer, batch, made_for=version)
        except Conflict:
            continue


def ingest_stream(deliveries: DataFrame, ledger: Ledger, writer: str, **caps: int):
    """A stream writer over rows (delivery, the segment's columns, frames array<struct<record_bytes, claimed_hash>>).

    Each micro-batch is one batch of the ledger, so that a restarted query repeats it without effect.
    """

    def take(rows: DataFrame, batch: int) -> None:
        held = materialise(rows, "intake-batch")
        frames = held.select("delivery", F.posexplode("frames").alias("position", "f")).select("delivery", F.col("position").cast("bigint"), "f.record_bytes", "f.claimed_hash")
        ingest(ledger, held.drop("frames"), frames, writer, batch, **caps)

    return deliveries.writeStream.foreachBatch(take)
