"""Segment blobs: length-prefixed frames, decoded inside tasks (one blob holds at most one segment)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.chain import parsed_frames

MAX_FRAME_BYTES = 16 << 20
HASH_BYTES = 32
BATCH_ROWS = 8192
DECODED = "path string, frame_pos bigint, record_bytes binary, claimed_hash string, error string"


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def frame_bytes(record: Column, digest: Column) -> Column:
    """One encoded frame: length as a base-128 varint, record, 32-byte hash."""
    n = F.octet_length(record)

    def byte(shift: int, more: bool) -> Column:
        low = F.call_function("shiftright", n, F.lit(shift)).bitwiseAND(F.lit(127))
        return F.unhex(F.lpad(F.hex((low + (128 if more else 0)).cast("bigint")), 2, "0"))

    prefix = F.when(n < 1 << 7, byte(0, False))
    for width in (2, 3, 4):
        packed = F.concat(*[byte(7 * i, i < width - 1) for i in range(width)])
        prefix = prefix.when(n < 1 << (7 * width), packed)
    return F.concat(prefix, record, digest)


def _frames_of(content: bytes) -> Iterator[tuple[bytes | None, str | None, str | None]]:
    at, end = 0, len(content)
    while at < end:
        size = shift = 0
        while True:
            if at >= end:
                yield None, None, "truncated"
                return
            byte = content[at]
            at += 1
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
            if shift > 63:
                yield None, None, "implausible length"
                return
        if size == 0 or size > MAX_FRAME_BYTES:
            yield None, None, "implausible length"
            return
        if at + size + HASH_BYTES > end:
            yield None, None, "truncated"
            return
        yield content[at:at + size], content[at + size:at + size + HASH_BYTES].hex(), None
        at += size + HASH_BYTES


def _decode(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def packed(rows: list[tuple]):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()))],
                                          names=["path", "frame_pos", "record_bytes", "claimed_hash", "error"])

    # Frames of many blobs leave in one batch, which is cut by rows and bytes.
    rows, held = [], 0
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            for i, frame in enumerate(_frames_of(content.as_py() or b"")):
                rows.append((path, i, *frame))
                held += len(frame[0] or b"")
                if len(rows) >= BATCH_ROWS or held >= MAX_FRAME_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
    if rows:
        yield packed(rows)


def decode_frames(blobs: DataFrame) -> DataFrame:
    """(path, frame_pos, record_bytes, claimed_hash, error); a short or implausible tail is a row with an error."""
    return blobs.select("path", "content").mapInArrow(_decode, DECODED)


def corruption_report(decoded: DataFrame) -> DataFrame:
    """First fault of each damaged blob: reason and the last good number before it."""
    parsed = parsed_frames(decoded)
    reason = (F.col("error"))
    fault = (F.when(reason.isNotNull(), reason)
             .when(F.col("record_hash") != F.col("claimed_hash"), F.lit("hash mismatch"))
             .when(F.col("parse_error"), F.lit("parse")))
    rows = parsed.select("path", "frame_pos", F.col("record.seq").alias("seq"), fault.alias("reason"))
    # A blob is one segment at most, so a window over it is bounded; frames are decoded and hashed once.
    at = F.min(F.when(F.col("reason").isNotNull(), F.col("frame_pos"))).over(Window.partitionBy("path"))
    return rows.withColumn("_at", at).where(F.col("_at").isNotNull()).groupBy("path").agg(
        F.min_by("reason", F.when(F.col("frame_pos") == F.col("_at"), F.col("frame_pos"))).alias("reason"), F.first("_at").alias("frame_pos"),
        F.max_by("seq", F.when(F.col("frame_pos") < F.col("_at"), F.col("frame_pos"))).alias("last_good_seq"))
