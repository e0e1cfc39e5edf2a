"""Streaming forms of the checks, on built-in operators where they suffice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import leaf_hash
from tidemark.operators.intake import DELIVERY_KEY
from tidemark.operators.merkle import MAX_LEVEL, build_tiles, needed_nodes, range_parts
from tidemark.streaming import processors as p


def _timers(*times: int) -> str:
    return "ProcessingTime" if any(times) else "None"


def live_chain(frames: DataFrame, wait_ms: int = 0) -> DataFrame:
    """Provisional chain verdicts; a scheduled batch verification stays the authority."""
    return p.transform(frames.select("source_id", "ordinal", "record_bytes", "claimed_hash"), "source_id", p.ChainProcessor(wait_ms), _timers(wait_ms))


def live_intake(events: DataFrame, max_records: int = 256, max_age_ns: int = 60_000_000_000, idle_ms: int = 0, wait_ms: int = 0,
                heads: DataFrame | None = None) -> DataFrame:
    """events(source_id, ordinal from 0, time_ns, body_head, body_tail) to numbered, chained, sealed records.

    ``heads`` (stored_heads) are where a new query goes on; a restarted one has them in its checkpoint.
    """
    columns = events.select("source_id", "ordinal", "time_ns", "body_head", "body_tail")
    return p.transform(columns, "source_id", p.SealProcessor(max_records, max_age_ns, idle_ms, wait_ms), _timers(idle_ms, wait_ms), heads)


def stored_heads(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Where stored chains end: source_id, last_seq, last_hash, segment (the next one), stack.

    frames(source_id, seq, record_bytes, record_hash) of whole chains, segments(source_id, segments: how many are closed).
    """
    tiles = build_tiles(frames.select("source_id", (F.col("seq") - 1).alias("idx"), leaf_hash(F.col("record_bytes")).alias("leaf")))
    last = frames.groupBy("source_id").agg(F.max("seq").alias("last_seq"), F.max_by("record_hash", "seq").alias("last_hash"))
    parts = last.select("source_id", F.expr(f"inline({range_parts(str(MAX_LEVEL + 1), 'last_seq')})"))
    stack = needed_nodes(tiles, parts).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("level", "hash")), asc=False).alias("s"))
    stack = stack.select("source_id", F.transform("s", lambda x: F.lower(F.hex(x["hash"]))).alias("stack"))
    return last.join(stack, "source_id").join(segments, "source_id").select("source_id", "last_seq", "last_hash", F.col("segments").cast("bigint").alias("segment"), "stack")


def live_forks(submitted: DataFrame) -> DataFrame:
    return p.transform(submitted.select("origin", "pos", "size", "root"), "origin", p.ForkProcessor())


def live_heads(accepted: DataFrame) -> DataFrame:
    """Head changes, the trigger for anchoring."""
    return p.transform(accepted.select("origin", "pos", "size", "root"), "origin", p.HeadProcessor())


def live_outages(records: DataFrame, wait_ms: int = 0) -> DataFrame:
    return p.transform(records.select("source_id", "ordinal", "event_type", "seq", "time_ns"), "source_id", p.OutageProcessor(wait_ms), _timers(wait_ms))


def live_silences(beats: DataFrame, limit_us: int, lateness: str) -> DataFrame:
    """Silences (source_id, start_us, end_us) of beats(source_id, at), told when the limit passes; an open one has no end yet."""
    rows = beats.withWatermark("at", lateness).select("source_id", "at", F.unix_micros("at").alias("at_us"))
    return p.transform(rows, "source_id", p.SilenceProcessor(limit_us), "EventTime")


def last_told(silences: DataFrame) -> DataFrame:
    """Each silence once, with its end if that has come."""
    return silences.groupBy("source_id", "start_us").agg(F.max("end_us").alias("end_us"))


def live_dedup(delivered: DataFrame) -> DataFrame:
    """Redelivered segments collapse for good: a segment may come again at any time, so no watermark bounds it."""
    return delivered.dropDuplicates(DELIVERY_KEY)


def live_sessions(beats: DataFrame, max_silence: str, lateness: str) -> DataFrame:
    """Closed heartbeat sessions (source_id, first_us, last_us): two sessions of a source enclose one silence."""
    sessions = (beats.withWatermark("at", lateness).groupBy("source_id", F.session_window("at", max_silence))
                .agg(F.min("at").alias("first"), F.max("at").alias("last")))
    return sessions.select("source_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def silences_of(sessions: DataFrame) -> DataFrame:
    """Silences between the closed sessions of a source (batch, over the session table)."""
    from pyspark.sql import Window

    before = F.lag("last_us").over(Window.partitionBy("source_id").orderBy("first_us"))
    return (sessions.withColumn("start_us", before).where(F.col("start_us").isNotNull())
            .select("source_id", "start_us", F.col("first_us").alias("end_us")))
