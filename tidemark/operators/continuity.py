"""Heartbeat continuity and transport outages of captured records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.texts import two_decimals
from tidemark.operators.captured import HEARTBEAT, OUTAGE, REPLAY, STOPPED
from tidemark.operators.ordered import BLOCK_WIDTH, spans_between, stitched_lag, stitched_running

SECOND = 1_000_000_000
INTERVAL_NS = 60 * SECOND
MAX_SILENCE_NS = 180 * SECOND


def beat_spans(records: DataFrame, max_silence_ns: int) -> DataFrame:
    """Spans between consecutive heartbeats that can be a silence or the longest one."""
    beats = records.where((F.col("event_type") == HEARTBEAT) & F.col("time_ns").isNotNull()).select("source_id", "time_ns")
    return spans_between(beats, ["source_id"], "time_ns", max_silence_ns)


def clean_stops(records: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """For each clean stop, how many heartbeats had arrived before it."""
    beat = ((F.col("event_type") == HEARTBEAT) & F.col("time_ns").isNotNull()).cast("bigint")
    marks = records.where(F.col("event_type").isin(HEARTBEAT, STOPPED)).select("source_id", "ordinal", "event_type", "time_ns")
    counted = stitched_running(marks, ["source_id"], "ordinal", "before", beat, "sum", True, width)
    return counted.where(F.col("event_type") == STOPPED).select("source_id", "before").distinct()


def observation_windows(records: DataFrame, max_silence_ns: int = MAX_SILENCE_NS, spans: DataFrame | None = None,
                        width: int = BLOCK_WIDTH) -> DataFrame:
    """Silences over the limit. A window is bounded when a clean stop followed its opening heartbeat.

    The heartbeat before the window is counted in time order, the one before the stop in arrival order.
    """
    spans = beat_spans(records, max_silence_ns) if spans is None else spans
    return windows_of(spans, clean_stops(records, width), max_silence_ns)


def windows_of(spans: DataFrame, stops: DataFrame, max_silence_ns: int) -> DataFrame:
    gaps = spans.where(F.col("gap") > max_silence_ns)
    stops = stops.withColumn("_stopped", F.lit(True))
    return gaps.join(stops, ["source_id", "before"], "left").select(
        "source_id", F.col("start").alias("start_ns"), F.col("stop").alias("end_ns"), F.col("gap").alias("gap_ns"),
        F.coalesce("_stopped", F.lit(False)).alias("bounded"))


def continuity_summary(records: DataFrame, interval_ns: int = INTERVAL_NS, max_silence_ns: int = MAX_SILENCE_NS,
                       spans: DataFrame | None = None) -> DataFrame:
    """Per source: observed, expected, longest gap, within policy. No heartbeat at all is not within policy."""
    spans = beat_spans(records, max_silence_ns) if spans is None else spans
    beat = (F.col("event_type") == HEARTBEAT) & F.col("time_ns").isNotNull()
    facts = records.groupBy("source_id").agg(
        F.count_if(beat).alias("observed"), F.min(F.when(beat, F.col("time_ns"))).alias("_first"),
        F.max("time_ns").alias("_last"))
    longest = spans.groupBy("source_id").agg(F.max("gap").alias("_longest"))
    expected = F.greatest(F.lit(1).cast("bigint"), F.call_function(
        "div", F.col("_last") - F.col("_first"), F.lit(interval_ns).cast("bigint")))
    joined = facts.join(longest, "source_id", "left")
    return joined.select(
        "source_id", "observed",
        F.when(F.col("observed") > 0, expected if interval_ns > 0 else F.lit(0)).otherwise(F.lit(0)).alias("expected"),
        F.coalesce("_longest", F.lit(0).cast("bigint")).alias("longest_gap_ns"),
        ((F.col("observed") > 0) & (F.coalesce("_longest", F.lit(0)) <= max_silence_ns)).alias("within_policy"))


def coverage_text(observed: str = "observed", expected: str = "expected"):
    ratio = F.least(F.lit(100.0), F.col(observed) / F.col(expected) * 100)
    return F.when(F.col(expected) <= 0, F.lit("—")).otherwise(F.concat(two_decimals(ratio), F.lit(" %")))


def _transport_rows(records: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    kept = records.where(F.col("event_type").isin(OUTAGE, REPLAY)).select("source_id", "ordinal", "event_type", "seq", "time_ns")
    return stitched_lag(kept, ["source_id"], "ordinal", ["event_type", "seq", "time_ns"], width)


def outage_pairs(records: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Replays that close an open outage: only the outage directly before it is open."""
    paired = _transport_rows(records, width).where((F.col("event_type") == REPLAY) & (F.col("prev_event_type") == OUTAGE))
    return paired.select(
        "source_id", F.col("prev_seq").alias("outage_seq"), F.col("seq").alias("replay_seq"),
        F.greatest(F.col("seq") - F.col("prev_seq") - 1, F.lit(0)).alias("buffered"),
        (F.col("time_ns") - F.col("prev_time_ns")).alias("outage_ns"))


def transport_summary(records: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Per source with outage or replay rows: outages, longest, buffered, completed."""
    rows = _transport_rows(records, width)
    pair = (F.col("event_type") == REPLAY) & (F.col("prev_event_type") == OUTAGE)
    span = F.when(pair, F.greatest(F.col("time_ns") - F.col("prev_time_ns"), F.lit(0)))
    buffered = F.when(pair, F.greatest(F.col("seq") - F.col("prev_seq") - 1, F.lit(0)))
    return rows.groupBy("source_id").agg(
        F.count_if(F.col("event_type") == OUTAGE).alias("outages"),
        F.coalesce(F.max(span), F.lit(0).cast("bigint")).alias("longest_outage_ns"),
        F.coalesce(F.sum(buffered), F.lit(0).cast("bigint")).alias("buffered"),
        ((F.count_if(pair) > 0) & (F.max_by("event_type", "ordinal") != OUTAGE)).alias("replay_completed"))


def session_gaps(records: DataFrame, max_silence: str) -> DataFrame:
    """Silences as the space between heartbeat sessions; the batch twin of the streaming detector.

    Heartbeats further apart than the limit are in two sessions, so the silences are the over-long spans.
    """
    limit = records.sparkSession.sql(f"SELECT CAST(INTERVAL {max_silence} AS INTERVAL DAY TO SECOND) AS d").select(
        (F.expr("extract(DAY FROM d)") * 86400 + F.expr("extract(HOUR FROM d)") * 3600 + F.expr("extract(MINUTE FROM d)") * 60 + F.expr("extract(SECOND FROM d)")).cast("double")).first()[0]
    widest = int(limit * 1_000_000)
    beats = records.where(F.col("event_type") == HEARTBEAT).select("source_id", F.call_function("div", F.col("time_ns"), F.lit(1000).cast("bigint")).alias("at"))
    return spans_between(beats.where("at is not null"), ["source_id"], "at", widest).where(F.col("gap") >= widest).select(
        "source_id", F.col("start").alias("start_us"), F.col("stop").alias("end_us"))


def heartbeat_cadence(records: DataFrame, window: str) -> DataFrame:
    """Heartbeats per source and tumbling window."""
    at = F.timestamp_micros(F.call_function("div", F.col("time_ns"), F.lit(1000).cast("bigint")))
    return (records.where(F.col("event_type") == HEARTBEAT).withColumn("at", at)
            .groupBy("source_id", F.window("at", window)).agg(F.count("*").alias("beats"))
            .select("source_id", F.unix_micros("window.start").alias("start_us"), "beats"))
