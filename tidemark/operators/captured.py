"""Per-source facts of captured records: counts, spans, drift, revocations.

Input ``records(source_id, ordinal, seq, event_type, time_ns, payload_clear, payload_ct, key_id, record_hash)``,
where ordinal is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import parse_pinned_ns
from tidemark.operators.chain import parsed_frames

# Event types of captured records.
HEARTBEAT = "system.heartbeat"
STOPPED = "system.agent_stopped"
OUTAGE = "system.network_outage"
REPLAY = "system.replay_completed"
KEY_REVOKED = "system.key_revoked"
SYSTEM_PREFIX = "system."
SYSTEM_BUCKET = "system.* (heartbeats excluded)"
HEARTBEAT_PAYLOAD = (
    "agent struct<version:string,uptime_seconds:bigint>, "
    "continuity struct<last_local_seq:bigint,last_uploaded_seq:bigint,last_ack_seq:bigint,queue_depth:bigint>, "
    "health struct<disk_free_bytes:bigint,clock_drift_ms:bigint>, "
    "time_source struct<source:string,sync_state:string,server:string>")


def is_system(event_type: str = "event_type") -> Column:
    return F.col(event_type).startswith(SYSTEM_PREFIX)


def records_of(frames: DataFrame) -> DataFrame:
    """Typed records of frames(source_id, ordinal, record_bytes, claimed_hash); unparseable ones stay out."""
    parsed = parsed_frames(frames).where(~F.col("parse_error"))
    return parsed.select(
        "source_id", "ordinal", "record.seq", "record.event_type", parse_pinned_ns(F.col("record.event_time")).alias("time_ns"),
        "record.payload_clear", "record.payload_ct", "record.key_id", "record.prev_hash", "record_hash", "claimed_hash")


def event_counts(records: DataFrame) -> DataFrame:
    """Counts by type, heartbeats left out and other system events in one bucket."""
    kind = F.when(is_system(), F.lit(SYSTEM_BUCKET)).otherwise(F.col("event_type"))
    return (records.where(F.col("event_type") != HEARTBEAT).groupBy("source_id", kind.alias("type"))
            .agg(F.count("*").alias("n")))


def captured_spans(records: DataFrame) -> DataFrame:
    """Range and head by arrival, time span, privacy posture: one partial-aggregated pass."""
    at = F.col("ordinal")
    named = F.nullif("key_id", F.lit(""))
    return records.groupBy("source_id").agg(
        F.count("*").alias("records"), F.min_by("seq", at).alias("seq_first"), F.max_by("seq", at).alias("seq_last"),
        F.max_by("record_hash", at).alias("chain_head"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"),
        F.bool_or(F.coalesce("payload_ct", F.lit("")) != "").alias("encrypted"),
        F.coalesce(F.min_by(named, F.when(named.isNotNull(), at)), F.lit("")).alias("key_id"))


def heartbeat_payloads(records: DataFrame) -> DataFrame:
    payload = F.from_json("payload_clear", HEARTBEAT_PAYLOAD)
    return (records.where(F.col("event_type") == HEARTBEAT).withColumn("p", payload)
            .select("source_id", "ordinal", "seq", "p.*"))


def clock_drift(records: DataFrame) -> DataFrame:
    """Largest absolute drift per source with a heartbeat payload that states one."""
    return (heartbeat_payloads(records).groupBy("source_id")
            .agg(F.coalesce(F.max(F.abs("health.clock_drift_ms")), F.lit(0).cast("bigint")).alias("max_drift_ms")))


def key_revocations(records: DataFrame) -> DataFrame:
    """Revocations with the label, reason and start of exposure a finding states."""
    def text(field: str) -> Column:
        return F.nullif(F.get_json_object("payload_clear", f"$.{field}"), F.lit(""))

    return records.where(F.col("event_type") == KEY_REVOKED).select(
        "source_id", "ordinal", "seq",
        F.coalesce(text("revoked_key_id"), text("revoked_key_name"), F.lit("unknown")).alias("label"),
        F.coalesce(text("reason"), F.lit("unstated")).alias("reason"),
        F.coalesce(text("suspected_since"), F.lit("an unstated time")).alias("since"), "time_ns")
