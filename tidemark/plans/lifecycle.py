"""Retention runs and the evidence rows they leave behind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hex_lower
from tidemark.operators import retention as ret


@dataclass(frozen=True)
class RetentionRun:
    """New snapshots to write: the segment table, and the evidence rows to hand to intake."""

    segments: DataFrame
    events: DataFrame


def _event(kind: str, payload):
    return [F.lit(kind).alias("event_type"), payload.alias("payload")]


def deletion_events(expired: DataFrame, policy_json: str) -> DataFrame:
    """One row per expired segment. The record of a run is the set of its rows, so no list grows with the run."""
    payload = F.concat(
        F.lit('{"segment_id":"'), "segment_id", F.lit('","source_id":"'), "source_id", F.lit('","seq_first":'),
        F.col("seq_first").cast("string"), F.lit(',"seq_last":'), F.col("seq_last").cast("string"), F.lit(',"root":"'),
        hex_lower(F.col("root")), F.lit('","policy":'), F.lit(policy_json), F.lit("}"))
    return expired.select("source_id", *_event("system.retention_deleted", payload))


def policy_events(changes: DataFrame) -> DataFrame:
    payload = F.concat(
        F.lit('{"old_policy":'), F.coalesce(F.nullif("old_policy", F.lit("")), F.lit("null")), F.lit(',"new_policy":'),
        "new_policy", F.lit(',"sha256":"'), "sha256", F.lit('"}'))
    return changes.where("changed").select(
        F.coalesce(F.col("source_id"), F.lit("")).alias("source_id"), *_event("system.retention_policy_changed", payload))


def hold_events(holds: DataFrame) -> DataFrame:
    """Placed holds, and released ones as a second row."""
    ranged = F.col("seq_first").isNotNull() & F.col("seq_last").isNotNull()
    reason = F.to_json(F.array("reason"))
    quoted = F.substring(reason, F.lit(2), F.length(reason) - 2)
    payload = F.concat(
        F.lit('{"has_range":'), ranged.cast("string"), F.lit(',"hold_id":"'), "hold_id", F.lit('","reason":'),
        quoted, F.lit(',"seq_first":'), F.coalesce("seq_first", F.lit(0)).cast("string"),
        F.lit(',"seq_last":'), F.coalesce("seq_last", F.lit(0)).cast("string"), F.lit(',"source_id":"'), "source_id", F.lit('"}'))
    placed = holds.select("source_id", *_event("system.legal_hold_placed", payload))
    released = holds.where(F.col("released_at").isNotNull()).select(
        "source_id", *_event("system.legal_hold_released", payload))
    return placed.unionByName(released)


def run_retention(segments: DataFrame, holds: DataFrame, default_days: int, as_of: str) -> RetentionRun:
    """Expires what is due at ``as_of`` (an argument, never the clock) and says so in evidence rows."""
    after = ret.expire(segments, holds, default_days, as_of)
    policy = f'{{"default_days":{default_days}}}'
    return RetentionRun(after.drop("expired"), deletion_events(after.where("expired"), policy))
