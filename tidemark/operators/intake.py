"""Intake: request checks, record shaping, record and segment validation, dedup of deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import is_hex64, is_lower_hex64, sha_hex
from tidemark.functions.ids import is_uuid7
from tidemark.functions.notes import parse_checkpoint
from tidemark.functions.times import RFC3339, parse_layout_us
from tidemark.operators.captured import SYSTEM_PREFIX
from tidemark.operators.ordered import stitched_lag

# Version, outcomes and size limits of captured data.
RECORD_VERSION = 2
OUTCOMES = ("", "success", "failure", "denied", "unknown")
MAX_FRAME_BYTES = 16 << 20
MAX_SEGMENT_FRAMES = 1024
MAX_SEGMENT_BYTES = MAX_SEGMENT_FRAMES * (512 << 10)
MAX_BODY_BYTES = 4 << 20
OK = "ok"
REQUEST_FIELDS = ("event_type string, event_time string, actor string, outcome string, "
                  "labels map<string,string>, payload string")


def _is_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def first_rule(rules: list[tuple[Column, str]]) -> Column:
    """The code of the first rule that is broken, or ok."""
    chain = F.lit(OK)
    for broken, code in reversed(rules):
        chain = F.when(F.coalesce(broken, F.lit(True)), F.lit(code)).otherwise(chain)
    return chain


def record_error() -> Column:
    """Validation code of a record row; the first failing rule wins."""
    system = F.coalesce(F.col("event_type").startswith(SYSTEM_PREFIX), F.lit(False))
    actor = F.coalesce("actor", F.lit(""))
    return first_rule([
        (F.col("v") != RECORD_VERSION, "missing_v"),
        (_is_empty("source_id"), "missing_source_id"),
        (F.coalesce("seq", F.lit(0)) == 0, "missing_seq"),
        (_is_empty("event_type"), "missing_event_type"),
        (_is_empty("event_time"), "missing_event_time"),
        (_is_empty("ingest_time"), "missing_ingest_time"),
        (~is_hex64(F.coalesce("prev_hash", F.lit(""))), "bad_prev_hash"),
        (~F.coalesce("outcome", F.lit("")).isin(*OUTCOMES), "bad_outcome"),
        (~system & (actor != "") & ~is_lower_hex64(actor), "bad_actor"),
        (system & _is_empty("payload_clear"), "system_without_payload_clear"),
        (system & ~(_is_empty("payload_ct") & _is_empty("payload_hash")), "system_with_payload_ct"),
        (~system & ~_is_empty("payload_clear"), "payload_clear_on_event"),
        (~system & _is_empty("payload_ct"), "missing_payload_ct"),
        (~system & ~is_hex64(F.coalesce("payload_hash", F.lit(""))), "bad_payload_hash"),
        (~system & _is_empty("key_id"), "missing_key_id"),
    ])


def frame_status(max_bytes: int = MAX_FRAME_BYTES) -> Column:
    """Check of one frame (record_bytes, claimed_hash hex)."""
    size = F.octet_length("record_bytes")
    return first_rule([
        (~F.col("claimed_hash").rlike("^[0-9a-fA-F]{64}$"), "digest_length"),
        ((size == 0) | (size > max_bytes), "frame_length"),
        (sha_hex(F.col("record_bytes")) != F.lower("claimed_hash"), "hash_mismatch"),
    ])


def segment_status() -> Column:
    """Check of one segment row (segment_id, source_id, seq_first, seq_last, root, checkpoint)."""
    note = parse_checkpoint(F.col("checkpoint"))
    return first_rule([
        (~is_uuid7(F.col("segment_id")), "bad_segment_id"),
        (_is_empty("source_id"), "missing_source_id"),
        ((F.col("seq_first") == 0) | (F.col("seq_first") > F.col("seq_last")), "bad_range"),
        (F.octet_length("root") != 32, "bad_root_length"),
        (note.isNull(), "malformed_checkpoint"),
        (note["size"] != F.col("seq_last").cast("decimal(20,0)"), "size_mismatch"),
        (note["root"] != F.col("root"), "root_mismatch"),
    ])


def segment_contiguity(frames: DataFrame, segments: DataFrame, max_frames: int = MAX_SEGMENT_FRAMES,
                       max_bytes: int = MAX_SEGMENT_BYTES) -> DataFrame:
    """Status per segment: frames of the same source, contiguous from seq_first, ending at seq_last, in caps.

    ``frames(segment_id, position, source_id, seq, size)``; positions follow delivery order inside a segment.
    A frame over the caps is refused with its segment, so an oversized segment needs no window to be judged.
    """
    steps = stitched_lag(frames, ["segment_id"], "position", ["seq"], max_frames)
    shape = steps.groupBy("segment_id").agg(
        F.count("*").alias("frames"), F.sum("size").alias("bytes"),
        F.min_by("seq", "position").alias("first"), F.max_by("seq", "position").alias("last"),
        F.count_if(F.col("seq") != F.col("prev_seq") + 1).alias("breaks"),
        F.min("source_id").alias("low_source"), F.max("source_id").alias("high_source"))
    joined = segments.join(shape, "segment_id", "left")
    status = first_rule([
        (F.col("frames").isNull(), "empty"),
        (F.col("frames") > max_frames, "too_many_frames"),
        (F.col("bytes") > max_bytes, "too_many_bytes"),
        ((F.col("low_source") != F.col("source_id")) | (F.col("high_source") != F.col("source_id")), "other_source"),
        ((F.col("first") != F.col("seq_first")) | (F.col("breaks") > 0), "out_of_order"),
        (F.col("last") != F.col("seq_last"), "short_range"),
    ])
    return joined.select("segment_id", "source_id", "seq_first", "seq_last", status.alias("status"))


DELIVERY_KEY = ["source_id", "seq_first", "seq_last", "root"]


def new_segments(delivered: DataFrame, stored: DataFrame) -> DataFrame:
    """Deliveries that are not stored yet, one row per (source, range, root); repeats collapse."""
    return delivered.join(stored.select(*DELIVERY_KEY), DELIVERY_KEY, "left_anti").dropDuplicates(DELIVERY_KEY)


def flag_duplicates(delivered: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Adds ``duplicate``: the segment is stored already, or an earlier delivery (by ``order``, unique per key) brings it."""
    known = stored.select(*DELIVERY_KEY).distinct().withColumn("_known", F.lit(True))
    first = delivered.groupBy(*DELIVERY_KEY).agg(F.min(order).alias("_first"))
    return delivered.join(first.join(known, DELIVERY_KEY, "left"), DELIVERY_KEY).withColumn(
        "duplicate", F.col("_known").isNotNull() | (F.col(order) > F.col("_first"))).drop("_known", "_first")


def request_status(trusted_origin: Column | None = None, max_body: int = MAX_BODY_BYTES) -> Column:
    """Code for a request row with body (JSON text) and its parsed struct ``request``."""
    event_type = F.coalesce("request.event_type", F.lit(""))
    event_time = F.coalesce("request.event_time", F.lit(""))
    valid_json = F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT")
    readable_time = event_time.rlike(RFC3339) & parse_layout_us(event_time, "rfc3339nano").isNotNull()
    reserved = event_type.startswith(SYSTEM_PREFIX)
    if trusted_origin is not None:
        reserved = reserved & ~trusted_origin
    return first_rule([
        (F.octet_length("body") > max_body, "body_too_large"),
        (~F.coalesce(valid_json, F.lit(False)), "invalid_json"),
        (event_type == "", "missing_event_type"),
        (~F.coalesce("request.outcome", F.lit("")).isin(*OUTCOMES), "bad_outcome"),
        ((event_time != "") & ~F.coalesce(readable_time, F.lit(False)), "bad_event_time"),
        (reserved, "reserved_event_type"),
    ])


def parse_requests(bodies: DataFrame) -> DataFrame:
    return bodies.withColumn("request", F.from_json("body", REQUEST_FIELDS))


def wrap_payload(labels: Column, payload: Column) -> Column:
    """Folds labels into the payload; without labels the payload stays as it is."""
    ordered = F.map_from_entries(F.sort_array(F.map_entries(labels)))
    wrapped = F.concat(F.lit('{"labels":'), F.to_json(ordered), F.lit(',"data":'),
                       F.coalesce(F.nullif(payload, F.lit("")), F.lit("null")), F.lit("}"))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, wrapped).otherwise(payload)


def shape_records(events: DataFrame, key_id: str) -> DataFrame:
    """Accepted events to record columns before chaining.

    ``events(source_id, ordinal, event_type, event_time, ingest_time, pseudonym, outcome, labels, payload, sealed)``
    where sealed is the base64 ciphertext of the wrapped payload.
    """
    system = F.col("event_type").startswith(SYSTEM_PREFIX)
    wrapped = wrap_payload(F.col("labels"), F.col("payload"))
    return events.withColumn("_wrapped", wrapped).select(
        "source_id", "ordinal", F.lit(RECORD_VERSION).alias("v"), "event_type",
        F.coalesce(F.nullif("event_time", F.lit("")), F.col("ingest_time")).alias("event_time"), "ingest_time",
        F.when(system, F.lit("")).otherwise(F.coalesce("pseudonym", F.lit(""))).alias("actor"), "outcome",
        F.when(system, F.coalesce(F.nullif("_wrapped", F.lit("")), F.lit("{}"))).alias("payload_clear"),
        F.when(~system, F.col("sealed")).alias("payload_ct"),
        F.when(~system, F.sha2(F.encode(F.coalesce("_wrapped", F.lit("")), "UTF-8"), 256)).alias("payload_hash"),
        F.when(~system, F.lit(key_id)).alias("key_id"))
