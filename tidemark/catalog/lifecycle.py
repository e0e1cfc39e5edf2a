"""Queries over intake and lifecycle: validation, dedup, holds, retention, pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.base import Tables, query
from tidemark.catalog.logs import micros
from tidemark.catalog.scalars import _case, _shown_uuid
from tidemark.functions.hashing import base64_text, hex_lower
from tidemark.functions.times import format_pinned
from tidemark.operators import intake, intervals, retention as ret
from tidemark.operators import pseudonyms as ps
from tidemark.operators.chain import assign_sequence
from tidemark.operators.segments import segments_by_age, segments_by_count, with_ids
from tidemark.plans import lifecycle as plan

PER_SEGMENT = 16
AS_OF = "2024-02-01T00:00:00.000000000Z"
KEEP_DAYS = 12
CUTOFF = ret.cutoff_of(AS_OF, KEEP_DAYS)


def user_records(t: Tables) -> DataFrame:
    events = t.read("events").select(
        F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("ordinal"),
        (micros("ts") * 1000).alias("time_ns"), "event_type", "props")
    return assign_sequence(events, "ordinal")


RECORDS_SQL = """recs AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS ordinal, epoch_us(ts) * 1000 AS time_ns, ts, event_type, props,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events)"""
STAMP = "(strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || '000Z')"
SEGMENTS_SQL = f"""{RECORDS_SQL},
segs AS (SELECT *, {_shown_uuid('(created_ns // 1000000)', "source_id || '/' || seq_first")} AS segment_id, {STAMP.format('made')} AS created_at,
  sha256(source_id || '/' || seq_last) AS root, CASE WHEN CAST(source_id AS BIGINT) % 23 = 0 AND segment = 0 THEN '2024-01-15T00:00:00.000000000Z' END AS deleted_at FROM (
  SELECT source_id, (seq - 1) // {PER_SEGMENT} AS segment, min(seq) AS seq_first, max(seq) AS seq_last, max(time_ns) AS created_ns, max(ts) AS made FROM recs GROUP BY ALL))"""


def user_segments(t: Tables) -> DataFrame:
    segments = with_ids(segments_by_count(user_records(t), PER_SEGMENT))
    root = F.unhex(F.sha2(F.encode(F.concat("source_id", F.lit("/"), F.col("seq_last").cast("string")), "UTF-8"), 256))
    gone = (F.col("source_id").cast("bigint") % 23 == 0) & (F.col("segment") == 0)
    return segments.withColumns({
        "created_at": format_pinned(F.col("created_ns")), "root": root,
        "deleted_at": F.when(gone, F.lit("2024-01-15T00:00:00.000000000Z"))})


HOLDS_SQL = """holds AS (SELECT 'hold-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS hold_id, CAST(c_custkey % 600 AS VARCHAR) AS source_id,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 40 + 1 END AS seq_first, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 40 + 1 + c_custkey % 20 END AS seq_last,
  c_mktsegment AS reason, CASE WHEN c_custkey % 4 <> 0 THEN '2024-01-10T00:00:00.000000000Z' END AS released_at FROM customer)"""


def holds(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    first = F.when(key % 3 != 0, key % 40 + 1)
    return t.read("customer").select(
        F.concat(F.lit("hold-"), F.lpad(key.cast("string"), 10, "0")).alias("hold_id"), (key % 600).cast("string").alias("source_id"),
        first.alias("seq_first"), (first + key % 20).alias("seq_last"), F.col("c_mktsegment").alias("reason"),
        F.when(key % 4 != 0, F.lit("2024-01-10T00:00:00.000000000Z")).alias("released_at"))


@query("segment_by_count", f"WITH {SEGMENTS_SQL} SELECT source_id, segment, segment_id, seq_first, seq_last, created_ns FROM segs")
def segment_by_count(t: Tables):
    return user_segments(t).select("source_id", "segment", "segment_id", "seq_first", "seq_last", "created_ns")


DAY_NS = 86_400_000_000_000


@query("segment_by_age", f"""WITH RECURSIVE {RECORDS_SQL},
cuts AS (SELECT source_id, seq, time_ns, 0 AS segment FROM recs WHERE seq = 1
  UNION ALL SELECT n.source_id, n.seq, n.time_ns, n.segment FROM (
    SELECT r.source_id, r.seq, r.time_ns, c.segment + 1 AS segment, row_number() OVER (PARTITION BY r.source_id ORDER BY r.seq) AS rn
    FROM cuts c JOIN recs r ON r.source_id = c.source_id AND r.seq > c.seq AND (r.seq >= c.seq + 5 OR r.time_ns >= c.time_ns + {DAY_NS})) n WHERE rn = 1)
SELECT r.source_id, r.seq, CAST(max(c.segment) AS BIGINT) AS segment FROM recs r JOIN cuts c ON c.source_id = r.source_id AND c.seq <= r.seq GROUP BY ALL""")
def segment_by_age(t: Tables):
    return segments_by_age(user_records(t), max_records=5, max_age_ns=DAY_NS)


@query("pull_from_seq", f"""WITH {SEGMENTS_SQL} SELECT r.source_id, r.seq, r.event_type FROM recs r JOIN segs s
  ON s.source_id = r.source_id AND r.seq BETWEEN s.seq_first AND s.seq_last WHERE s.deleted_at IS NULL AND r.seq >= 11""")
def pull_from_seq(t: Tables):
    from tidemark.operators.segments import pull_from, segment_number

    segments = user_segments(t)
    numbered = user_records(t).withColumn("segment", segment_number(F.col("seq"), PER_SEGMENT))
    frames = numbered.join(segments.select("source_id", "segment", "segment_id"), ["source_id", "segment"])
    return pull_from(frames, segments, 11).select("source_id", "seq", "event_type")


@query("validate_records", """SELECT event_id, CASE event_id % 20 WHEN 0 THEN 'missing_v' WHEN 1 THEN 'missing_source_id' WHEN 2 THEN 'missing_seq' WHEN 3 THEN 'missing_event_type'
  WHEN 4 THEN 'missing_event_time' WHEN 5 THEN 'missing_ingest_time' WHEN 6 THEN 'bad_prev_hash' WHEN 7 THEN 'bad_outcome'
  WHEN 8 THEN CASE WHEN event_type <> 'view' THEN 'bad_actor' ELSE 'ok' END WHEN 9 THEN CASE WHEN event_type = 'view' THEN 'system_without_payload_clear' ELSE 'ok' END
  WHEN 10 THEN CASE WHEN event_type = 'view' THEN 'system_with_payload_ct' ELSE 'ok' END WHEN 11 THEN CASE WHEN event_type <> 'view' THEN 'payload_clear_on_event' ELSE 'ok' END
  WHEN 12 THEN CASE WHEN event_type <> 'view' THEN 'missing_payload_ct' ELSE 'ok' END WHEN 13 THEN CASE WHEN event_type <> 'view' THEN 'bad_payload_hash' ELSE 'ok' END
  WHEN 14 THEN CASE WHEN event_type <> 'view' THEN 'missing_key_id' ELSE 'ok' END ELSE 'ok' END AS error FROM events""")
def validate_records(t: Tables):
    m, system = F.col("event_id") % 20, F.col("event_type") == "view"
    stamp = format_pinned(micros("ts") * 1000)
    broken = lambda number, bad, good: F.when(m == number, bad).otherwise(good)
    text, none = F.lit, F.lit(None).cast("string")
    hashed = F.sha2(F.encode("props", "UTF-8"), 256)
    rows = t.read("events").select(
        "event_id", broken(0, F.lit(1), F.lit(2)).alias("v"), broken(1, text(""), F.col("user_id").cast("string")).alias("source_id"),
        broken(2, F.lit(0), F.col("event_id") + 1).alias("seq"),
        broken(3, text(""), F.when(system, text("system.view")).otherwise(F.col("event_type"))).alias("event_type"),
        broken(4, text(""), stamp).alias("event_time"), broken(5, text(""), stamp).alias("ingest_time"),
        broken(6, text("xyz"), hashed).alias("prev_hash"), broken(7, text("maybe"), text("success")).alias("outcome"),
        broken(8, F.upper(hashed), F.when(~system, hashed).otherwise(text(""))).alias("actor"),
        F.when(system, broken(9, none, F.col("props"))).otherwise(broken(11, F.col("props"), none)).alias("payload_clear"),
        F.when(system, broken(10, text("Y3Q="), none)).otherwise(broken(12, none, text("Y3Q="))).alias("payload_ct"),
        F.when(~system, broken(13, text("00"), hashed)).alias("payload_hash"), F.when(~system, broken(14, none, text("key"))).alias("key_id"))
    return rows.select("event_id", intake.record_error().alias("error"))


@query("validate_segments", f"""WITH {SEGMENTS_SQL} SELECT source_id, segment, CASE (CAST(source_id AS BIGINT) + segment) % 10 WHEN 0 THEN 'bad_segment_id' WHEN 1 THEN 'missing_source_id'
  WHEN 2 THEN 'bad_range' WHEN 3 THEN 'bad_root_length' WHEN 4 THEN 'malformed_checkpoint' WHEN 5 THEN 'size_mismatch' WHEN 6 THEN 'root_mismatch' ELSE 'ok' END AS status FROM segs""")
def validate_segments(t: Tables):
    m = (F.col("source_id").cast("bigint") + F.col("segment")) % 10
    size = F.col("seq_last") + F.when(m == 5, 1).otherwise(0)
    root = F.when(m == 6, F.unhex(F.reverse(F.hex("root")))).otherwise(F.col("root"))
    note = F.concat(F.lit("log/"), "source_id", F.lit("\n"), size.cast("string"), F.lit("\n"), base64_text(root),
                    F.when(m == 4, F.lit("\n")).otherwise(F.lit("\n\n")), F.lit("— signer AAAA\n"))
    rows = user_segments(t).withColumn("checkpoint", note).select(
        F.col("source_id").alias("owner"), "segment", F.when(m == 0, F.lit("../escape")).otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(m == 1, F.lit("")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(m == 2, F.col("seq_last") + 1).otherwise(F.col("seq_first")).alias("seq_first"), "seq_last",
        F.when(m == 3, F.substring("root", 1, 31)).otherwise(F.col("root")).alias("root"), "checkpoint")
    return rows.select(F.col("owner").alias("source_id"), "segment", intake.segment_status().alias("status"))


def delivered_frames(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Segments and their frames as delivered; some frames are lost, some belong to another source."""
    segments = user_segments(t).select("source_id", "segment", "segment_id", "seq_first", "seq_last", "root", "deleted_at")
    user = F.col("source_id").cast("bigint")
    records = user_records(t).withColumn("segment", F.call_function("div", F.col("seq") - 1, F.lit(PER_SEGMENT).cast("bigint")))
    kept = records.where((user + F.col("seq")) % 53 != 0)
    frames = kept.join(segments.select("source_id", "segment", "segment_id"), ["source_id", "segment"]).select(
        "segment_id", F.col("seq").alias("position"), F.when((user * 3 + F.col("seq")) % 97 == 0, F.lit("other")).otherwise(F.col("source_id")).alias("source_id"),
        "seq", F.octet_length("props").alias("size"))
    return segments, frames


CONTIGUITY_SQL = """delivered AS (SELECT s.segment_id, s.source_id, s.seq_first, s.seq_last, r.seq, (CAST(r.source_id AS BIGINT) * 3 + r.seq) % 97 = 0 AS foreign_frame
  FROM segs s LEFT JOIN recs r ON r.source_id = s.source_id AND r.seq BETWEEN s.seq_first AND s.seq_last AND (CAST(r.source_id AS BIGINT) + r.seq) % 53 <> 0),
contiguity AS (SELECT segment_id, source_id, seq_first, seq_last, CASE WHEN count(seq) = 0 THEN 'empty' WHEN bool_or(foreign_frame) THEN 'other_source'
  WHEN min(seq) <> seq_first OR max(seq) - min(seq) + 1 <> count(seq) THEN 'out_of_order' WHEN max(seq) <> seq_last THEN 'short_range' ELSE 'ok' END AS status
  FROM delivered GROUP BY segment_id, source_id, seq_first, seq_last)"""


@query("segment_contiguity", f"WITH {SEGMENTS_SQL}, {CONTIGUITY_SQL} SELECT * FROM contiguity")
def segment_contiguity(t: Tables):
    segments, frames = delivered_frames(t)
    return intake.segment_contiguity(frames, segments.select("segment_id", "source_id", "seq_first", "seq_last"))


def deliveries(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every segment delivered one to three times; a third of them is stored already."""
    segments = user_segments(t).select("source_id", "segment", "segment_id", "seq_first", "seq_last", "root")
    times = (F.col("source_id").cast("bigint") + F.col("segment")) % 3 + 1
    delivered = segments.withColumn("delivery", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return delivered, segments.where(F.col("segment") % 3 == 0)


@query("segment_dedup", f"""WITH {SEGMENTS_SQL} SELECT source_id, seq_first, seq_last, g.delivery, segment % 3 = 0 OR g.delivery > 1 AS duplicate
FROM segs, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS delivery) g WHERE g.delivery <= (CAST(source_id AS BIGINT) + segment) % 3 + 1""")
def segment_dedup(t: Tables):
    delivered, stored = deliveries(t)
    return intake.flag_duplicates(delivered, stored, "delivery").select("source_id", "seq_first", "seq_last", "delivery", "duplicate")


@query("intake_validate", """SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'missing_event_type' WHEN 2 THEN 'bad_outcome' WHEN 3 THEN 'bad_event_time'
  WHEN 4 THEN CASE WHEN user_id % 2 = 0 THEN 'ok' ELSE 'reserved_event_type' END ELSE 'ok' END AS status FROM events""")
def intake_validate(t: Tables):
    m = F.col("event_id") % 12
    kind = F.when(m == 1, F.lit("")).when(m == 4, F.lit("system.key_rotated")).otherwise(F.col("event_type"))
    body = F.concat(
        F.lit('{"event_type":"'), kind, F.lit('","actor":"u'), F.col("user_id").cast("string"), F.lit('","outcome":"'),
        F.when(m == 2, F.lit("maybe")).otherwise(F.lit("success")), F.lit('","event_time":"'),
        F.when(m == 3, F.lit("noon")).when(m == 5, F.lit("")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.lit('","labels":{"a":"b"},"payload":'), "props", F.lit("}"))
    rows = t.read("events").select("event_id", (F.col("user_id") % 2 == 0).alias("trusted"), F.when(m == 0, F.substring(body, 1, 15)).otherwise(body).alias("body"))
    return intake.parse_requests(rows).select("event_id", intake.request_status(F.col("trusted")).alias("status"))


@query("wrap_labels", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"labels":{"app":"' || event_type || '","env":"t"},"data":' || props || '}'
  WHEN 2 THEN '{"labels":{"app":"' || event_type || '"},"data":null}' END AS payload FROM events""")
def wrap_labels(t: Tables):
    m = F.col("event_id") % 4
    both = F.create_map(F.lit("env"), F.lit("t"), F.lit("app"), F.col("event_type"))
    labels = F.when(m == 1, both).when(m == 2, F.create_map(F.lit("app"), F.col("event_type")))
    return t.read("events").select("event_id", intake.wrap_payload(labels, F.when(m < 2, F.col("props"))).alias("payload"))


@query("shape_records", """SELECT event_id AS ordinal, 2 AS v, CASE WHEN s THEN 'system.view' ELSE event_type END AS event_type,
  CASE WHEN event_id % 3 = 0 THEN ingest ELSE '2024-01-01T00:00:00.000000000Z' END AS event_time, ingest AS ingest_time, CASE WHEN s OR event_id % 5 = 0 THEN '' ELSE sha256(CAST(user_id AS VARCHAR)) END AS actor,
  CASE WHEN s THEN CASE WHEN event_id % 7 = 0 THEN '{}' ELSE props END END AS payload_clear, CASE WHEN NOT s THEN 'sealed' END AS payload_ct,
  CASE WHEN NOT s THEN sha256(CASE WHEN event_id % 7 = 0 THEN '' ELSE props END) END AS payload_hash, CASE WHEN NOT s THEN 'org' END AS key_id
FROM (SELECT *, event_type = 'view' AS s, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS ingest FROM events)""")
def shape_records(t: Tables):
    key = F.col("event_id")
    events = t.read("events").select(
        F.col("user_id").cast("string").alias("source_id"), key.alias("ordinal"),
        F.when(F.col("event_type") == "view", F.lit("system.view")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(key % 3 != 0, F.lit("2024-01-01T00:00:00.000000000Z")).alias("event_time"), format_pinned(micros("ts") * 1000).alias("ingest_time"),
        F.when(key % 5 != 0, F.sha2(F.encode(F.col("user_id").cast("string"), "UTF-8"), 256)).alias("pseudonym"), F.lit("").alias("outcome"),
        F.lit(None).cast("map<string,string>").alias("labels"), F.when(key % 7 != 0, F.col("props")).alias("payload"), F.lit("sealed").alias("sealed"))
    return intake.shape_records(events, "org").drop("source_id", "outcome")


def salts(t: Tables) -> DataFrame:
    actors = t.read("events").select("user_id").distinct().where(F.col("user_id") % 3 != 0)
    return actors.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
        F.unhex(F.sha2(F.encode(F.concat(F.lit("salt"), F.col("user_id").cast("string")), "UTF-8"), 256)).alias("salt"))


HMAC_SQL = """salts AS (SELECT DISTINCT 'u' || user_id AS actor, unhex(sha256('salt' || user_id) || repeat('00', 32)) AS key FROM events WHERE user_id % 3 <> 0),
pads AS (SELECT actor, CAST(xor(CAST(key AS BIT), CAST(unhex(repeat('36', 64)) AS BIT)) AS BLOB) AS ipad, CAST(xor(CAST(key AS BIT), CAST(unhex(repeat('5C', 64)) AS BIT)) AS BLOB) AS opad FROM salts),
known AS (SELECT actor, sha256(opad || unhex(sha256(ipad || encode(actor)))) AS pseudonym FROM pads)"""


@query("pseudonymise", f"WITH {HMAC_SQL} SELECT event_id, 'u' || user_id AS actor, pseudonym FROM events LEFT JOIN known ON actor = 'u' || user_id")
def pseudonymise(t: Tables):
    events = t.read("events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"))
    return ps.pseudonymise(events, salts(t))


@query("salt_erase", f"WITH {HMAC_SQL} SELECT event_id, CASE WHEN user_id % 2 = 0 THEN pseudonym END AS pseudonym FROM events LEFT JOIN known ON actor = 'u' || user_id")
def salt_erase(t: Tables):
    # Actors with odd numbers ask to be erased; afterwards nothing derives their pseudonyms.
    events = t.read("events").select("event_id", "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"))
    remaining = ps.erase(salts(t), events.where(F.col("user_id") % 2 == 1))
    return ps.pseudonymise(events, remaining).select("event_id", "pseudonym")


@query("retention_candidates", f"WITH {SEGMENTS_SQL} SELECT segment_id, source_id, seq_first, seq_last, created_at FROM segs WHERE deleted_at IS NULL AND created_at < '{CUTOFF}'")
def retention_candidates(t: Tables):
    return ret.retention_candidates(user_segments(t), CUTOFF).select("segment_id", "source_id", "seq_first", "seq_last", "created_at")


HELD_SQL = """held AS (SELECT s.*, EXISTS (SELECT 1 FROM holds h WHERE h.released_at IS NULL AND h.source_id = s.source_id
  AND (h.seq_first IS NULL OR (s.seq_first <= h.seq_last AND s.seq_last >= h.seq_first))) AS held FROM segs s)"""


@query("hold_exempt", f"WITH {SEGMENTS_SQL}, {HOLDS_SQL}, {HELD_SQL} SELECT segment_id, source_id, seq_first, seq_last, held FROM held")
def hold_exempt(t: Tables):
    return ret.flag_held(user_segments(t).select("segment_id", "source_id", "seq_first", "seq_last"), holds(t))


EXPIRED_SQL = f"""expired AS (SELECT *, deleted_at IS NULL AND created_at < '{CUTOFF}' AND NOT held AS expired FROM held),
after AS (SELECT segment_id, source_id, segment, seq_first, seq_last, root, created_at, expired, CASE WHEN expired THEN '{AS_OF}' ELSE deleted_at END AS deleted_at FROM expired)"""


def expired_segments(t: Tables) -> DataFrame:
    return ret.expire(user_segments(t), holds(t), KEEP_DAYS, AS_OF)


@query("retention_expire", f"WITH {SEGMENTS_SQL}, {HOLDS_SQL}, {HELD_SQL}, {EXPIRED_SQL} SELECT segment_id, source_id, seq_first, seq_last, deleted_at, expired FROM after")
def retention_expire(t: Tables):
    return expired_segments(t).select("segment_id", "source_id", "seq_first", "seq_last", "deleted_at", "expired")


@query("retained_frames", f"""WITH {SEGMENTS_SQL}, {HOLDS_SQL}, {HELD_SQL}, {EXPIRED_SQL} SELECT r.source_id, r.seq, a.segment_id FROM recs r
  JOIN after a ON a.source_id = r.source_id AND r.seq BETWEEN a.seq_first AND a.seq_last WHERE a.deleted_at IS NULL""")
def retained_frames(t: Tables):
    # What a rewrite of the frame table keeps after a retention run.
    segments = user_segments(t)
    numbered = user_records(t).withColumn("segment", F.call_function("div", F.col("seq") - 1, F.lit(PER_SEGMENT).cast("bigint")))
    frames = numbered.join(segments.select("source_id", "segment", "segment_id"), ["source_id", "segment"]).select("source_id", "seq", "segment_id")
    return ret.live_frames(frames, expired_segments(t))


@query("lifecycle_events", f"""WITH {SEGMENTS_SQL}, {HOLDS_SQL}, {HELD_SQL}, {EXPIRED_SQL}
SELECT source_id, 'system.retention_deleted' AS event_type, '{{"segment_id":"' || segment_id || '","source_id":"' || source_id || '","seq_first":' || seq_first || ',"seq_last":' || seq_last
  || ',"root":"' || root || '","policy":{{"default_days":12}}}}' AS payload FROM after WHERE expired
UNION ALL SELECT source_id, kind, '{{"has_range":' || (seq_first IS NOT NULL) || ',"hold_id":"' || hold_id || '","reason":"' || reason || '","seq_first":' || coalesce(seq_first, 0)
  || ',"seq_last":' || coalesce(seq_last, 0) || ',"source_id":"' || source_id || '"}}' FROM holds, (SELECT unnest(['system.legal_hold_placed', 'system.legal_hold_released']) AS kind)
  WHERE kind = 'system.legal_hold_placed' OR released_at IS NOT NULL""")
def lifecycle_events(t: Tables):
    run = plan.run_retention(user_segments(t), holds(t), KEEP_DAYS, AS_OF)
    return run.events.unionByName(plan.hold_events(holds(t)))


@query("hold_events", f"""WITH {HOLDS_SQL}, releases AS (SELECT 'hold-' || lpad(CAST(o_custkey + 100 AS VARCHAR), 10, '0') AS hold_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders)
SELECT 'release' AS request, CAST(o_orderkey AS VARCHAR) AS ref, CASE WHEN h.hold_id IS NULL THEN 'not_found' WHEN h.released_at IS NOT NULL OR turn > 1 THEN 'already_released' ELSE 'released' END AS status
FROM releases LEFT JOIN holds h USING (hold_id)
UNION ALL SELECT 'place', CAST(p_partkey AS VARCHAR), CASE p_partkey % 6 WHEN 0 THEN 'missing_source_id' WHEN 1 THEN 'missing_reason' WHEN 2 THEN 'bad_range' WHEN 3 THEN 'bad_range' ELSE 'placed' END FROM part""")
def hold_events(t: Tables):
    key = F.col("p_partkey")
    m = key % 6
    placing = t.read("part").select(
        key.cast("string").alias("ref"), F.when(m == 0, F.lit("")).otherwise(F.lit("s")).alias("source_id"),
        F.when(m == 1, F.lit("")).otherwise(F.col("p_brand")).alias("reason"),
        F.when(m == 2, F.lit(9)).when(m == 3, F.lit(4)).when(m == 4, F.lit(3)).cast("bigint").alias("seq_first"),
        F.when(m == 2, F.lit(5)).when(m == 4, F.lit(8)).cast("bigint").alias("seq_last"))
    releasing = t.read("orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("ref"), F.concat(F.lit("hold-"), F.lpad((F.col("o_custkey") + 100).cast("string"), 10, "0")).alias("hold_id"))
    placed = ret.place_requests(placing).select(F.lit("place").alias("request"), "ref", "status")
    released = ret.release_requests(releasing, holds(t), "o_orderkey").select(F.lit("release").alias("request"), "ref", "status")
    return placed.unionByName(released)


@query("list_holds", f"""WITH {HOLDS_SQL}, page AS (SELECT * FROM holds WHERE hold_id > 'hold-0000000500' ORDER BY hold_id LIMIT 300)
SELECT hold_id, source_id, (SELECT max(hold_id) FROM page) AS next_token FROM page""")
def list_holds(t: Tables):
    return ret.list_page(holds(t), "hold_id", 300, "hold-0000000500").select("hold_id", "source_id", "next_token")


@query("list_tombstones", f"""WITH {SEGMENTS_SQL}, {HOLDS_SQL}, {HELD_SQL}, {EXPIRED_SQL}, page AS (SELECT * FROM after WHERE deleted_at IS NOT NULL ORDER BY segment_id LIMIT 1000)
SELECT segment_id, source_id, seq_first, seq_last, deleted_at, CASE WHEN (SELECT count(*) FROM after WHERE deleted_at IS NOT NULL) > 1000 THEN (SELECT max(segment_id) FROM page) ELSE '' END AS next_token FROM page""")
def list_tombstones(t: Tables):
    gone = ret.tombstones(expired_segments(t))
    return ret.list_page(gone, "segment_id", 5000).select("segment_id", "source_id", "seq_first", "seq_last", "deleted_at", "next_token")


@query("policy_change", """WITH p AS (SELECT CAST(c_nationkey AS VARCHAR) AS source_id, c_custkey AS id, '{"default_days":' || (c_custkey % 3 * 30) || ',"frameworks":{"audit":' || c_custkey % 2 || ',"tax":10}}' AS policy_json FROM customer),
latest AS (SELECT source_id, max_by(policy_json, id) AS old_policy FROM p GROUP BY source_id), n AS (SELECT *, '{"default_days":30,"frameworks":{"audit":1,"tax":10}}' AS new_policy FROM latest)
SELECT source_id, old_policy, new_policy, old_policy <> new_policy AS changed, sha256(new_policy) AS sha256,
  CASE WHEN old_policy <> new_policy THEN '{"old_policy":' || old_policy || ',"new_policy":' || new_policy || ',"sha256":"' || sha256(new_policy) || '"}' END AS payload FROM n""")
def policy_change(t: Tables):
    key = F.col("c_custkey")
    frameworks = lambda audit: F.create_map(F.lit("tax"), F.lit(10), F.lit("audit"), audit.cast("int"))
    stored = t.read("customer").select(
        F.col("c_nationkey").cast("string").alias("source_id"), key.alias("id"), ret.policy_json(key % 3 * 30, frameworks(key % 2)).alias("policy_json"))
    changes = ret.policy_change(stored, ret.policy_json(F.lit(ret.whole_days(720.5)), frameworks(F.lit(1))), ["source_id"])
    events = plan.policy_events(changes).select("source_id", "payload")
    return changes.join(events, "source_id", "left")


RANGES_SQL = """tomb AS (SELECT CAST(o_custkey AS VARCHAR) AS source_id, o_orderkey % 200 AS lo, o_orderkey % 200 + o_orderkey % 9 AS hi FROM orders),
reached AS (SELECT *, max(hi) OVER (PARTITION BY source_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tomb),
islands AS (SELECT *, sum(CASE WHEN lo > r + 1 OR r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM reached),
merged AS (SELECT source_id, min(lo) AS lo, max(hi) AS hi FROM islands GROUP BY source_id, island)"""


def order_ranges(t: Tables) -> DataFrame:
    lo = F.col("o_orderkey") % 200
    return t.read("orders").select(F.col("o_custkey").cast("string").alias("source_id"), lo.alias("lo"), (lo + F.col("o_orderkey") % 9).alias("hi"))


@query("merge_ranges", f"WITH {RANGES_SQL} SELECT * FROM merged")
def merge_ranges(t: Tables):
    return intervals.merge_ranges(order_ranges(t))


@query("tombstone_cover", f"""WITH {RANGES_SQL}, gaps AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey * 13 % 1500 AS VARCHAR) AS source_id, l_partkey % 200 AS lo, l_partkey % 200 + l_linenumber % 4 AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, g.source_id, g.lo, g.hi, EXISTS (SELECT 1 FROM merged m WHERE m.source_id = g.source_id AND m.lo <= g.lo AND g.hi <= m.hi) AS covered FROM gaps g""")
def tombstone_cover(t: Tables):
    lo = F.col("l_partkey") % 200
    gaps = t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") * 13 % 1500).cast("string").alias("source_id"), lo.alias("lo"), (lo + F.col("l_linenumber") % 4).alias("hi"))
    return intervals.covered(gaps, "lo", "hi", intervals.merge_ranges(order_ranges(t)))


ACCEPTED_SQL = """accepted AS (SELECT source_id, root FROM segs WHERE (CAST(source_id AS BIGINT) + segment) % 5 <> 0),
flagged AS (SELECT a.source_id, a.segment_id, a.seq_first, a.seq_last, c.root IS NOT NULL AS retained FROM after a LEFT JOIN accepted c ON c.source_id = a.source_id AND c.root = a.root WHERE a.deleted_at IS NOT NULL)"""


def flagged_tombstones(t: Tables) -> DataFrame:
    after = expired_segments(t)
    accepted = user_segments(t).where((F.col("source_id").cast("bigint") + F.col("segment")) % 5 != 0)
    return ret.flag_retained_roots(ret.tombstones(after), accepted)


@query("retention_roots", f"WITH {SEGMENTS_SQL}, {HOLDS_SQL}, {HELD_SQL}, {EXPIRED_SQL}, {ACCEPTED_SQL} SELECT *, 'seq ' || seq_first || '-' || seq_last AS expired_range FROM flagged")
def retention_roots(t: Tables):
    flagged = flagged_tombstones(t)
    ranges = ret.expired_ranges(flagged)
    return flagged.select("source_id", "segment_id", "seq_first", "seq_last", "retained").join(ranges, ["source_id", "seq_first"])


@query("retention_summary", f"""WITH {SEGMENTS_SQL}, {HOLDS_SQL}, {HELD_SQL}, {EXPIRED_SQL}, {ACCEPTED_SQL}
SELECT source_id, count(*) AS expired_segments, min(seq_first) AS expired_from, max(seq_last) AS expired_to, bool_and(retained) AS roots_retained FROM flagged GROUP BY source_id""")
def retention_summary(t: Tables):
    return ret.retention_summary(flagged_tombstones(t))
