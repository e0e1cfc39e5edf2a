"""The driver tables seen as event logs, each with the same view in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.base import Tables

DAY_US = 86_400_000_000
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINE_SQL = """line_log AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS source_id, CAST(l_linenumber AS BIGINT) AS seq, epoch_us(l_shipdate) AS time_us,
         l_returnflag || l_linestatus AS type, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem)"""

USER_SQL = """user_log AS (
  SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS seq, event_id AS ordinal, epoch_us(ts) AS time_us,
         event_type AS type, event_type = 'view' AS heartbeat
  FROM events)"""

# Captured form of the users' events: event types take the vocabulary of captured records, some purchases
# become key revocations, and heartbeats carry a health payload.
EVENT_NAMES = {
    "view": "system.heartbeat",
    "error": "system.network_outage",
    "signup": "system.replay_completed",
    "purchase": "system.agent_stopped",
    "click": "app.click",
}
REVOKING_K = 95
CAPTURED_SQL = """raw_captured AS (
  SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS ordinal, event_id AS seq, epoch_us(ts) * 1000 AS time_ns,
         event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props
  FROM events),
captured AS (
  SELECT source_id, ordinal, seq, time_ns, k,
         CASE WHEN name = 'purchase' AND k >= 95 THEN 'system.key_revoked' WHEN name = 'view' THEN 'system.heartbeat'
              WHEN name = 'error' THEN 'system.network_outage' WHEN name = 'signup' THEN 'system.replay_completed'
              WHEN name = 'purchase' THEN 'system.agent_stopped' ELSE 'app.click' END AS event_type,
         CASE WHEN name = 'view' THEN '{"agent":{"version":"1","uptime_seconds":' || ordinal || '},"continuity":{"last_local_seq":' || seq
                || ',"queue_depth":' || k || '},"health":{"disk_free_bytes":' || k * 1000 || ',"clock_drift_ms":' || (k * 40 - 1500) || '}}'
              WHEN name = 'purchase' AND k = 95 THEN '{"revoked_key_id":"id' || k || '","revoked_key_name":"signer","reason":"lost laptop","suspected_since":"2024-01-01T00:00:00Z"}'
              WHEN name = 'purchase' AND k = 96 THEN '{"revoked_key_name":"signer-g2","reason":"rotation"}'
              WHEN name = 'purchase' AND k = 97 THEN '{"revoked_key_id":"id97"}'
              ELSE props END AS payload_clear
  FROM raw_captured)"""

WHOLE_SQL = """whole_log AS (
  SELECT 'events' AS source_id, event_id AS ordinal, event_id + 1 AS seq, epoch_us(ts) * 1000 AS time_ns, event_type,
         '{"v":2,"source_id":"events","seq":' || (event_id + 1) || ',"event_type":"' || event_type || '","event_time":"'
         || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z","actor":"u' || user_id || '","payload_clear":' || props || '}' AS record
  FROM events)"""


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def line_log(t: Tables) -> DataFrame:
    return t.read("lineitem").select(
        F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_linenumber").cast("bigint").alias("seq"),
        micros("l_shipdate").alias("time_us"), F.concat("l_returnflag", "l_linestatus").alias("type"),
        F.lit(False).alias("heartbeat"), *LINE_ORDER)


def user_log(t: Tables) -> DataFrame:
    return t.read("events").select(
        F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("seq"),
        F.col("event_id").alias("ordinal"), micros("ts").alias("time_us"), F.col("event_type").alias("type"),
        (F.col("event_type") == "view").alias("heartbeat"))


def captured(t: Tables) -> DataFrame:
    name, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    revokes = (name == "purchase") & (k >= REVOKING_K)
    mapped = F.coalesce(F.when(revokes, F.lit("system.key_revoked")),
                        *[F.when(name == old, F.lit(new)) for old, new in EVENT_NAMES.items()])
    number = F.col("event_id").cast("string")
    health = F.concat(
        F.lit('{"agent":{"version":"1","uptime_seconds":'), number, F.lit('},"continuity":{"last_local_seq":'), number,
        F.lit(',"queue_depth":'), k.cast("string"), F.lit('},"health":{"disk_free_bytes":'), (k * 1000).cast("string"),
        F.lit(',"clock_drift_ms":'), (k * 40 - 1500).cast("string"), F.lit("}}"))
    payload = (
        F.when(name == "view", health)
        .when(revokes & (k == 95), F.lit('{"revoked_key_id":"id95","revoked_key_name":"signer","reason":"lost laptop",'
                                         '"suspected_since":"2024-01-01T00:00:00Z"}'))
        .when(revokes & (k == 96), F.lit('{"revoked_key_name":"signer-g2","reason":"rotation"}'))
        .when(revokes & (k == 97), F.lit('{"revoked_key_id":"id97"}'))
        .otherwise(F.col("props")))
    return t.read("events").select(
        F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("ordinal"),
        F.col("event_id").alias("seq"), (micros("ts") * 1000).alias("time_ns"), k.alias("k"),
        mapped.alias("event_type"), payload.alias("payload_clear"))


# The same events as chained records: contiguous seq per user, record text up to the prev_hash value.
BODY_SQL = CAPTURED_SQL + """,
bodies AS (
  SELECT source_id, rn AS seq, '{"v":2,"source_id":"' || source_id || '","seq":' || rn || ',"event_type":"' || event_type
    || '","event_time":"' || stamp || '","ingest_time":"' || stamp || '","actor":"","outcome":"","payload_clear":' || payload_clear
    || CASE WHEN k > 90 THEN ',"key_id":"key-' || k || '"' ELSE '' END || ',"prev_hash":"' AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS rn,
        strftime(make_timestamp(time_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS stamp FROM captured)),
frames AS (
  SELECT source_id, seq, body || repeat('0', 64) || '"}' AS record, sha256(body || repeat('0', 64) || '"}') AS claimed_hash
  FROM bodies WHERE seq = 1
  UNION ALL
  SELECT b.source_id, b.seq, b.body || f.claimed_hash || '"}', sha256(b.body || f.claimed_hash || '"}')
  FROM frames f JOIN bodies b ON b.source_id = f.source_id AND b.seq = f.seq + 1)"""
# Four kinds of damage, by user: changed bytes, dropped record, rewritten record, cut-off record.
TAMPER_SQL = BODY_SQL + """,
tampered AS (
  SELECT source_id, seq AS ordinal, record,
    CASE WHEN damaged THEN sha256(record) ELSE claimed_hash END AS claimed_hash FROM (
    SELECT source_id, seq, claimed_hash, CAST(source_id AS BIGINT) % 7 IN (5, 6) AS damaged,
      CASE WHEN CAST(source_id AS BIGINT) % 7 = 3 AND seq = 5 THEN replace(record, '"v":2', '"v":3')
           WHEN CAST(source_id AS BIGINT) % 7 = 5 AND seq = 8 THEN substr(record, 1, length(record) - 66) || repeat('a', 64) || '"}'
           WHEN CAST(source_id AS BIGINT) % 7 = 6 AND seq = 4 THEN substr(record, 1, 40) ELSE record END AS record
    FROM frames WHERE NOT (CAST(source_id AS BIGINT) % 7 = 4 AND seq = 6)))"""


def bodies(t: Tables) -> DataFrame:
    from tidemark.functions.times import format_pinned
    from tidemark.operators.chain import assign_sequence

    numbered = assign_sequence(captured(t).drop("seq"), "ordinal")
    stamp = format_pinned(F.col("time_ns"))
    body = F.concat(
        F.lit('{"v":2,"source_id":"'), "source_id", F.lit('","seq":'), F.col("seq").cast("string"),
        F.lit(',"event_type":"'), "event_type", F.lit('","event_time":"'), stamp, F.lit('","ingest_time":"'), stamp,
        F.lit('","actor":"","outcome":"","payload_clear":'), "payload_clear",
        F.when(F.col("k") > 90, F.concat(F.lit(',"key_id":"key-'), F.col("k").cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.lit(',"prev_hash":"'))
    return numbered.select("source_id", "seq", body.alias("body"))


def frames(t: Tables) -> DataFrame:
    from tidemark.operators.chain import build_chain

    return build_chain(bodies(t))


def stored_frames(t: Tables) -> DataFrame:
    """The chained frames as a written table, for queries that read them more than once."""
    from tidemark.sources.store import materialise

    return materialise(frames(t), "frames")


def tampered(t: Tables, chained: DataFrame | None = None) -> DataFrame:
    user = F.col("source_id").cast("bigint") % 7
    text = F.col("record_bytes").cast("string")
    kept = (frames(t) if chained is None else chained).where(~((user == 4) & (F.col("seq") == 6)))
    changed = (
        F.when((user == 3) & (F.col("seq") == 5), F.replace(text, F.lit('"v":2'), F.lit('"v":3')))
        .when((user == 5) & (F.col("seq") == 8), F.concat(
            F.substring(text, F.lit(1), F.length(text) - 66), F.lit("a" * 64 + '"}')))
        .when((user == 6) & (F.col("seq") == 4), F.substring(text, 1, 40)).otherwise(text))
    damaged = kept.withColumn("record_bytes", F.encode(changed, "UTF-8"))
    claimed = F.when(user.isin(5, 6), F.sha2("record_bytes", 256)).otherwise(F.col("claimed_hash"))
    return damaged.select("source_id", F.col("seq").alias("ordinal"), "record_bytes", claimed.alias("claimed_hash"))


def whole_log(t: Tables) -> DataFrame:
    seq = F.col("event_id") + 1
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = F.concat(
        F.lit('{"v":2,"source_id":"events","seq":'), seq.cast("string"), F.lit(',"event_type":"'), "event_type",
        F.lit('","event_time":"'), stamp, F.lit('000Z","actor":"u'), F.col("user_id").cast("string"),
        F.lit('","payload_clear":'), "props", F.lit("}"))
    return t.read("events").select(
        # A column, not a constant: as a constant it would be folded out of the join keys.
        F.when(F.col("event_id").isNotNull(), F.lit("events")).alias("source_id"), F.col("event_id").alias("ordinal"), seq.alias("seq"),
        (micros("ts") * 1000).alias("time_ns"), "event_type", F.encode(record, "UTF-8").alias("record_bytes"))


# SQL text of the formats the operators print.
def sql_span(us: str) -> str:
    s = f"(({us} + 500000) // 1000000)"
    two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
    return (f"CASE WHEN {us} <= 0 THEN '0s' WHEN {s} < 60 THEN {s} || 's' "
            f"WHEN {s} < 3600 THEN ({s} // 60) || 'm' || {two(f'{s} % 60')} || 's' "
            f"WHEN {s} < 86400 THEN ({s} // 3600) || 'h' || {two(f'{s} % 3600 // 60')} || 'm' "
            f"ELSE ({s} // 86400) || 'd' || {two(f'{s} % 86400 // 3600')} || 'h' END")


def sql_duration(ns: str) -> str:
    s = f"(({ns} + 500000000) // 1000000000)"
    return (f"(CASE WHEN {s} >= 3600 THEN ({s} // 3600) || 'h' ELSE '' END || "
            f"CASE WHEN {s} >= 60 THEN ({s} % 3600 // 60) || 'm' ELSE '' END || ({s} % 60) || 's')")


def sql_minutes(ns: str) -> str:
    s = f"(({ns} + 500000000) // 1000000000)"
    return (f"CASE WHEN {ns} = 0 THEN '—' WHEN {s} < 60 THEN {s} || 's' "
            f"ELSE ({s} // 60) || 'm' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') || 's' END")


def sql_pinned(ns: str) -> str:
    return f"(strftime(make_timestamp({ns} // 1000), '%Y-%m-%dT%H:%M:%S.%f') || lpad(CAST({ns} % 1000 AS VARCHAR), 3, '0') || 'Z')"
