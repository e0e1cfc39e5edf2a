"""Streaming queries: each runs its stream over files written from the driver tables, in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.base import Tables, query
from tidemark.catalog.chaining import CHECK_SQL
from tidemark.catalog.lifecycle import DAY_NS, SEGMENTS_SQL, deliveries
from tidemark.catalog.logs import BODY_SQL, CAPTURED_SQL, DAY_US, captured, tampered
from tidemark.catalog.verifying import JUDGED_SQL, SUBMITTED_SQL, submitted
from tidemark.functions.hashing import hex_lower
from tidemark.functions.times import format_pinned
from tidemark.operators.captured import HEARTBEAT
from tidemark.operators.chain import assign_sequence, build_chain
from tidemark.operators.ordered import stitched_row_number
from tidemark.session import scratch_path
from tidemark.sources.store import materialise
from tidemark.streaming import live
from tidemark.streaming.run import run_available, stream_table


def as_stream(t: Tables, df: DataFrame, label: str, order: str, files: int = 6, per_trigger: int = 2) -> DataFrame:
    """Writes df in several files that follow ``order`` and opens them as a stream."""
    path = scratch_path(t.spark, label)
    df.repartitionByRange(files, order).write.parquet(path)
    return stream_table(t.spark, path, per_trigger)


def as_received(t: Tables, df: DataFrame, label: str, order: str, deliveries: int = 3) -> DataFrame:
    """Writes df in deliveries that follow one another, so that files arrive in receipt order."""
    path = scratch_path(t.spark, label)
    low, high = df.agg(F.min(order), F.max(order)).first()
    share = F.call_function("div", (F.col(order) - low) * deliveries, F.lit(high - low + 1))
    for number in range(deliveries):
        df.where(share == number).repartitionByRange(2, order).write.mode("append").parquet(path)
    return stream_table(t.spark, path, 2)


@query("stream_chain", f"""WITH RECURSIVE {CHECK_SQL}, n AS (SELECT source_id, count(*) AS records FROM checked GROUP BY source_id)
SELECT source_id, records, chain_valid, kind, message FROM verdicts JOIN n USING (source_id)""")
def stream_chain(t: Tables):
    numbered = stitched_row_number(tampered(t), ["source_id"], "ordinal", "n").drop("ordinal").withColumnRenamed("n", "ordinal")
    written = run_available(live.live_chain(as_stream(t, numbered, "frames", "ordinal")), "chain")
    last = F.max_by(F.struct("chain_valid", "kind", "message"), "records")
    return (written.groupBy("source_id").agg(F.max("records").alias("records"), last.alias("v"))
            .select("source_id", "records", "v.chain_valid", "v.kind", "v.message"))


@query("stream_seal", f"""WITH RECURSIVE {BODY_SQL},
cuts AS (SELECT source_id, 1::BIGINT AS seq, 0 AS segment, t0 AS opened FROM (SELECT source_id, min(time_ns) AS t0 FROM captured GROUP BY source_id)
  UNION ALL SELECT n.source_id, n.seq, n.segment, n.time_ns FROM (
    SELECT r.source_id, r.rn AS seq, r.time_ns, c.segment + 1 AS segment, row_number() OVER (PARTITION BY r.source_id ORDER BY r.rn) AS first
    FROM cuts c JOIN (SELECT source_id, time_ns, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS rn FROM captured) r
    ON r.source_id = c.source_id AND r.rn > c.seq AND (r.rn >= c.seq + 5 OR r.time_ns >= c.opened + {DAY_NS})) n WHERE first = 1)
SELECT f.source_id, f.seq, CAST(max(c.segment) AS BIGINT) AS segment, f.claimed_hash AS record_hash FROM frames f JOIN cuts c ON c.source_id = f.source_id AND c.seq <= f.seq
GROUP BY f.source_id, f.seq, f.claimed_hash""")
def stream_seal(t: Tables):
    written = run_available(live.live_intake(as_stream(t, arrivals(t), "intake", "ordinal"), 5, DAY_NS), "seal")
    return written.select("source_id", "seq", "segment", "record_hash")


def arrivals(t: Tables) -> DataFrame:
    """Events as they come in: source_id, ordinal (from 0), time_ns, and the record's text before and after its number."""
    numbered = assign_sequence(captured(t).drop("seq"), "ordinal").withColumn("arrival", F.col("seq") - 1)
    stamp = format_pinned(F.col("time_ns"))
    head = F.concat(F.lit('{"v":2,"source_id":"'), "source_id", F.lit('","seq":'))
    tail = F.concat(
        F.lit(',"event_type":"'), "event_type", F.lit('","event_time":"'), stamp, F.lit('","ingest_time":"'), stamp,
        F.lit('","actor":"","outcome":"","payload_clear":'), "payload_clear",
        F.when(F.col("k") > 90, F.concat(F.lit(',"key_id":"key-'), F.col("k").cast("string"), F.lit('"'))).otherwise(F.lit("")), F.lit(',"prev_hash":"'))
    return numbered.select("source_id", F.col("arrival").alias("ordinal"), "time_ns", head.alias("body_head"), tail.alias("body_tail"))


@query("stream_forks", f"WITH {SUBMITTED_SQL}, {JUDGED_SQL} SELECT origin, pos, size, root, status FROM judged")
def stream_forks(t: Tables):
    rows = submitted(t).withColumn("root", hex_lower(F.col("root")))
    return run_available(live.live_forks(as_received(t, rows, "submitted", "pos")), "forks")


@query("stream_heads", f"WITH {SUBMITTED_SQL} SELECT origin, max(size) AS size FROM submitted GROUP BY origin")
def stream_heads(t: Tables):
    rows = submitted(t).withColumn("root", hex_lower(F.col("root")))
    written = run_available(live.live_heads(as_stream(t, rows, "heads", "pos")), "heads")
    return written.groupBy("origin").agg(F.max("size").alias("size"))


@query("stream_outage", f"""WITH {CAPTURED_SQL}, kept AS (SELECT *, lag(event_type) OVER w AS ptype, lag(seq) OVER w AS pseq, lag(time_ns) OVER w AS ptime
  FROM captured WHERE event_type IN ('system.network_outage', 'system.replay_completed') WINDOW w AS (PARTITION BY source_id ORDER BY ordinal))
SELECT source_id, pseq AS outage_seq, seq AS replay_seq, greatest(seq - pseq - 1, 0) AS buffered, time_ns - ptime AS outage_ns
FROM kept WHERE event_type = 'system.replay_completed' AND ptype = 'system.network_outage'""")
def stream_outage(t: Tables):
    rows = stitched_row_number(captured(t), ["source_id"], "ordinal", "n").drop("ordinal").withColumnRenamed("n", "ordinal")
    return run_available(live.live_outages(as_stream(t, rows, "records", "ordinal")), "outage").drop("lost_from", "lost_to")


@query("stream_dedup", f"WITH {SEGMENTS_SQL} SELECT source_id, seq_first, seq_last, root FROM segs")
def stream_dedup(t: Tables):
    delivered = deliveries(t)[0].withColumn("root", hex_lower(F.col("root"))).select("source_id", "seq_first", "seq_last", "root", "delivery")
    return run_available(live.live_dedup(as_stream(t, delivered, "deliveries", "delivery")).drop("delivery"), "dedup")


def beats_in_time(t: Tables) -> DataFrame:
    """Heartbeats (source_id, at, at_us) as a stream that follows their time."""
    at = F.call_function("div", F.col("time_ns"), F.lit(1000).cast("bigint"))
    beats = captured(t).where(F.col("event_type") == HEARTBEAT).select("source_id", F.timestamp_micros(at).alias("at"), at.alias("at_us"))
    return as_received(t, materialise(beats, "beats"), "beats-in-time", "at_us")


# Final is what lies before the last watermark; the last silence of a source is open if the limit had passed by then.
LATENESS_MS = 6 * 3_600_000


@query("stream_silence", f"""WITH {CAPTURED_SQL}, beats AS (SELECT DISTINCT source_id, time_ns // 1000 AS tm FROM captured WHERE event_type = 'system.heartbeat'),
mark AS (SELECT (max(tm) // 1000 - {LATENESS_MS}) * 1000 AS w FROM beats),
spans AS (SELECT source_id, tm AS start_us, lead(tm) OVER (PARTITION BY source_id ORDER BY tm) AS end_us, w FROM beats, mark WHERE tm <= w)
SELECT source_id, start_us, end_us FROM spans WHERE end_us - start_us > {DAY_US} OR (end_us IS NULL AND w - start_us > {DAY_US})""")
def stream_silence(t: Tables):
    return live.last_told(run_available(live.live_silences(beats_in_time(t), DAY_US, f"{LATENESS_MS} milliseconds"), "silence"))


@query("stream_sessions", f"""WITH {CAPTURED_SQL}, beats AS (SELECT source_id, time_ns // 1000 AS tm, lag(time_ns // 1000) OVER (PARTITION BY source_id ORDER BY time_ns) AS before
  FROM captured WHERE event_type = 'system.heartbeat'),
mark AS (SELECT (max(tm) // 1000 - {LATENESS_MS}) * 1000 AS w FROM beats),
runs AS (SELECT source_id, tm, sum(CASE WHEN tm - before < {DAY_US} THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY tm) AS run FROM beats),
closed AS (SELECT source_id, run, min(tm) AS first_us, max(tm) AS last_us FROM runs GROUP BY source_id, run)
SELECT source_id, first_us, last_us FROM closed, mark WHERE last_us + {DAY_US} <= w""")
def stream_sessions(t: Tables):
    return run_available(live.live_sessions(beats_in_time(t), "1 day", "6 hours"), "sessions")


@query("stream_resume", f"WITH RECURSIVE {BODY_SQL} SELECT source_id, seq, claimed_hash AS record_hash FROM frames")
def stream_resume(t: Tables):
    """Two fifths of each source are stored; a new stream goes on from their heads, and is stopped and restarted on the way."""
    rows = arrivals(t)
    sizes = rows.groupBy("source_id").agg(F.call_function("div", F.max("ordinal") * 2, F.lit(5)).alias("cut"))
    rows = materialise(rows.join(sizes, "source_id"), "arrivals")
    body = F.concat("body_head", (F.col("ordinal") + 1).cast("string"), "body_tail")
    stored = materialise(build_chain(rows.where("ordinal <= cut").select("source_id", (F.col("ordinal") + 1).alias("seq"), body.alias("body"))), "stored")
    stored = stored.withColumnRenamed("claimed_hash", "record_hash")
    heads = materialise(live.stored_heads(stored, stored.groupBy("source_id").agg(F.lit(0).alias("segments"))), "heads")
    rest = rows.where("ordinal > cut").withColumn("ordinal", F.col("ordinal") - F.col("cut") - 1)
    inbox, home = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "resume")
    for half in (0, 1):
        rest.where((F.col("ordinal") % 7 < 4) == (half == 0)).drop("cut").repartitionByRange(2, "ordinal").write.mode("append").parquet(inbox)
        written = run_available(live.live_intake(stream_table(t.spark, inbox, 2), 5, DAY_NS, heads=heads), "resume", target=f"{home}/out", checkpoint=f"{home}/checkpoint")
    return stored.select("source_id", "seq", "record_hash").unionByName(written.where("seq is not null").select("source_id", "seq", "record_hash"))
