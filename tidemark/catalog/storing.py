"""Queries over tables that are added to and merged: segment intake with receipts, accepted heads, minted salts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.base import Tables, query
from tidemark.catalog.lifecycle import PER_SEGMENT, SEGMENTS_SQL, user_records, user_segments
from tidemark.catalog.verifying import JUDGED_SQL, SUBMITTED_SQL, submitted
from tidemark.functions.hashing import base64_text, hex_lower, sha_hex
from tidemark.operators.pseudonyms import with_pseudonyms
from tidemark.operators.segments import segment_number
from tidemark.plans import ingest as intake
from tidemark.plans.states import Heads, Salts
from tidemark.session import scratch_path
from tidemark.sources.ledger import Ledger
from tidemark.sources.store import materialise

SHARED_ID = "018d0000-0000-7000-8000-000000000000"
KINDS = 24


def segment_deliveries(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deliveries with one fault each by their kind, their frames, and the segments that are stored already.

    Kinds 0 to 6 break the segment row, 7 to 13 its frames, 14 comes twice, 15 shares its id, 16 is stored, 17 comes broken
    and then whole, 18 has a frame too many.
    """
    seg = user_segments(t)
    user = F.col("source_id").cast("bigint")
    kind = F.pmod(user * 7 + F.col("segment"), F.lit(KINDS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.when(kind.isin(14, 17), 1).otherwise(0)))
    rows = seg.withColumn("m", kind).withColumn("copy", copies).withColumns({
        "k": F.when((F.col("m") == 17) & (F.col("copy") == 0), 9).otherwise(F.col("m")),
        "delivery": user * 2_000_000 + F.col("segment") * 2 + F.col("copy")})
    k = F.col("k")
    note = F.concat(F.lit("log/"), "source_id", F.lit("\n"), (F.col("seq_last") + F.when(k == 5, 1).otherwise(0)).cast("string"), F.lit("\n"), base64_text(F.col("root")),
                    F.when(k == 4, F.lit("\n")).otherwise(F.lit("\n\n")), F.lit("— signer AAAA\n"))
    sent = rows.select(
        "delivery", F.when(k == 0, F.lit("../escape")).when(k == 15, F.lit(SHARED_ID)).otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(k == 1, F.lit("")).otherwise(F.col("source_id")).alias("source_id"), F.when(k == 2, F.col("seq_last") + 1).otherwise(F.col("seq_first")).alias("seq_first"),
        "seq_last", F.when(k == 3, F.substring("root", 1, 31)).when(k == 6, F.unhex(F.reverse(F.hex("root")))).otherwise(F.col("root")).alias("root"), note.alias("checkpoint"))
    records = user_records(t).withColumn("segment", segment_number(F.col("seq"), PER_SEGMENT))
    at = F.col("seq") - F.col("seq_first")
    held = records.join(rows.select("source_id", "segment", "k", "delivery", "seq_first", "seq_last"), ["source_id", "segment"]).withColumn("position", at)
    extra = held.where((k == 18) & (F.col("seq") == F.col("seq_last"))).withColumns({"seq": F.col("seq") + 1, "position": F.col("position") + 1})
    held = held.unionByName(extra)
    first = F.col("position") == 0
    record = F.concat(F.lit('{"v":2,"source_id":"'), F.when(first & (k == 11), F.lit("other")).otherwise(F.col("source_id")), F.lit('","seq":'), F.col("seq").cast("string"),
                      F.lit(',"event_type":"'), "event_type", F.lit('","payload_clear":'), "props", F.lit("}"))
    raw = F.encode(F.when(first & (k == 8), F.lit("")).when(first & (k == 10), F.substring(record, 1, 20)).otherwise(record), "UTF-8")
    frames = held.where(~((k == 12) & first) & ~((k == 13) & (F.col("seq") == F.col("seq_last")))).withColumn("record_bytes", raw)
    claimed = F.when(first & (k == 7), F.substring(sha_hex(F.col("record_bytes")), 1, 62)).when(first & (k == 9), F.lit("0" * 64)).otherwise(sha_hex(F.col("record_bytes")))
    frames = frames.select("delivery", (F.col("position") - F.when(k == 12, 1).otherwise(0)).alias("position"), "record_bytes", claimed.alias("claimed_hash"))
    stored = rows.where("m = 16").select("segment_id", "source_id", "seq_first", "seq_last", "root", note.alias("checkpoint"))
    return materialise(sent, "deliveries"), materialise(frames, "delivered-frames"), stored


DELIVERIES_SQL = f"""{SEGMENTS_SQL},
sent AS (SELECT *, CASE WHEN m = 17 AND copy = 0 THEN 9 ELSE m END AS k, CAST(source_id AS BIGINT) * 2000000 + segment * 2 + copy AS delivery, seq_last - seq_first + 1 AS n
  FROM (SELECT *, (CAST(source_id AS BIGINT) * 7 + segment) % {KINDS} AS m FROM segs), (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR m IN (14, 17)),
judged AS (SELECT *, CASE k WHEN 0 THEN 'bad_segment_id' WHEN 1 THEN 'missing_source_id' WHEN 2 THEN 'bad_range' WHEN 3 THEN 'bad_root_length' WHEN 4 THEN 'malformed_checkpoint'
  WHEN 5 THEN 'size_mismatch' WHEN 6 THEN 'root_mismatch' WHEN 7 THEN 'digest_length' WHEN 8 THEN 'frame_length' WHEN 9 THEN 'hash_mismatch' WHEN 10 THEN 'bad_record' WHEN 11 THEN 'other_source'
  WHEN 12 THEN CASE WHEN n = 1 THEN 'short_range' ELSE 'out_of_order' END WHEN 13 THEN 'short_range' WHEN 14 THEN CASE copy WHEN 0 THEN 'accepted' ELSE 'duplicate' END
  WHEN 16 THEN 'duplicate' WHEN 18 THEN CASE WHEN n = {PER_SEGMENT} THEN 'too_many_frames' ELSE 'short_range' END ELSE 'accepted' END AS status FROM sent)"""


@query("ingest_segments", f"""WITH {DELIVERIES_SQL}, final AS (SELECT delivery, seq_last, CASE WHEN k = 15 AND row_number() OVER (PARTITION BY k ORDER BY delivery) > 1 THEN 'id_taken' ELSE status END AS status FROM judged)
SELECT delivery, status, CASE WHEN status IN ('accepted', 'duplicate') THEN seq_last END AS acked_seq FROM final""")
def ingest_segments(t: Tables):
    """The receipts of one intake run over all deliveries."""
    sent, frames, stored = segment_deliveries(t)
    ledger = Ledger(t.spark, scratch_path(t.spark, "ledger"))
    ledger.append({"segments": stored}, "seed", 0)
    return intake.ingest(ledger, sent, frames, "intake", 1, max_frames=PER_SEGMENT).select("delivery", "status", "acked_seq")


@query("ingest_stored", f"""WITH {DELIVERIES_SQL}, final AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST(source_id AS BIGINT) % 2, delivery) AS turn FROM judged)
SELECT CASE WHEN k = 15 THEN '{SHARED_ID}' ELSE segment_id END AS segment_id, source_id, seq_first, seq_last, CASE WHEN k <> 16 THEN n END AS frames FROM final
WHERE status = 'accepted' AND (k <> 15 OR turn = 1) OR k = 16""")
def ingest_stored(t: Tables):
    """What is stored after a batch, the same batch again, and a batch that brings everything once more."""
    sent, frames, stored = segment_deliveries(t)
    ledger = Ledger(t.spark, scratch_path(t.spark, "ledger"))
    ledger.append({"segments": stored}, "seed", 0)
    even = F.col("delivery") % 4_000_000 < 2_000_000
    for batch, rows in ((1, sent.where(even)), (1, sent.where(even)), (2, sent)):
        intake.ingest(ledger, rows, frames.join(rows.select("delivery"), "delivery", "left_semi"), "intake", batch, max_frames=PER_SEGMENT)
    held = ledger.read("frames", intake.FRAME_ROWS).groupBy("segment_id").agg(F.count("*").alias("frames"))
    return ledger.read("segments", intake.SEGMENT_ROWS).join(held, "segment_id", "left").select("segment_id", "source_id", "seq_first", "seq_last", "frames")


def submitted_in_runs(t: Tables) -> tuple[Heads, list[DataFrame]]:
    """Three runs over the submissions in receipt order, the second one repeated; the verdicts of each."""
    rows = submitted(t)
    last = rows.agg(F.max("pos")).first()[0]
    heads = Heads(t.spark, scratch_path(t.spark, "heads"))
    run = F.call_function("div", F.col("pos") * 3, F.lit(last + 1).cast("bigint"))
    return heads, [heads.accept(rows.where(run == batch), "heads", batch) for batch in (0, 1, 1, 2)]


@query("accepted_heads", f"""WITH {SUBMITTED_SQL}, {JUDGED_SQL}
SELECT origin, max(size) AS size, min_by(root, pos) FILTER (size = top) AS root FROM (SELECT *, max(size) OVER (PARTITION BY origin) AS top FROM judged WHERE status = 'accepted') GROUP BY origin""")
def accepted_heads(t: Tables):
    heads, _ = submitted_in_runs(t)
    return heads.current().select("origin", "size", hex_lower(F.col("root")).alias("root"))


@query("heads_verdicts", f"WITH {SUBMITTED_SQL}, {JUDGED_SQL} SELECT origin, pos, size, root, status FROM judged")
def heads_verdicts(t: Tables):
    _, (first, second, _, third) = submitted_in_runs(t)
    return first.unionByName(second).unionByName(third).withColumn("root", hex_lower(F.col("root")))


@query("salts_minted", """SELECT 'u' || user_id AS actor, 1::BIGINT AS salts, 32 AS salt_bytes, true AS kept, true AS derives FROM (SELECT DISTINCT user_id FROM events)""")
def salts_minted(t: Tables):
    """Two runs over overlapping events: one salt per actor, the first one, from which the stored pseudonym follows."""
    events = t.read("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), "user_id")
    salts = Salts(t.spark, scratch_path(t.spark, "salts"))
    early = salts.mint(events.where("user_id % 3 <> 0"), "2024-01-01T00:00:00.000000000Z", "salts", 1).select("actor", F.col("salt").alias("first"))
    late = salts.mint(events, "2024-01-02T00:00:00.000000000Z", "salts", 2)
    again = with_pseudonyms(late.select("actor", "salt")).select("actor", F.col("pseudonym").alias("derived"))
    return late.join(early, "actor", "left").join(again, "actor").groupBy("actor").agg(
        F.count("*").alias("salts"), F.max(F.octet_length("salt")).alias("salt_bytes"), F.bool_and(F.coalesce(F.col("first") == F.col("salt"), F.lit(True))).alias("kept"),
        F.bool_and(F.col("derived") == F.col("pseudonym")).alias("derives"))
