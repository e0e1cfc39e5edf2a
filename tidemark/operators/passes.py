"""One pass over captured records: everything that needs a neighbour or a running state, for all checks together.

A source is cut into blocks along its order of arrival. One window per block gives each row what it needs from the rows
before it in the block: the number and hash of the record before, how many rows and heartbeats came before, and the outage
or replay before. A block is then one summary row, and summaries join associatively: laid side by side they give each block
what the blocks before it leave behind (its seam), and added up they give the facts of a source. Checks read the rows they
are about and one seam each; no check sorts or shuffles the records again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import leaf_hash
from tidemark.functions.times import parse_pinned_ns
from tidemark.operators import captured as cap
from tidemark.operators.chain import link_kinds, parsed_frames
from tidemark.operators.ordered import BLOCK, BLOCK_WIDTH, block_of
from tidemark.sources.store import materialise

_SIDES = [cap.OUTAGE, cap.REPLAY]


@dataclass(frozen=True)
class Pass:
    rows: DataFrame  # written, with in-block state
    seams: DataFrame  # written: per block, what the blocks before it leave
    sources: DataFrame  # per source: the sums of its blocks

    def met(self, rows: DataFrame) -> DataFrame:
        """Rows with their seam."""
        return rows.join(self.seams, ["source_id", BLOCK])


def stepped(frames: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Facts of each record with the state of its block before it. A claimed hash is kept where it differs from the record's."""
    parsed = parsed_frames(frames)
    r = F.col("record")
    kind = r["event_type"]
    # Payload text is kept for the two event types whose payload is read.
    payload = F.when(kind.isin(cap.HEARTBEAT, cap.KEY_REVOKED), r["payload_clear"])
    drift = F.when(kind == cap.HEARTBEAT, F.abs(F.from_json(r["payload_clear"], cap.HEARTBEAT_PAYLOAD)["health"]["clock_drift_ms"]))
    claimed = F.when(F.col("record_hash") != F.col("claimed_hash"), F.col("claimed_hash"))
    facts = parsed.select(
        "source_id", "ordinal", block_of(F.col("ordinal"), width).alias(BLOCK), claimed.alias("claimed_hash"), "record_hash", "parse_error", r["seq"].alias("seq"),
        kind.alias("event_type"), parse_pinned_ns(r["event_time"]).alias("time_ns"), r["prev_hash"].alias("prev_hash"), r["key_id"].alias("key_id"),
        (F.coalesce(r["payload_ct"], F.lit("")) != "").alias("sealed"), payload.alias("payload_clear"), drift.alias("drift_ms"),
        leaf_hash(F.col("record_bytes")).alias("leaf"))
    facts = facts.withColumns({
        "beat": (F.col("event_type") == cap.HEARTBEAT) & F.col("time_ns").isNotNull() & ~F.col("parse_error"),
        "side": F.when(F.col("event_type").isin(*_SIDES), F.struct("event_type", "seq", "time_ns"))})
    order = Window.partitionBy("source_id", BLOCK).orderBy("ordinal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = facts.repartition("source_id", BLOCK).withColumns({
        "in_block": F.row_number().over(order), "prev_seq": F.lag("seq").over(order), "prev_record_hash": F.lag("record_hash").over(order),
        "beats_before": F.coalesce(F.count_if("beat").over(before), F.lit(0)), "prev_side": F.last("side", ignorenulls=True).over(before),
        "_closes": F.lead("ordinal").over(order).isNull()})
    # Hash texts are most of a row. Only rows that look wrong in their block, or open it, are compared again; the last one is what
    # the next block goes on from.
    rows = rows.withColumn("suspect", (F.col("in_block") == 1) | F.col("claimed_hash").isNotNull() | F.col("parse_error")
                           | ~F.col("seq").eqNullSafe(F.col("prev_seq") + 1) | ~F.col("prev_hash").eqNullSafe(F.col("prev_record_hash")))
    return rows.withColumns({
        "record_hash": F.when(F.col("suspect") | F.col("_closes"), F.col("record_hash")),
        "prev_hash": F.when(F.col("suspect"), F.col("prev_hash")), "prev_record_hash": F.when(F.col("suspect"), F.col("prev_record_hash"))}).drop("_closes")


def one_pass(frames: DataFrame, width: int = BLOCK_WIDTH) -> Pass:
    rows = materialise(stepped(frames, width), "passed")
    at = F.col("ordinal")
    named = F.nullif("key_id", F.lit(""))
    known = ~F.col("parse_error")
    blocks = materialise(rows.groupBy("source_id", BLOCK).agg(
        F.count("*").alias("n"), F.count_if("beat").alias("beats"), F.max_by("seq", at).alias("tail_seq"), F.max_by("record_hash", at).alias("tail_hash"),
        F.max_by("side", F.when(F.col("side").isNotNull(), at)).alias("tail_side"), F.min(F.when(F.col("parse_error"), at)).alias("unparsed_at"),
        F.count_if(known).alias("records"), F.min_by("seq", at).alias("seq_first"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"),
        F.min(F.when(F.col("beat"), F.col("time_ns"))).alias("first_beat"), F.bool_or(F.coalesce("sealed", F.lit(False))).alias("encrypted"),
        F.min(F.when(named.isNotNull(), F.struct(at.alias("at"), named.alias("key_id")))).alias("key"), F.max("drift_ms").alias("drift_ms")), "blocks")
    across = Window.partitionBy("source_id").orderBy(BLOCK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    seams = materialise(blocks.select(
        "source_id", BLOCK, F.coalesce(F.sum("n").over(before), none).alias("rows_before"), F.coalesce(F.sum("beats").over(before), none).alias("seam_beats"),
        F.lag("tail_seq").over(across).alias("seam_seq"), F.lag("tail_hash").over(across).alias("seam_hash"), F.last("tail_side", ignorenulls=True).over(before).alias("seam_side")), "seams")
    sources = blocks.groupBy("source_id").agg(
        F.min("unparsed_at").alias("unparsed_at"), F.sum("records").alias("records"), F.min_by("seq_first", BLOCK).alias("seq_first"),
        F.max_by("tail_seq", BLOCK).alias("seq_last"), F.max_by("tail_hash", BLOCK).alias("chain_head"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"),
        F.sum("beats").alias("observed"), F.min("first_beat").alias("first_beat"), F.bool_or("encrypted").alias("encrypted"),
        F.coalesce(F.min("key")["key_id"], F.lit("")).alias("key_id"), F.coalesce(F.max("drift_ms"), none).alias("max_drift_ms"))
    return Pass(rows, seams, materialise(sources, "source-facts"))


def leaves(done: Pass) -> DataFrame:
    """source_id, idx (from 0, in order of arrival), leaf."""
    return done.met(done.rows.select("source_id", BLOCK, "in_block", "leaf")).select("source_id", (F.col("rows_before") + F.col("in_block") - 1).alias("idx"), "leaf")


def link_errors(done: Pass, covered: DataFrame | None = None) -> DataFrame:
    """As chain.link_errors: only rows that look wrong in their block, or open it, are looked at again with the seam."""
    opens = F.col("in_block") == 1
    suspects = done.rows.where("suspect").select("source_id", BLOCK, "ordinal", "in_block", "claimed_hash", "record_hash", "parse_error", "seq", "prev_hash",
                                                 "prev_seq", "prev_record_hash")
    met = done.met(suspects)
    return link_kinds(met.withColumns({"prev_seq": F.when(opens, F.col("seam_seq")).otherwise(F.col("prev_seq")),
                                       "prev_record_hash": F.when(opens, F.col("seam_hash")).otherwise(F.col("prev_record_hash"))}), covered)


def transport(done: Pass) -> DataFrame:
    """Per source with outage or replay rows: outages, longest, buffered, completed."""
    sides = done.rows.where(F.col("side").isNotNull()).select("source_id", BLOCK, "ordinal", "side", "prev_side")
    rows = done.met(sides).select("source_id", "ordinal", "side.*", F.coalesce("prev_side", "seam_side").alias("p"))
    pair = F.coalesce((F.col("event_type") == cap.REPLAY) & (F.col("p.event_type") == cap.OUTAGE), F.lit(False))
    none = F.lit(0).cast("bigint")
    return rows.groupBy("source_id").agg(
        F.count_if(F.col("event_type") == cap.OUTAGE).alias("outages"),
        F.coalesce(F.max(F.when(pair, F.greatest(F.col("time_ns") - F.col("p.time_ns"), none))), none).alias("longest_outage_ns"),
        F.coalesce(F.sum(F.when(pair, F.greatest(F.col("seq") - F.col("p.seq") - 1, none))), none).alias("buffered"),
        ((F.count_if(pair) > 0) & (F.max_by("event_type", "ordinal") != cap.OUTAGE)).alias("replay_completed"))


def clean_stops(done: Pass) -> DataFrame:
    """For each clean stop, how many heartbeats had arrived before it."""
    stops = done.rows.where(F.col("event_type") == cap.STOPPED).select("source_id", BLOCK, "beats_before")
    return done.met(stops).select("source_id", (F.col("seam_beats") + F.col("beats_before")).alias("before")).distinct()


def expected_beats(interval_ns: int) -> Column:
    if interval_ns <= 0:
        return F.lit(0).cast("bigint")
    window = F.call_function("div", F.col("last_ns") - F.col("first_beat"), F.lit(interval_ns).cast("bigint"))
    return F.when(F.col("observed") > 0, F.greatest(F.lit(1).cast("bigint"), window)).otherwise(F.lit(0))
