"""Hash chains: building them per source, and checking them in parallel.

Checking needs no sequential pass: the previous record's hash is recomputed from its own bytes, so each link is
a comparison with the preceding row, and the first failing row is the answer a sequential fold would give.
Building is sequential by nature (every record contains the hash of the one before); it runs one run of
records per source at a time with constant memory, and all runs in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import ZERO_HASH, sha_hex
from tidemark.operators.intervals import covered as within
from tidemark.operators.ordered import BLOCK_WIDTH, stitched_lag, stitched_row_number

# The fields of a captured record in their serialised order.
RECORD_FIELDS = ("v int, source_id string, seq bigint, event_type string, event_time string, ingest_time string, "
                 "actor string, outcome string, payload_clear string, payload_ct string, payload_hash string, "
                 "key_id string, prev_hash string")


def parse_record(record_bytes: Column) -> Column:
    """Struct of the record fields; null when the bytes are not one JSON object."""
    text = record_bytes.cast("string")
    # from_json yields a struct of nulls for a malformed line, so validity is asked of the strict parser. What parses and opens
    # with a brace is an object: its schema need not be spelled out for that.
    valid = F.try_parse_json(text).isNotNull() & F.ltrim(text, F.lit(" \t\r\n")).startswith("{")
    return F.when(valid, F.from_json(text, RECORD_FIELDS))


def parsed_frames(frames: DataFrame) -> DataFrame:
    """Adds the record fields and ``record_hash``, the hash of the exact bytes (never re-serialised)."""
    record = parse_record(F.col("record_bytes"))
    with_record = frames.withColumn("record", record)
    return with_record.withColumns({
        "record_hash": sha_hex(F.col("record_bytes")),
        "parse_error": F.col("record").isNull(),
    })


def assign_sequence(events: DataFrame, order: str, heads: DataFrame | None = None,
                    width: int = BLOCK_WIDTH) -> DataFrame:
    """Contiguous seq per source in arrival order, going on from the last stored number."""
    numbered = stitched_row_number(events, ["source_id"], order, "seq", width)
    if heads is None:
        return numbered
    return (numbered.join(heads.select("source_id", "last_seq"), "source_id", "left")
            .withColumn("seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq"))


def split_runs(events: DataFrame, rows: int) -> DataFrame:
    """Bounds a chain: records past ``rows`` of one source go to further sources (``id~1``, ``id~2``, ...).

    Each is a complete source of its own, numbered from 1 and starting at the genesis link, so a backfill of
    one very large source becomes many chains that are built and checked in parallel. The run length is part of the identity
    of the sources it makes, so the caller states it and keeps to it.
    """
    run = F.call_function("div", F.col("seq") - 1, F.lit(rows).cast("bigint"))
    return events.withColumn("_run", run).withColumns({
        "source_id": F.when(F.col("_run") == 0, F.col("source_id")).otherwise(
            F.concat("source_id", F.lit("~"), F.col("_run").cast("string"))),
        "seq": F.col("seq") - F.col("_run") * F.lit(rows),
    }).drop("_run")


def build_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chained frames from ``(source_id, seq, body)``; body is the record text up to its prev_hash value.

    Rows are shuffled by source, sorted inside the partition and streamed: one hash is all the state. Pass
    the output of split_runs to bound a source; pass heads(source_id, last_hash) to go on from stored chains.
    """
    wanted = events.select("source_id", "seq", "body")
    if heads is not None:
        wanted = wanted.join(heads.select("source_id", "last_hash"), "source_id", "left")
    else:
        wanted = wanted.withColumn("last_hash", F.lit(None).cast("string"))
    ordered = wanted.repartition("source_id").sortWithinPartitions("source_id", "seq")
    return ordered.mapInArrow(_link_batches, T.StructType([
        T.StructField("source_id", T.StringType()), T.StructField("seq", T.LongType()),
        T.StructField("record_bytes", T.BinaryType()), T.StructField("claimed_hash", T.StringType()),
    ]))


def _link_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    source, previous = None, ZERO_HASH
    for batch in batches:
        records, hashes = [], []
        for name, body, start in zip(batch["source_id"].to_pylist(), batch["body"].to_pylist(),
                                     batch["last_hash"].to_pylist()):
            if name != source:
                source, previous = name, start or ZERO_HASH
            record = f'{body}{previous}"}}'.encode()
            previous = hashlib.sha256(record).hexdigest()
            records.append(record)
            hashes.append(previous)
        yield pa.RecordBatch.from_arrays(
            [batch["source_id"], batch["seq"], pa.array(records, pa.binary()), pa.array(hashes, pa.string())],
            names=["source_id", "seq", "record_bytes", "claimed_hash"])


def link_errors(parsed: DataFrame, covered: DataFrame | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    """Rows that fail their own check, with kind and message. Order of checks: hash, parse, gap, link.

    ``parsed`` holds source_id, ordinal, claimed_hash, record_hash, parse_error, seq, prev_hash.
    ``covered(source_id, lo, hi)`` are merged tombstone ranges: sources that have any start at seq 1, and a
    gap is accepted only when one range covers it whole.
    """
    return link_kinds(stitched_lag(parsed, ["source_id"], "ordinal", ["seq", "record_hash"], width), covered)


def link_kinds(rows: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """The failing ones of rows that know the record before them (prev_seq, prev_record_hash)."""
    previous_seq = F.coalesce("prev_seq", F.lit(0).cast("bigint"))
    previous_hash = F.coalesce("prev_record_hash", F.lit(ZERO_HASH))
    first = F.col("prev_record_hash").isNull()
    rows = rows.withColumns({"_pseq": previous_seq, "_phash": previous_hash})
    skips = F.col("seq") != F.col("_pseq") + 1
    if covered is None:
        gap = ~first & skips
        link = F.col("prev_hash") != F.col("_phash")
    else:
        rows = _flag_covered(rows, covered)
        gap = F.when(F.col("_has_cover"), skips & ~F.col("_gap_covered")).otherwise(~first & skips)
        link = ((F.col("prev_hash") != F.col("_phash"))
                & ~(F.col("_has_cover") & skips & F.col("_gap_covered")))
    kind = (F.when(F.col("record_hash") != F.col("claimed_hash"), F.lit("hash"))
            .when(F.col("parse_error"), F.lit("parse"))
            .when(gap, F.lit("gap"))
            .when(link, F.lit("link")))
    text = F.col("seq").cast("string")
    expected = (F.col("_pseq") + 1).cast("string")
    message = (
        F.when(kind == "hash", F.concat(F.lit("chain: seq "), expected, F.lit(" hash mismatch: claimed "),
                                        "claimed_hash", F.lit(" computed "), "record_hash"))
        .when(kind == "parse", F.lit("chain: record does not parse"))
        .when(kind == "gap", F.concat(F.lit("chain: sequence gap: expected seq "), expected, F.lit(", got "), text))
        .when(kind == "link", F.concat(F.lit("chain: seq "), text, F.lit(" prev_hash mismatch: expected "),
                                       "_phash", F.lit(", got "), "prev_hash")))
    return (rows.withColumns({"kind": kind, "message": message}).where(F.col("kind").isNotNull())
            .select("source_id", "ordinal", "seq", "kind", "message"))


def _flag_covered(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """Only rows that skip numbers meet the ranges, joined by source and checked for containment."""
    having = covered.select("source_id").distinct().withColumn("_has_cover", F.lit(True))
    rows = rows.join(having, "source_id", "left").withColumn("_has_cover", F.coalesce("_has_cover", F.lit(False)))
    skipping = rows.where(F.col("_has_cover") & (F.col("seq") > F.col("_pseq") + 1)).select(
        "source_id", "ordinal", (F.col("_pseq") + 1).alias("lo"), (F.col("seq") - 1).alias("hi"))
    inside = (within(skipping, "lo", "hi", covered).where(F.col("covered")).select("source_id", "ordinal")
              .withColumn("_gap_covered", F.lit(True)))
    return rows.join(inside, ["source_id", "ordinal"], "left").withColumn(
        "_gap_covered", F.coalesce("_gap_covered", F.lit(False)))


def first_errors(errors: DataFrame) -> DataFrame:
    """The first failing row of each source: what a sequential check would stop at."""
    first = F.min_by(F.struct("ordinal", "seq", "kind", "message"), F.col("ordinal"))
    return errors.groupBy("source_id").agg(first.alias("e")).select("source_id", "e.ordinal", "e.seq", "e.kind", "e.message")


def chain_verdicts(parsed: DataFrame, covered: DataFrame | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    """One row per source: chain_valid and the first error."""
    return verdicts_of(first_errors(link_errors(parsed, covered, width)), parsed.select("source_id").distinct())


def verdicts_of(errors: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.join(errors, "source_id", "left").select(
        "source_id", F.col("kind").isNull().alias("chain_valid"), "kind", "message")
