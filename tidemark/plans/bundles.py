"""Offline re-verification of a bundle: files, record facts, chain and its binding to signed checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import export
from tidemark.operators.chain import chain_verdicts, parsed_frames
from tidemark.plans.verify import Evidence, findings, verify
from tidemark.sources.jsonl import scan_jsonl, with_ordinals
from tidemark.sources.store import materialise


def bundle_frames(spark: SparkSession, directory: str) -> DataFrame:
    """Frames of records.jsonl in file order; the claimed hash is that of the stored line."""
    lines = with_ordinals(scan_jsonl(spark, [f"{directory}/records.jsonl"])).where(F.col("value") != "")
    data = F.encode("value", "UTF-8")
    return parsed_frames(lines.select("ordinal", data.alias("record_bytes"), F.sha2(data, 256).alias("claimed_hash")))


def verify_bundle(spark: SparkSession, directory: str, notes: DataFrame | None = None) -> DataFrame:
    """Checks as rows (source_id, label, status, detail). ``notes`` are checkpoints with sig_ok already set."""
    manifest, listed = export.read_manifest(spark, directory)
    frames = bundle_frames(spark, directory).withColumn("source_id", F.col("record.source_id"))
    files = export.compare_files(listed, export.file_hashes(spark, directory))
    bad = manifest.select("source_id").crossJoin(F.broadcast(files.agg(F.count_if(F.col("status") != "ok").alias("bad"), F.count("*").alias("n"))))
    return _checks(manifest, bad, frames, notes)


def verify_bundles(spark: SparkSession, directory: str, notes: DataFrame | None = None) -> DataFrame:
    """As verify_bundle for the bundles of many sources written together; one set of jobs for all of them."""
    facts, _ = export.read_manifest(spark, directory)
    listed = spark.read.schema("source_id string, file string, sha256 string").json(f"{directory}/manifest-files")
    present = export.digests(spark, directory)
    owners = listed.select("file", "source_id").unionByName(present.select("file", "source_id")).distinct()
    files = export.compare_files(listed.drop("source_id"), present.drop("source_id")).join(owners, "file")
    bad = files.groupBy("source_id").agg(F.count_if(F.col("status") != "ok").alias("bad"), F.count("*").alias("n"))
    lines = export.source_lines(spark, f"{directory}/records", True).where(F.col("value") != "")
    data = F.encode("value", "UTF-8")
    frames = materialise(lines.select("source_id", "ordinal", data.alias("record_bytes"), F.sha2(data, 256).alias("claimed_hash")), "bundle-frames")
    return _checks(facts, bad, parsed_frames(frames), notes)


def _checks(manifest: DataFrame, bad: DataFrame, frames: DataFrame, notes: DataFrame | None) -> DataFrame:
    records = frames.select("source_id", F.col("record.seq").alias("seq"), F.col("record.actor").alias("actor"),
                            F.lit(None).cast("bigint").alias("time_ns"), "record_hash")
    source = manifest.select("source_id", "filter", "chain_head")
    check = lambda label, ok, good, poor: [
        F.lit(label).alias("label"), F.when(ok, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        F.when(ok, good).otherwise(poor).alias("detail")]
    rows = [
        source.join(bad, "source_id", "left").fillna(0, ["bad", "n"]).select("source_id", *check(
            "file integrity", F.col("bad") == 0, F.concat(F.col("n").cast("string"), F.lit(" files match manifest SHA-256")),
            F.concat(F.col("bad").cast("string"), F.lit(" files differ from the manifest")))),
        export.compare_records(export.manifest_facts(records, export.RecordFilter()), manifest).select("source_id", *check(
            "record integrity", F.col("mismatches") == "", F.lit("records match manifest seq/hash bounds"), F.col("mismatches"))),
    ]
    whole = F.col("filter") == export.WHOLE_SOURCE
    chained = chain_verdicts(frames.select("source_id", "ordinal", "claimed_hash", "record_hash", "parse_error",
                                           F.col("record.seq").alias("seq"), F.col("record.prev_hash").alias("prev_hash")))
    last = records.groupBy("source_id").agg(F.max_by("record_hash", "seq").alias("head"))
    bound = source.join(chained, "source_id", "left").join(last, "source_id", "left")
    intact = F.coalesce("chain_valid", F.lit(True)) & F.coalesce(F.col("head") == F.col("chain_head"), F.lit(True))
    rows.append(bound.where(whole).select("source_id", *check(
        "hash chain", intact, F.lit("records form a contiguous verified chain matching the manifest head"),
        F.coalesce(F.concat(F.lit("chain broken: "), "message"), F.lit("chain head differs from the manifest")))))
    rows.append(source.where(~whole).select(
        "source_id", F.lit("chain/checkpoints").alias("label"), F.lit("info").alias("status"),
        F.lit("filtered bundle: integrity rests on the per-record hashes and the manifest").alias("detail")))
    if notes is not None:
        verification = verify(Evidence(frames.select("source_id", "ordinal", "record_bytes", "claimed_hash"),
                                       source.where(whole), notes))
        found = findings(verification)
        integrity = F.col("id").rlike(export.INTEGRITY_IDS)
        rows.append(found.select(
            "source_id", F.when(integrity, F.lit("checkpoint binding")).otherwise(F.lit("continuity")).alias("label"),
            F.when(integrity, F.lit("fail")).otherwise(F.lit("info")).alias("status"),
            F.concat(F.lit("["), "id", F.lit("] "), "title").alias("detail")))
        good = verification.results.where(F.col("chain_valid") & F.col("consistent"))
        rows.append(good.select(
            "source_id", F.lit("checkpoints").alias("label"), F.lit("pass").alias("status"),
            F.concat(F.col("signatures_valid").cast("string"), F.lit(" signed, "), F.col("roots_valid").cast("string"),
                     F.lit(" roots valid: chain bound to signed checkpoints")).alias("detail")))
    return reduce(DataFrame.unionByName, rows)


def bundle_verdict(checks: DataFrame) -> DataFrame:
    return checks.groupBy("source_id").agg((F.count_if(F.col("status") == "fail") == 0).alias("ok"), F.count("*").alias("checks"))
