"""Checkpoints: acceptance, roots, signatures, anchors and retained history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import base64_text, key_id
from tidemark.functions.notes import checkpoint_id, note_body, parse_checkpoint, signature_lines
from tidemark.operators.ordered import BLOCK_WIDTH, stitched_running

DECREASED = "tree size decreased"
DIFFERENT_ROOT = "different root at same tree size"


def parse_notes(notes: DataFrame) -> DataFrame:
    """Adds origin, size, root and extensions of the note; null when it does not parse."""
    parsed = notes.withColumn("_cp", parse_checkpoint(F.col("note")))
    return parsed.withColumns({
        "origin": F.col("_cp.origin"), "size": F.col("_cp.size").cast("bigint"), "root": F.col("_cp.root"),
        "extensions": F.col("_cp.extensions")}).drop("_cp")


def judge_submissions(submitted: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Append-only rule in receipt order per origin: adds ``status`` and ``head_size`` before the row.

    Accepted sizes never shrink, so the head is the running maximum of the sizes before, and its root is the
    one of the first row that reached it.
    """
    headed = stitched_running(submitted, ["origin"], "pos", "head_size", F.col("size"), "max", False, width)
    roots = submitted.groupBy("origin", "size").agg(F.min_by("root", "pos").alias("_root"))
    status = (
        F.when(F.col("head_size").isNull() | (F.col("size") > F.col("head_size")), F.lit("accepted"))
        .when(F.col("size") < F.col("head_size"), F.lit(DECREASED))
        .when(F.col("root") == F.col("_root"), F.lit("repeated"))
        .otherwise(F.lit(DIFFERENT_ROOT)))
    return headed.join(roots, ["origin", "size"]).withColumn("status", status).drop("_root")


def heads(checkpoints: DataFrame) -> DataFrame:
    """Latest head per origin: the largest size, the later one of equals."""
    latest = F.max_by(F.struct("size", "root", "pos"), F.struct("size", "pos"))
    return checkpoints.groupBy("origin").agg(latest.alias("h")).select("origin", "h.size", "h.root", "h.pos")


def compare_roots(checkpoints: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds ``root_ok``: the recomputed root of that size exists and is the same."""
    recomputed = roots.select("source_id", "size", F.col("root").alias("_root"))
    return checkpoints.join(recomputed, ["source_id", "size"], "left").withColumn(
        "root_ok", F.coalesce(F.col("root") == F.col("_root"), F.lit(False))).drop("_root")


def signed_parts(notes: DataFrame) -> DataFrame:
    """One row per note and usable signature line: text, key_name, key_id, signature."""
    lines = notes.withColumn("_s", F.explode(signature_lines(F.col("note"))))
    return lines.where(F.col("_s.size") == 68).select(
        "source_id", "pos", note_body(F.col("note")).alias("text"), F.col("_s.key_name").alias("key_name"),
        F.col("_s.key_id").alias("key_id"), F.col("_s.signature").alias("signature"))


@F.pandas_udf(T.BooleanType())
def ed25519_valid(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from tidemark.functions.ed25519 import verify

    for keys, texts, signatures in batches:
        yield pd.Series([verify(bytes(k), str(m).encode(), bytes(s)) for k, m, s in zip(keys, texts, signatures)])


def verify_signatures(notes: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``sig_ok``: some registered key of the source signed the note.

    Keys are matched by source, name and key id before any signature is checked.
    """
    keys = registry.select("source_id", "key_name", "public_key",
                           key_id(F.col("key_name"), F.col("public_key")).alias("key_id")).dropDuplicates()
    matched = signed_parts(notes).join(keys, ["source_id", "key_name", "key_id"])
    # Notes are few bytes and much work: by bytes alone they would all be put into one task.
    matched = matched.repartition(2 * notes.sparkSession.sparkContext.defaultParallelism, "source_id", "pos")
    good = (matched.where(ed25519_valid("public_key", "text", "signature")).select("source_id", "pos").distinct()
            .withColumn("_good", F.lit(True)))
    return notes.join(good, ["source_id", "pos"], "left").withColumn("sig_ok", F.coalesce("_good", F.lit(False))).drop("_good")


def checkpoint_summary(checked: DataFrame, tombstoned: DataFrame | None = None) -> DataFrame:
    """Counts per source over (source_id, sig_ok, root_ok).

    A root counts only under a valid signature. Sources with tombstones rest on signatures alone.
    """
    per = checked.groupBy("source_id").agg(
        F.count("*").alias("total"), F.count_if("sig_ok").alias("signatures_valid"),
        F.count_if(F.col("sig_ok") & F.col("root_ok")).alias("roots_valid"))
    if tombstoned is not None:
        mark = tombstoned.select("source_id").distinct().withColumn("_t", F.lit(True))
        per = per.join(mark, "source_id", "left").withColumn(
            "roots_valid", F.when(F.col("_t"), F.col("signatures_valid")).otherwise(F.col("roots_valid"))).drop("_t")
    consistent = (F.col("signatures_valid") == F.col("total")) & (F.col("roots_valid") == F.col("signatures_valid"))
    return per.withColumn("consistent", consistent)


def match_receipts(receipts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Adds ``matched``: the imprint is the SHA-256 of an accepted note with the same origin, size and root.

    ``receipts(source_id, pos, origin, size, root_b64, tsa, imprint, gen_ns, qualified)``;
    ``checkpoints(source_id, note, origin, size, root)`` holds accepted notes only.
    """
    known = checkpoints.select(
        "source_id", F.unhex(F.sha2(F.encode("note", "UTF-8"), 256)).alias("imprint"), F.col("origin").alias("_origin"),
        F.col("size").alias("_size"), base64_text(F.col("root")).alias("_root")).dropDuplicates(["source_id", "imprint"])
    joined = receipts.join(known, ["source_id", "imprint"], "left")
    same = (F.col("origin") == F.col("_origin")) & (F.col("size") == F.col("_size")) & (F.col("root_b64") == F.col("_root"))
    return joined.withColumn("matched", F.coalesce(same, F.lit(False))).drop("_origin", "_size", "_root")


def anchor_summary(matched: DataFrame) -> DataFrame:
    """Per source: receipts, matches, and authority, flag and latest time of the matches."""
    at = F.when(F.col("matched"), F.col("pos"))
    return matched.groupBy("source_id").agg(
        F.count("*").alias("receipts"), F.count_if("matched").alias("matching"),
        F.coalesce(F.max_by("tsa", at), F.lit("")).alias("tsa"),
        F.coalesce(F.max_by("qualified", at), F.lit(False)).alias("qualified"),
        F.max(F.when(F.col("matched"), F.col("gen_ns"))).alias("latest_gen_ns"))


def anchor_rollup(summaries: DataFrame) -> DataFrame:
    """All sources in one row; the authority named is that of the last source that has one."""
    named = F.when(F.col("tsa") != "", F.col("source_id"))
    return summaries.agg(
        F.sum("receipts").alias("receipts"), F.coalesce(F.max_by("tsa", named), F.lit("")).alias("tsa"),
        F.max("latest_gen_ns").alias("latest_gen_ns"), F.bool_and("qualified").alias("qualified"))


def anchor_candidates(checkpoints: DataFrame, receipts: DataFrame) -> DataFrame:
    """The latest checkpoint of each source where it has grown past the largest anchored size."""
    latest = F.max_by(F.struct("size", "note"), F.col("pos"))
    last = checkpoints.groupBy("source_id").agg(latest.alias("c")).select("source_id", "c.size", "c.note")
    anchored = receipts.groupBy("source_id").agg(F.max("size").alias("anchored"))
    return (last.join(anchored, "source_id", "left").withColumn("anchored", F.coalesce("anchored", F.lit(0)))
            .where(F.col("size") > F.col("anchored")))


def attested_checkpoints(accepted: DataFrame) -> DataFrame:
    """Citable ids of accepted checkpoints with their place, one row each; a list is left to the reader."""
    return accepted.select("source_id", "pos", checkpoint_id(F.col("origin"), F.col("size"), F.col("root")).alias("checkpoint_id"))


def registry_heads(registry: DataFrame) -> DataFrame:
    """Origin of the last registered key and the number of keys of each source."""
    return registry.groupBy("source_id").agg(
        F.max_by("origin", "reg_pos").alias("origin"), F.max_by("key_name", "reg_pos").alias("key_name"),
        F.max_by(key_id(F.col("key_name"), F.col("public_key")), "reg_pos").alias("key_id"), F.count("*").alias("keys"))
