"""Checkpoint notes, key registries and timestamp receipts as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.notes import SIGNATURE_PREFIX, strict_base64
from tidemark.operators.ordered import stitched_running
from tidemark.sources.jsonl import scan_jsonl, with_ordinals

REGISTRY = "sources array<struct<source_id:string,origin:string,key_name:string,public_key:string>>"
RECEIPT = ("origin string, size bigint, root string, tsa string, token string, imprint string, gen_time string, "
           "anchored_at string, qualified boolean")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return with_ordinals(scan_jsonl(spark, [path])).where(F.col("value") != "")


def scan_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes persisted as one JSON string per line: (file, pos, note); pos rises in receipt order."""
    note = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    return _lines(spark, path).select("file", F.col("ordinal").alias("pos"), note.alias("note"))


def split_bundle_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a bundle's concatenated text file: (pos, note). A signature line closes a note.

    The lines are read in parallel; the signature lines before a line number its note.
    """
    return notes_of(with_ordinals(scan_jsonl(spark, [path])).select("ordinal", "value"), [])


def notes_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Notes (keys, pos, note) of their lines (keys, ordinal, value)."""
    closes = F.col("value").startswith(SIGNATURE_PREFIX)
    numbered = stitched_running(lines, keys, "ordinal", "pos", closes.cast("bigint"), "sum", False)
    packed = F.sort_array(F.collect_list(F.struct("ordinal", "value")))
    notes = numbered.groupBy(*keys, "pos").agg(F.bool_or(closes).alias("closed"), packed.alias("lines"))
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["value"]), "\n"), F.lit("\n"))
    return notes.where("closed").select(*keys, "pos", text.alias("note"))


def scan_registry(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Registered keys (source_id, origin, key_name, public_key, reg_pos) of documents, one per line or per file.

    reg_pos follows registration order. A key that is not 32 bytes fails the job.
    """
    if whole_files:
        documents = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("ordinal"), "value")
    else:
        documents = _lines(spark, path)
    parsed = documents.select("ordinal", F.from_json("value", REGISTRY).alias("d"))
    keys = parsed.select("ordinal", F.posexplode("d.sources").alias("place", "k"))
    raw = strict_base64(F.col("k.public_key"))
    checked = F.when(F.octet_length(raw) == 32, raw).otherwise(
        F.raise_error(F.concat(F.lit("registry: bad public key for "), F.col("k.source_id"))).cast("binary"))
    return keys.select("k.source_id", "k.origin", "k.key_name", checked.alias("public_key"),
                       F.struct("ordinal", "place").alias("reg_pos"))


def scan_receipts(spark: SparkSession, path: str) -> DataFrame:
    receipts = _lines(spark, path).select(F.col("ordinal").alias("pos"), F.from_json("value", RECEIPT).alias("r")).select("pos", "r.*")
    return receipts.withColumn("imprint", F.unhex("imprint")).withColumnRenamed("root", "root_b64")
