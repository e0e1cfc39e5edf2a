"""JSON-lines inputs: ordered scan, size caps, input digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.digests import ordered_digests
from tidemark.operators.ordered import running_in_blocks

SPLIT = ["input_pos", "file", "split"]


def scan_jsonl(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """Lines of several inputs in order: (input_pos, file, split, row, value). Gzip is decoded by extension.

    The place of a line is (input, file, start of the file split, row inside it), so order survives parallel
    reading of one large file.
    """
    def one(position: int, path: str) -> DataFrame:
        return spark.read.option("lineSep", "\n").text(path).select(
            F.lit(position).alias("input_pos"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")

    return reduce(DataFrame.unionByName, [one(i, path) for i, path in enumerate(inputs)])


def with_ordinals(lines: DataFrame) -> DataFrame:
    """Adds ``ordinal``, the dense 1-based position over all inputs. Splits are bounded by the reader."""
    return running_in_blocks(lines, [], SPLIT, ["row"], "ordinal", F.lit(1).cast("bigint"))


def apply_caps(mapped: DataFrame, max_records: int = 0, max_bytes: int = 0) -> DataFrame:
    """Lines up to and including the one that reaches a cap; 0 means no cap. Needs map_lines output with SPLIT."""
    good = (~F.col("malformed")).cast("bigint")
    counted = running_in_blocks(mapped, [], SPLIT, ["row"], "_kept", good, "sum", False)
    sized = running_in_blocks(counted, [], SPLIT, ["row"], "_read", (F.octet_length("value") + 1).cast("bigint"), "sum", False)
    within = F.lit(True)
    if max_records > 0:
        within = within & (F.col("_kept") < max_records)
    if max_bytes > 0:
        within = within & (F.col("_read") < max_bytes)
    return sized.where(within).drop("_kept", "_read")


def truncation(capped: DataFrame, max_records: int = 0, max_bytes: int = 0) -> DataFrame:
    """One row: lines, malformed, bytes_read, truncated and why."""
    totals = capped.agg(
        F.count("*").alias("lines"), F.count_if("malformed").alias("malformed"),
        F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).cast("bigint").alias("bytes_read"))
    kept = F.col("lines") - F.col("malformed")
    reason = (F.when((F.lit(max_records) > 0) & (kept >= max_records), F.lit(f"max-records {max_records} reached; remaining input not read"))
              .when((F.lit(max_bytes) > 0) & (F.col("bytes_read") >= max_bytes), F.lit(f"max-bytes {max_bytes} reached; remaining input not read"))
              .otherwise(F.lit("")))
    return totals.withColumn("reason", reason).withColumn("truncated", F.col("reason") != "")


def line_digests(mapped: DataFrame, order: str = "ordinal") -> DataFrame:
    """Digests over trimmed lines, each ended by a newline: per source, and of the whole input (source_id null).

    The whole-input digest covers malformed lines, the per-source ones do not.
    """
    lines = mapped.select("source_id", "malformed", order, F.encode(F.concat("value", F.lit("\n")), "UTF-8").alias("data"))
    per_source = ordered_digests(lines.where(~F.col("malformed")), "source_id", order, "data")
    whole = ordered_digests(lines.withColumn("source_id", F.lit("*")), "source_id", order, "data")
    return per_source.unionByName(whole.withColumn("source_id", F.lit(None).cast("string")))
