"""Interval questions per source without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import BLOCK, BLOCK_WIDTH, _running, block_of, stitched_running

WHOLE_LO, WHOLE_HI = 0, (1 << 63) - 1


def merge_ranges(ranges: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Overlapping or adjacent (source_id, lo, hi) merged into disjoint ranges."""
    starts = ranges.groupBy("source_id", "lo").agg(F.max("hi").alias("hi"))
    reached = stitched_running(starts, ["source_id"], "lo", "_reach", F.col("hi"), "max", False, width)
    opens = F.coalesce((F.col("lo") - 1 > F.col("_reach")).cast("bigint"), F.lit(1).cast("bigint"))
    islands = stitched_running(reached.withColumn("_opens", opens), ["source_id"], "lo", "_island", F.col("_opens"), "sum",
                               True, width)
    return islands.groupBy("source_id", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def furthest_reach(probes: DataFrame, at: Column, ranges: DataFrame, out: str = "reach", width: int = BLOCK_WIDTH) -> DataFrame:
    """Adds the largest hi among the source's ranges with lo <= ``at`` (null without one).

    Both sides are laid along one axis and a running maximum is taken, so the cost is a sort of probes plus
    ranges, however many ranges a source has.
    """
    columns = probes.columns
    laid = probes.withColumns({"_at": at.cast("bigint"), "_side": F.lit(1), "_value": F.lit(None).cast("bigint")})
    empty = {c: F.lit(None).cast(probes.schema[c].dataType) for c in columns if c != "source_id"}
    starts = ranges.select("source_id", F.col("lo").cast("bigint").alias("_at"), F.lit(0).alias("_side"),
                           F.col("hi").cast("bigint").alias("_value"))
    starts = starts.withColumns(empty).select(*columns, "_at", "_side", "_value") if empty else starts
    both = laid.select(*columns, "_at", "_side", "_value").unionByName(starts).withColumn(BLOCK, block_of(F.col("_at"), width))
    reached = _running(both, ["source_id"], [BLOCK], ["_at", "_side"], out, "max", True)
    return reached.where(F.col("_side") == 1).select(*columns, out)


def overlapping(probes: DataFrame, lo: str, hi: str, ranges: DataFrame) -> DataFrame:
    """Adds ``overlaps``: whether [lo, hi] meets any range of its source."""
    reached = furthest_reach(probes, F.col(hi), ranges, "_reach")
    return reached.withColumn("overlaps", F.coalesce(F.col("_reach") >= F.col(lo), F.lit(False))).drop("_reach")


def covered(probes: DataFrame, lo: str, hi: str, disjoint: DataFrame) -> DataFrame:
    """Adds ``covered``: whether one of the disjoint ranges holds [lo, hi] whole."""
    reached = furthest_reach(probes, F.col(lo), disjoint, "_reach")
    return reached.withColumn("covered", F.coalesce(F.col("_reach") >= F.col(hi), F.lit(False))).drop("_reach")
