"""Verdicts and the tables behind a continuity report, as projections of the verification results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.notes import plural, short_hash
from tidemark.functions.times import format_minutes
from tidemark.operators.continuity import coverage_text

# Assurance tiers and their labels.
TIER_LABELS = {
    0: "Tier 0 — assessed (analytical only; no finding cryptographically attested)",
    1: "Tier 1 — captured (single administrative domain; not independently verified)",
    2: "Tier 2 — independently verified",
    3: "Tier 3 — independently verified and externally witnessed",
}


def verdicts(results: DataFrame) -> DataFrame:
    intact = (F.col("chain_valid") & F.col("consistent") & (F.col("roots_valid") == F.col("signatures_valid"))
              & (F.col("signatures_valid") == F.col("total")))
    calm = (F.col("unbounded") == 0) & F.col("within_policy")
    return results.select(
        "source_id",
        F.when(calm, F.lit("Continuous")).otherwise(plural(F.col("unbounded"), "unobserved window")).alias("observability"),
        F.when(F.col("chain_valid"), F.lit("None")).otherwise(F.lit("Detected")).alias("event_loss"),
        F.when(intact, F.lit("Valid")).otherwise(F.lit("INVALID")).alias("integrity"),
        F.when(~intact, F.lit("FAIL")).when(calm, F.lit("OK")).otherwise(F.lit("ATTENTION")).alias("status"))


def report_tables(results: DataFrame) -> DataFrame:
    """Continuity, transport, sequence, heads, checkpoints and drift of each source in report wording."""
    counted = lambda good, all_: F.concat(F.col(good).cast("string"), F.lit(" / "), F.col(all_).cast("string"))
    return results.select(
        "source_id", "expected", "observed", coverage_text().alias("coverage"),
        format_minutes(F.col("longest_gap_ns")).alias("longest_gap"),
        F.when(F.col("within_policy"), F.lit("OK (within policy)")).otherwise(F.lit("GAP — see findings")).alias("continuity"),
        "outages", format_minutes(F.col("longest_outage_ns")).alias("longest_outage"), "buffered",
        F.when(F.col("outages") == 0, F.lit("—")).when(F.col("replay_completed"), F.lit("complete")).otherwise(F.lit("incomplete")).alias("replay"),
        F.when(F.col("chain_valid"), F.lit("none")).otherwise(F.lit("detected")).alias("loss"),
        F.concat(F.coalesce("seq_first", F.lit(0)).cast("string"), F.lit(" → "), F.coalesce("seq_last", F.lit(0)).cast("string")).alias("range_verified"),
        F.coalesce(short_hash(F.col("chain_head")), F.lit("")).alias("head"), F.col("total").alias("checkpoints"),
        counted("signatures_valid", "total").alias("signatures"), counted("roots_valid", "total").alias("roots"),
        F.concat(F.col("max_drift_ms").cast("string"), F.lit("ms")).alias("drift"))


def assurance_tier(self_hosted: Column, operator: Column, organisation: Column) -> tuple[Column, Column]:
    """(tier, label) of captured evidence: an operator of its own makes it independently verified."""
    own = self_hosted | (F.coalesce(operator, F.lit("")) == "") | (operator == organisation)
    return (F.when(own, F.lit(1)).otherwise(F.lit(2)),
            F.when(own, F.lit(TIER_LABELS[1])).otherwise(F.lit(TIER_LABELS[2])))
