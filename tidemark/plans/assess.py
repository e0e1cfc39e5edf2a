"""The assessment: every analysis the capabilities of an input allow, as one plan over all sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import assess as a
from tidemark.operators.mapping import map_lines
from tidemark.sources.jsonl import apply_caps, line_digests, scan_jsonl, truncation, with_ordinals
from tidemark.sources.profiles import Capabilities, Profile
from tidemark.sources.store import materialise


@dataclass(frozen=True)
class AssessPolicy:
    """Limits in microseconds; a period bound of None disables it. The end is midnight opening its day."""

    interval_us: int = 60_000_000
    max_silence_us: int = 180_000_000
    period: tuple[int | None, int | None] = (None, None)


def parse_period(text: str) -> tuple[int | None, int | None]:
    """YYYY-MM-DD:YYYY-MM-DD to two midnights in microseconds."""
    from datetime import datetime, timezone

    if not text:
        return (None, None)
    start, sep, end = text.partition(":")
    if not sep:
        raise ValueError("period must be YYYY-MM-DD:YYYY-MM-DD")
    bounds = [datetime.strptime(p, "%Y-%m-%d").replace(tzinfo=timezone.utc) for p in (start, end)]
    return tuple(int(b.timestamp()) * 1_000_000 for b in bounds)


def assess_findings(foreign: DataFrame, caps: Capabilities, policy: AssessPolicy, order: list[str],
                    malformed: DataFrame | None = None) -> DataFrame:
    """Findings of all sources, in the order A-INPUT, A-SEQGAP, A-DUP, A-HBGAP, A-TIME, A-COVERAGE.

    Every analysis ends in facts per source; the facts are joined to one wide row per source, and the findings
    are read off that row. A missing capability means its branch is not part of the plan at all.
    """
    period = policy.period
    wide = a.source_facts(foreign, period)
    findings = []
    if malformed is not None:
        wide = a.with_malformed(wide, malformed)
        findings.append(a.input_finding())
    if caps.sequenced:
        steps = a.block_steps(a.distinct_sequences(foreign))
        wide = (wide.join(a.sequence_facts(steps, stitched=False), "source_id", "left")
                .join(a.step_backs(foreign, order), "source_id", "left"))
        findings += [a.gap_finding(), a.duplicate_finding()]
    if caps.heartbeats:
        wide = wide.join(a.silence_facts(a.silences(foreign, policy.max_silence_us)), "source_id", "left")
        findings.append(a.silence_finding(policy.max_silence_us))
    findings.append(a.time_finding(caps.sequenced))
    if period != (None, None):
        findings.append(a.coverage_finding(period))
    return a.raised(wide, findings)


@dataclass(frozen=True)
class AssessRun:
    """What an assessment of files yields; ``mapped`` is the normalised log, written once, that the others read."""

    mapped: DataFrame
    findings: DataFrame
    inputs: DataFrame

    @property
    def digests(self) -> DataFrame:
        """Hashes every line, so only for those who ask."""
        return line_digests(self.mapped)


def assess_files(spark: SparkSession, inputs: list[str], profile: Profile, policy: AssessPolicy, max_records: int = 0,
                 max_bytes: int = 0) -> AssessRun:
    """From JSON-lines files to findings, digests and input totals. Lines are read and mapped once."""
    lines = map_lines(scan_jsonl(spark, inputs), profile)
    if max_records or max_bytes:
        lines = apply_caps(lines, max_records, max_bytes)
    mapped = materialise(with_ordinals(lines), "assessed")
    findings = assess_findings(mapped.where(~F.col("malformed")), profile.capabilities(), policy, ["ordinal"], a.count_malformed(mapped))
    return AssessRun(mapped, findings, truncation(mapped, max_records, max_bytes))


def finding_counts(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per source, zero included, and whether any of them fails the run."""
    counted = findings.groupBy("source_id").agg(F.count("*").alias("findings"))
    return (sources.select("source_id").join(counted, "source_id", "left")
            .select("source_id", F.coalesce("findings", F.lit(0)).alias("findings"))
            .withColumn("failed", F.col("findings") > 0))


def assess_tables(foreign: DataFrame, findings: DataFrame, caps: Capabilities) -> DataFrame:
    """Coverage row per source: records, observed range, verdict, what ran and what could not."""
    spans = a.source_span(foreign)
    joined = spans.join(finding_counts(spans, findings), "source_id")
    n = F.col("findings")
    verdict = F.when(n == 0, F.lit("no anomalies (Tier 0 — indicative)")).otherwise(F.concat(
        n.cast("string"), F.when(n == 1, F.lit(" finding")).otherwise(F.lit(" findings")),
        F.lit(" (Tier 0 — indicative)")))

    def minute(us: str):
        return F.coalesce(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm 'UTC'"), F.lit("—"))

    return joined.select(
        "source_id", "records", minute("first_us").alias("observed_from"), minute("last_us").alias("observed_to"),
        verdict.alias("verdict"), F.lit(", ".join(caps.assessed())).alias("assessed"),
        F.lit("; ".join(caps.missing())).alias("not_assessable"))
