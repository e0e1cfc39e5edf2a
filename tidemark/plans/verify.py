"""Verification of captured records: every check over all sources as one set of DataFrames.

The record bytes are read, parsed, hashed and put in order once (operators/passes.py). Each check then reads only the rows
and columns it needs from there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.texts import ADVICE, CHAIN_KINDS, TEXTS, filled
from tidemark.functions.times import format_duration, format_pinned
from tidemark.operators import captured as cap
from tidemark.operators import chain, checkpoints as cps, continuity as con, passes, retention as ret
from tidemark.operators.merkle import prefix_roots
from tidemark.operators.ordered import spans_between, stitched_row_number
from tidemark.sources.store import materialise


@dataclass(frozen=True)
class VerifyPolicy:
    interval_ns: int = con.INTERVAL_NS
    max_silence_ns: int = con.MAX_SILENCE_NS
    max_drift_ms: int = 1000


@dataclass(frozen=True)
class Evidence:
    """Input of a verification.

    frames(source_id, ordinal, record_bytes, claimed_hash); sources(source_id) are all registered sources;
    checkpoints(source_id, pos, origin, size, root, note, sig_ok); receipts as match_receipts expects;
    tombstones(source_id, seq_first, seq_last, root).
    """

    frames: DataFrame
    sources: DataFrame
    checkpoints: DataFrame
    receipts: DataFrame | None = None
    tombstones: DataFrame | None = None


@dataclass(frozen=True)
class Verification:
    results: DataFrame
    windows: DataFrame
    revocations: DataFrame
    event_counts: DataFrame
    policy: VerifyPolicy


def verify(evidence: Evidence, policy: VerifyPolicy = VerifyPolicy()) -> Verification:
    """All checks from one pass over the records. Results, windows and revocations are written, so that findings and reports read them."""
    done = passes.one_pass(evidence.frames)
    broken = done.sources.where("unparsed_at is not null").select("source_id")
    tombstoned = evidence.tombstones
    covered = ret.tombstone_ranges(tombstoned) if tombstoned is not None else None

    errors = chain.first_errors(passes.link_errors(done, covered))
    verdicts = chain.verdicts_of(errors, done.sources.select("source_id")).select("source_id", "chain_valid", F.col("message").alias("chain_error"))
    beats = done.rows.where("beat").select("source_id", "time_ns").join(broken, "source_id", "left_anti")
    spans = spans_between(beats, ["source_id"], "time_ns", policy.max_silence_ns)
    longest = spans.groupBy("source_id").agg(F.max("gap").alias("longest"))
    windows = materialise(con.windows_of(spans, passes.clean_stops(done), policy.max_silence_ns), "windows")
    revocations = materialise(cap.key_revocations(done.rows).join(broken, "source_id", "left_anti"), "revocations")
    accepted = evidence.checkpoints.where("sig_ok")
    whole = passes.leaves(done)
    whole = whole if tombstoned is None else whole.join(tombstoned.select("source_id").distinct(), "source_id", "left_anti")
    checked = cps.compare_roots(evidence.checkpoints, prefix_roots(whole, accepted.select("source_id", "size")))

    none = F.lit(0).cast("bigint")
    facts = done.sources.join(longest, "source_id", "left").withColumn("longest_gap_ns", F.coalesce("longest", none))
    facts = facts.withColumns({"expected": passes.expected_beats(policy.interval_ns),
                               "within_policy": (F.col("observed") > 0) & (F.col("longest_gap_ns") <= policy.max_silence_ns)}).drop("longest", "first_beat")
    parts = [
        facts, verdicts, cps.checkpoint_summary(checked, tombstoned), passes.transport(done),
        windows.groupBy("source_id").agg(F.count("*").alias("windows"), F.count_if(~F.col("bounded")).alias("unbounded")),
        revocations.groupBy("source_id").agg(F.count("*").alias("revocations")),
    ]
    if evidence.receipts is not None:
        parts.append(cps.anchor_summary(cps.match_receipts(evidence.receipts, accepted)))
    if tombstoned is not None:
        parts.append(ret.retention_summary(ret.flag_retained_roots(tombstoned, accepted)))
    joined = reduce(lambda left, right: left.join(right, "source_id", "left"), parts, evidence.sources.select("source_id").distinct())
    records = done.rows.where(~F.col("parse_error")).join(broken, "source_id", "left_anti")
    return Verification(materialise(_with_defaults(joined), "results"), windows, revocations, cap.event_counts(records), policy)


_COUNTS = ["records", "total", "signatures_valid", "roots_valid", "observed", "expected", "longest_gap_ns", "outages",
           "longest_outage_ns", "buffered", "max_drift_ms", "windows", "unbounded", "revocations", "receipts", "matching",
           "expired_segments"]
_FLAGS = {"chain_valid": True, "consistent": True, "within_policy": False, "replay_completed": False, "encrypted": False,
          "qualified": False, "roots_retained": True}
# What a source with an unparseable record keeps: nothing but that one failure.
_CLEARED = {"seq_first", "seq_last", "chain_head", "first_ns", "last_ns", "key_id", "tsa", "latest_gen_ns", "expired_from", "expired_to"}


def _with_defaults(joined: DataFrame) -> DataFrame:
    unparsed = F.col("unparsed_at").isNotNull()
    columns = {}
    for name in joined.columns:
        c = F.col(name)
        if name in _COUNTS:
            columns[name] = F.when(unparsed, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("bigint")
        elif name in _FLAGS:
            columns[name] = F.when(unparsed, F.lit(_FLAGS[name])).otherwise(F.coalesce(c, F.lit(_FLAGS[name])))
        elif name in _CLEARED:
            columns[name] = F.when(~unparsed, c)
    columns["chain_valid"] = F.coalesce("chain_valid", F.lit(True)) & ~unparsed
    columns["chain_error"] = F.when(unparsed, F.concat(
        F.lit("verifier: entry "), F.col("unparsed_at").cast("string"), F.lit(": record does not parse"))).otherwise(F.col("chain_error"))
    return joined.select("source_id", *[columns[n].alias(n) if n in columns else F.col(n) for n in joined.columns if n != "source_id"])


def _finding(ident: str, ord_: int, sub: Column | None = None, suffix: Column | None = None, **values: Column) -> list[Column]:
    text = TEXTS[ident]
    shown = F.lit(ident) if suffix is None else F.concat(F.lit(ident + "-"), suffix.cast("string"))
    return ["source_id", F.lit(ord_).alias("ord"), (F.lit(0) if sub is None else sub).cast("bigint").alias("sub"), shown.alias("id"),
            F.lit(text.severity).alias("severity"), filled(text.title, **values).alias("title"), filled(text.detail, **values).alias("detail"),
            F.lit(ADVICE.get(ident, "")).alias("recommendation")]


def findings(v: Verification) -> DataFrame:
    """Findings in the order F-CHAIN, F-FORK, F-SIG, F-ANCHOR, F-RETENTION, F-KEYREV, F-GAP-n, F-CLOCK."""
    r, source = v.results, F.col("source_id")
    kind = F.when(F.col("unparsed_at").isNotNull(), F.lit(CHAIN_KINDS[0])).otherwise(F.lit(CHAIN_KINDS[1]))
    found = [
        r.where(~F.col("chain_valid")).select(*_finding("F-CHAIN", 1, kind=kind, error=F.col("chain_error"))),
        r.where(~F.col("consistent")).select(*_finding("F-FORK", 2)),
        r.where(F.col("signatures_valid") != F.col("total")).select(*_finding(
            "F-SIG", 3, bad=F.col("total") - F.col("signatures_valid"), total=F.col("total"))),
    ]
    if "receipts" in r.columns:
        found.append(r.where(F.col("matching") != F.col("receipts")).select(*_finding(
            "F-ANCHOR", 4, bad=F.col("receipts") - F.col("matching"), total=F.col("receipts"))))
    if "expired_segments" in r.columns:
        found.append(r.where((F.col("expired_segments") > 0) & ~F.col("roots_retained")).select(*_finding("F-RETENTION", 5)))
    found.append(v.revocations.select(*_finding(
        "F-KEYREV", 6, F.col("ordinal"), source=source, **{c: F.col(c) for c in ("label", "seq", "reason", "since")})))
    # Numbers count every window of the source, bounded ones too.
    numbered = stitched_row_number(v.windows, ["source_id"], "start_ns", "_n", 1 << 50)
    found.append(numbered.where(~F.col("bounded")).select(*_finding(
        "F-GAP", 7, F.col("_n"), F.col("_n"), source=source, gap=format_duration(F.col("gap_ns")), start=format_pinned(F.col("start_ns")),
        end=format_pinned(F.col("end_ns")))))
    found.append(r.where(F.col("max_drift_ms") > v.policy.max_drift_ms).select(*_finding(
        "F-CLOCK", 8, source=source, drift=F.col("max_drift_ms"), limit=F.lit(v.policy.max_drift_ms))))
    return reduce(DataFrame.unionByName, found)
