"""The texts of findings: one table for the operators and for the SQL that checks them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    """severity, title and detail of a finding; {names} in title and detail are filled from columns."""

    severity: str
    title: str
    detail: str


# Identifiers, severities, titles and details are what readers of findings know them by.
TEXTS = {
    "A-INPUT": Text("medium", "malformed input lines",
                    "{malformed} of {total} input lines ({percent}%) could not be parsed and were excluded from analysis; the input digest still covers them."),
    "A-SEQGAP": Text("high", "sequence gap in exported data",
                     "{missing} sequence number(s) missing between {seq_first} and {seq_last}: {ranges}.{cut} "
                     "Indicative only: these numbers are from an unsigned export and cannot be proven to have existed."),
    "A-DUP": Text("medium", "duplicate sequence numbers", "repeated sequence numbers (count×value): {values}. Often a double export or an upstream re-emission."),
    "A-HBGAP": Text("high", "observation gap between heartbeats",
                    "{silences} silence(s) exceeded the max-silence policy ({limit}); longest {longest}. "
                    "Indicative: without signed heartbeats, a gap cannot be distinguished from a missing export."),
    "A-TIME": Text("low", "timestamp anomalies", "{parts}."),
    "A-COVERAGE": Text("medium", "export does not cover the full period", "the export's observed range does not span the requested period: {parts}."),
    "F-CHAIN": Text("high", "{kind}", "{error}"),
    "F-FORK": Text("high", "checkpoint inconsistency", "a checkpoint is not an append-only extension of an earlier one (possible fork or rewrite)"),
    "F-SIG": Text("high", "invalid checkpoint signature", "{bad} of {total} checkpoints failed signature verification"),
    "F-ANCHOR": Text("high", "Anchor receipt does not match any accepted checkpoint",
                     "{bad} of {total} timestamp receipts do not bind to an accepted checkpoint (imprint or origin/size/root mismatch)"),
    "F-RETENTION": Text("high", "retention tombstone outside verifiable history",
                        "a retention-deleted segment's Merkle root matches no accepted checkpoint; the deletion cannot be tied to committed, signed history"),
    "F-KEYREV": Text("high", "signing key revoked on {source}",
                     "key {label} revoked at seq {seq} (reason: {reason}); events signed by it between {since} and the revocation are suspect"),
    "F-GAP": Text("medium", "unobserved window on {source}", "no heartbeat for {gap} ({start} to {end}); activity in that window is unprovable"),
    "F-CLOCK": Text("low", "clock drift over policy on {source}", "max observed drift {drift}ms exceeds policy {limit}ms"),
}
TIME_PARTS = {"untimed": "record(s) with an unparseable/absent timestamp", "outside": "record(s) outside the declared period",
              "step_backs": "record(s) whose time decreases as sequence increases"}
COVERAGE_PARTS = ("no data for the first {gap} of the period (starts {seen}, period opens {edge})",
                  "no data for the last {gap} of the period (ends {seen}, period closes {edge})")
CUT = " (ranges truncated)"
CHAIN_KINDS = ("record parse failed", "hash chain broken")

# What to do about a finding, in this library's own words.
ADVICE = {
    "A-INPUT": "Open a few of the rejected lines first. Most are cut-off lines, or lines of a shape that another profile describes.",
    "A-SEQGAP": "Ask the owner of the log where the listed numbers went. Without signatures from the origin the answer stays a statement.",
    "A-DUP": "See whether the same file was exported twice. If not, the numbers restart and cannot order this log.",
    "A-HBGAP": "Match the listed silences with maintenance windows and host uptime before you call them outages.",
    "A-TIME": "Look at the raw time of some affected records: a wrong layout hits all of them, a bad clock only a stretch.",
    "A-COVERAGE": "Fetch the missing days from the origin, or state the shorter period in the report.",
    "F-KEYREV": "Treat what the key signed in that time as unsigned until a second record of the same events confirms it.",
    "F-GAP": "Find out whether the host was up at that time; if it was, the agent was not watching it.",
}
_NAME = re.compile(r"\{(\w+)\}")


def filled(template: str, **columns: Column) -> Column:
    """A template as a column: its words as literals, its {names} as text of the given columns."""
    parts = _NAME.split(template)
    made = [F.lit(p) if i % 2 == 0 else columns[p].cast("string") for i, p in enumerate(parts) if p or i % 2]
    return F.concat(*made) if len(made) > 1 else made[0]


def two_decimals(value: Column) -> Column:
    """A double of 0 to 100 with two decimals as printf("%.2f") rounds it: by its exact binary value, ties to even.

    Spark's format_string rounds the shortest decimal text half up instead: 15.625 is 15.63 there and 15.62 here.
    """
    # A double from 0.005 on is a whole number of 2^-62 (below 1) or 2^-56, so all that follows is exact.
    small = value < 1
    scaled = F.when(small, value * F.lit(2.0**62)).otherwise(value * F.lit(2.0**56)).cast("bigint").cast("decimal(20,0)") * 100
    unit = F.when(small, F.lit(1 << 62)).otherwise(F.lit(1 << 56)).cast("decimal(20,0)")
    whole = F.call_function("div", scaled, unit)
    twice = (scaled % unit) * 2
    up = (twice > unit) | ((twice == unit) & (whole % 2 == 1))
    hundredths = whole + up.cast("bigint")
    return F.concat(F.call_function("div", hundredths, F.lit(100).cast("bigint")).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled_sql(template: str, **expressions: str) -> str:
    """The same as SQL, from SQL expressions."""
    parts = _NAME.split(template)
    return " || ".join(quoted(p) if i % 2 == 0 else expressions[p] for i, p in enumerate(parts) if p or i % 2)
