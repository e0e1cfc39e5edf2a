"""Time expressions. Captured time is integer nanoseconds, foreign time integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes per layout token, in the order a profile may name them.
PINNED = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{9}Z$"
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"
DATE = r"^\d{4}-\d\d-\d\d$"
DATETIME = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d([.,]\d+)?$"
DATETIME_UTC = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d([.,]\d+)? UTC$"
LAYOUTS = ("", "rfc3339", "rfc3339nano", "2006-01-02", "datetime", "datetime-utc", "unix", "unixms")
UNIX_LAYOUTS = ("unix", "unixms")

ISO = "yyyy-MM-dd'T'HH:mm:ssXXX"


def _seconds(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(ISO)))


def parse_pinned_ns(text: Column) -> Column:
    """Nanoseconds of the pinned form (UTC, nine fraction digits, Z); null when it is any other form."""
    whole = _seconds(F.concat(F.substring(text, 1, 19), F.lit("Z")))
    nanos = F.substring(text, 21, 9).cast("bigint")
    return F.when(text.rlike(PINNED), whole * F.lit(1_000_000_000) + nanos)


def format_pinned(ns: Column) -> Column:
    nanos = F.pmod(ns, F.lit(1_000_000_000))
    return F.concat(
        F.date_format(F.timestamp_seconds(idiv(ns - nanos, 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("."),
        F.lpad(nanos.cast("string"), 9, "0"),
        F.lit("Z"),
    )


def _micros(whole: Column, text: Column) -> Column:
    fraction = F.regexp_extract(text, r"[.,](\d+)", 1)
    return whole * F.lit(1_000_000) + F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("bigint")


def parse_layout_us(text: Column, layout: str) -> Column:
    """Microseconds of a foreign timestamp text under a layout token; null when it does not fit."""
    if layout in UNIX_LAYOUTS:
        number = text.try_cast("double")
        scale = 1_000 if layout == "unixms" else 1_000_000
        # What BIGINT microseconds hold.
        usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(9.2e18 / scale))
        return F.when(usable, number.cast("bigint") * F.lit(scale))
    if layout in ("", "rfc3339", "rfc3339nano"):
        zone = F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1)
        whole = _seconds(F.concat(F.substring(text, 1, 19), zone))
        return F.when(text.rlike(RFC3339), _micros(whole, text))
    if layout == "2006-01-02":
        return F.when(text.rlike(DATE), _seconds(F.concat(text, F.lit("T00:00:00Z"))) * F.lit(1_000_000))
    shape = DATETIME if layout == "datetime" else DATETIME_UTC
    if layout not in ("datetime", "datetime-utc"):
        raise ValueError(f"unknown timestamp layout {layout!r}")
    whole = _seconds(F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z")))
    return F.when(text.rlike(shape), _micros(whole, text))


def idiv(a: Column, b: int) -> Column:
    """Integer division of a BIGINT or DECIMAL, truncating toward zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def rounded_seconds(ns: Column, unit: int = 1_000_000_000) -> Column:
    return idiv(ns + F.lit(unit // 2), unit)


def _clock(seconds: Column, pattern: str) -> Column:
    # Of the day alone: a whole span may be longer than a timestamp reaches.
    return F.date_format(F.timestamp_seconds(F.pmod(seconds, F.lit(86400).cast("bigint"))), pattern)


def format_span(us: Column, unit: int = 1_000_000) -> Column:
    """Observation span scaled up to days: 5s, 2m03s, 4h05m, 6d07h.

    Seconds since midnight are printed by the date formatter, which keeps the generated code small.
    """
    s = rounded_seconds(us, unit)
    return (
        F.when(us <= 0, F.lit("0s"))
        .when(s < 60, _clock(s, "s's'"))
        .when(s < 3600, _clock(s, "m'm'ss's'"))
        .when(s < 86400, _clock(s, "H'h'mm'm'"))
        .otherwise(F.concat(idiv(s, 86400).cast("string"), F.lit("d"), _clock(s, "HH'h'")))
    )


def span_text(us: int) -> str:
    """format_span for a plan-time constant."""
    s = (us + 500_000) // 1_000_000
    if us <= 0:
        return "0s"
    if s < 60:
        return f"{s}s"
    if s < 3600:
        return f"{s // 60}m{s % 60:02d}s"
    if s < 86400:
        return f"{s // 3600}h{s % 3600 // 60:02d}m"
    return f"{s // 86400}d{s % 86400 // 3600:02d}h"


def format_minutes(ns: Column) -> Column:
    """Report duration capped at minutes; a dash for zero."""
    s = rounded_seconds(ns)
    return (
        F.when(ns == 0, F.lit("—"))
        .when(s < 60, _clock(s, "s's'"))
        .otherwise(F.concat(idiv(s, 60).cast("string"), F.lit("m"), _clock(s, "ss's'")))
    )


def format_duration(ns: Column) -> Column:
    """Duration rounded to seconds as 1h2m3s, 2m0s, 5s."""
    s = rounded_seconds(ns)
    return (
        F.when(s < 60, _clock(s, "s's'"))
        .when(s < 3600, _clock(s, "m'm's's'"))
        .otherwise(F.concat(idiv(s, 3600).cast("string"), F.lit("h"), _clock(s, "m'm's's'")))
    )


def format_date(us: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd"), F.lit("—"))
