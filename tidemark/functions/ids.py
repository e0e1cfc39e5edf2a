"""Segment identifiers: time-ordered UUIDs of version 7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID7 = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def is_uuid7(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID7), F.lit(False))


def mint_uuid7(millis: Column, seed: Column) -> Column:
    """Version 7 id from milliseconds and a seed text; the same input gives the same id, so retries are safe."""
    noise = F.sha2(F.encode(seed, "UTF-8"), 256)
    stamp = F.lpad(F.lower(F.hex(millis)), 12, "0")
    variant = F.element_at(F.array(F.lit("8"), F.lit("9"), F.lit("a"), F.lit("b")),
                           F.conv(F.substring(noise, 4, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(
        F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(noise, 1, 3),
        F.lit("-"), variant, F.substring(noise, 5, 3), F.lit("-"), F.substring(noise, 8, 12))
