"""Retention, legal holds and tombstones over the segment table."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import WHOLE_HI, WHOLE_LO, merge_ranges, overlapping

PAGE_MAX = 1000


def retention_candidates(segments: DataFrame, cutoff: str) -> DataFrame:
    """Live segments created before the cutoff (pinned time text, which sorts as time)."""
    return segments.where(F.col("deleted_at").isNull() & (F.col("created_at") < cutoff))


def active_holds(holds: DataFrame) -> DataFrame:
    return holds.where(F.col("released_at").isNull())


def hold_ranges(holds: DataFrame) -> DataFrame:
    """Active holds as ranges; a hold without both bounds covers its whole source."""
    ranged = F.col("seq_first").isNotNull() & F.col("seq_last").isNotNull()
    return active_holds(holds).select(
        "source_id", F.when(ranged, F.col("seq_first")).otherwise(F.lit(WHOLE_LO)).cast("bigint").alias("lo"),
        F.when(ranged, F.col("seq_last")).otherwise(F.lit(WHOLE_HI)).cast("bigint").alias("hi"))


def flag_held(segments: DataFrame, holds: DataFrame) -> DataFrame:
    """Adds ``held``: some active hold covers the source or meets the segment's range."""
    return overlapping(segments, "seq_first", "seq_last", hold_ranges(holds)).withColumnRenamed("overlaps", "held")


def cutoff_of(as_of: str, days: int) -> str:
    """The pinned time ``days`` whole days before a pinned time; its nanoseconds stay."""
    day = datetime.date.fromisoformat(as_of[:10]) - datetime.timedelta(days=days)
    return day.isoformat() + as_of[10:]


def expire(segments: DataFrame, holds: DataFrame, default_days: int, as_of: str) -> DataFrame:
    """The next state of the segment table: expired segments carry deleted_at, everything else stays.

    Adds ``expired`` for the rows of this run. What was created ``default_days`` or longer before ``as_of`` is due, so the
    policy in the evidence is the one applied. default_days <= 0 switches deletion off.
    """
    if default_days <= 0:
        return segments.withColumn("expired", F.lit(False))
    flagged = flag_held(segments, holds)
    due = F.col("deleted_at").isNull() & (F.col("created_at") < cutoff_of(as_of, default_days)) & ~F.col("held")
    return (flagged.withColumn("expired", due)
            .withColumn("deleted_at", F.when(F.col("expired"), F.lit(as_of)).otherwise(F.col("deleted_at"))).drop("held"))


def live_frames(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames of segments that are not deleted: what a rewrite of the frame table keeps."""
    return frames.join(segments.where(F.col("deleted_at").isNotNull()).select("segment_id"), "segment_id", "left_anti")


def tombstones(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("deleted_at").isNotNull())


def tombstone_ranges(tombstoned: DataFrame) -> DataFrame:
    return merge_ranges(tombstoned.select("source_id", F.col("seq_first").alias("lo"), F.col("seq_last").alias("hi")))


def flag_retained_roots(tombstoned: DataFrame, accepted: DataFrame) -> DataFrame:
    """Adds ``retained``: the tombstone's root is the root of an accepted checkpoint of its source."""
    roots = accepted.select("source_id", "root").distinct().withColumn("_known", F.lit(True))
    return tombstoned.join(roots, ["source_id", "root"], "left").withColumn("retained", F.coalesce("_known", F.lit(False))).drop("_known")


def retention_summary(flagged: DataFrame) -> DataFrame:
    """Per source with tombstones: expired count, merged ranges count, first and last expired number, roots retained."""
    return flagged.groupBy("source_id").agg(
        F.count("*").alias("expired_segments"), F.min("seq_first").alias("expired_from"),
        F.max("seq_last").alias("expired_to"), F.bool_and("retained").alias("roots_retained"))


def expired_ranges(tombstoned: DataFrame) -> DataFrame:
    """One row per expired segment with its range as text."""
    text = F.concat(F.lit("seq "), F.col("seq_first").cast("string"), F.lit("-"), F.col("seq_last").cast("string"))
    return tombstoned.select("source_id", "seq_first", text.alias("expired_range"))


def page_size(requested: int, most: int = PAGE_MAX) -> int:
    return most if requested == 0 or requested > most else requested


def list_page(rows: DataFrame, key: str, requested: int, token: str = "", source_id: str = "", most: int = PAGE_MAX) -> DataFrame:
    """One keyset page in key order; ``next_token`` is the last key when more rows follow, else empty."""
    size = page_size(requested, most)
    if source_id:
        rows = rows.where(F.col("source_id") == source_id)
    if token:
        rows = rows.where(F.col(key) > token)
    peeked = rows.orderBy(key).limit(size + 1)
    # The page holds at most ``most`` + 1 rows, so ranking it in one task is bounded.
    whole = Window.orderBy(key)
    ranked = peeked.withColumns({
        "_rank": F.row_number().over(whole),
        "_rows": F.count("*").over(Window.partitionBy(F.lit(0))),
        "_last": F.nth_value(key, size).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    more = F.col("_rows") > size
    return (ranked.withColumn("next_token", F.when(more, F.col("_last")).otherwise(F.lit("")))
            .where(F.col("_rank") <= size).drop("_rank", "_rows", "_last"))


def whole_days(hours: float) -> int:
    """A retention duration shorthand in whole days."""
    return int(hours / 24)


def policy_json(default_days: Column, frameworks: Column | None = None) -> Column:
    """Canonical text of a policy: fixed field order, framework names sorted, left out when empty."""
    head = F.concat(F.lit('{"default_days":'), default_days.cast("string"))
    if frameworks is None:
        return F.concat(head, F.lit("}"))
    ordered = F.map_from_entries(F.sort_array(F.map_entries(frameworks)))
    return F.concat(head, F.when(F.size(frameworks) > 0, F.concat(F.lit(',"frameworks":'), F.to_json(ordered))
                                 ).otherwise(F.lit("")), F.lit("}"))


def policy_change(policies: DataFrame, new_json: Column, keys: list[str]) -> DataFrame:
    """Latest stored policy per key against the effective one: changed, old, new, sha256 of the new text."""
    latest = policies.groupBy(*keys).agg(F.max_by("policy_json", "id").alias("old_policy"), F.max("id").alias("latest_id"))
    changed = latest.withColumn("new_policy", new_json)
    return changed.select(*keys, "old_policy", "new_policy", (F.col("old_policy") != F.col("new_policy")).alias("changed"),
                          F.sha2(F.encode("new_policy", "UTF-8"), 256).alias("sha256"))


def place_requests(requests: DataFrame) -> DataFrame:
    """Adds ``status`` to hold requests (source_id, reason, seq_first, seq_last)."""
    first, last = F.coalesce("seq_first", F.lit(0)), F.coalesce("seq_last", F.lit(0))
    ranged = (first != 0) | (last != 0)
    status = (F.when(F.coalesce("source_id", F.lit("")) == "", F.lit("missing_source_id"))
              .when(F.coalesce("reason", F.lit("")) == "", F.lit("missing_reason"))
              .when(ranged & ((first == 0) | (last == 0) | (first > last)), F.lit("bad_range"))
              .otherwise(F.lit("placed")))
    return requests.withColumn("status", status)


def release_requests(requests: DataFrame, holds: DataFrame, order: str) -> DataFrame:
    """Adds ``status``: released, already_released or not_found. Of several requests for a hold the first by ``order`` releases it."""
    first = requests.groupBy("hold_id").agg(F.min(order).alias("_first"))
    known = holds.select("hold_id", F.col("released_at").isNotNull().alias("_done")).join(first, "hold_id")
    status = (F.when(F.col("_done").isNull(), F.lit("not_found"))
              .when(F.col("_done") | (F.col(order) > F.col("_first")), F.lit("already_released")).otherwise(F.lit("released")))
    return requests.join(known, "hold_id", "left").withColumn("status", status).drop("_first", "_done")
