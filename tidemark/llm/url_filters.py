"""URL filters: captures judged by the list entries that were active when they were fetched.

Lists come as dated changes (list, kind, pattern, action, at). The changes of an entry become validity intervals: from an
"add" to the next "remove", repeated adds and removes having no effect. A capture meets every pattern that could match its
URL - its host and each parent domain (kind "domain"), and its host with each leading part of its path (kind "prefix") - by
an equality join, and of these the intervals that contain its fetch time, start included and end not. Intervals of one entry
do not overlap, so a capture meets an entry at most once. Hot hosts are the probing side of a join that can be split.

Cases: a null or unparsable URL has no host and matches nothing; a null fetch time matches nothing; captures that repeat are
judged one by one; changes of one entry at the same moment count as a removal if any is one; an empty list blocks nothing; an
empty table gives an empty result; further columns are left out unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import materialise


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and trailing dot; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """Path without query and fragment and without a slash at its end."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def patterns_of(host: Column, path: Column) -> Column:
    """Every (kind, pattern) that could match: parent domains of two labels or more, and path prefixes at segments."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    n, m = F.size(labels), F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n - i + 1), ".").alias("pattern")))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), m)), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(parts, 1, i), "/")).alias("pattern")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(F.concat(domains, prefixes))


def validity(changes: DataFrame) -> DataFrame:
    """list, kind, pattern, start, end (null: still valid) of each interval, from list, kind, pattern, action, at."""
    entry = ["list", "kind", "pattern"]
    moments = changes.where("at is not null and action in ('add', 'remove')").groupBy(*entry, "at").agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy(*entry).orderBy("at")
    turns = moments.withColumn("before", F.lag("on", 1, False).over(w)).where(F.col("on") != F.col("before"))
    return turns.withColumn("end", F.lead("at").over(w)).where("on").select(*entry, F.col("at").alias("start"), "end")


def judge(captures: DataFrame, changes: DataFrame, id_col: str, url_col: str, time_col: str, keep: list[str] | None = None) -> DataFrame:
    """id, kept columns, host, fetched_at, blocked, n_entries, lists (names in order, joined by commas): one row per capture."""
    keep = keep or []
    active = materialise(validity(changes), "list-intervals")
    url = F.col(url_col).cast("string")
    rows = captures.select(F.monotonically_increasing_id().alias("_row"), id_col, *keep, F.coalesce(host_of(url), F.lit("")).alias("host"),
                           F.coalesce(path_of(url), F.lit("")).alias("_path"), F.col(time_col).alias("fetched_at"))
    tried = rows.select("_row", id_col, *keep, "host", "fetched_at", F.explode_outer(F.array_distinct(patterns_of(F.col("host"), F.col("_path")))).alias("p"))
    met = tried.select("*", F.col("p.kind").alias("kind"), F.col("p.pattern").alias("pattern")).drop("p").join(
        active, ["kind", "pattern"], "left").withColumn(
        "hit", F.col("start").isNotNull() & (F.col("fetched_at") >= F.col("start")) & (F.col("end").isNull() | (F.col("fetched_at") < F.col("end"))))
    return met.groupBy("_row", id_col, *keep, "host", "fetched_at").agg(
        F.coalesce(F.sum(F.col("hit").cast("bigint")), F.lit(0)).alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("list")))), ",").alias("lists")).select(
        id_col, *keep, "host", "fetched_at", (F.col("n_entries") > 0).alias("blocked"), "n_entries", "lists")
