"""Exact deduplication by two passes and a Bloom filter of what was seen twice. DataFrame functions only.

Pass one sets two bits per text in a blocked counting filter that saturates at two; what is left of it is one bitmap
per block with the positions that at least two rows share. Pass two probes that filter: a text that misses a bit is
unique for certain and its row passes straight through. Only the others are shuffled and grouped by their SHA-256, so
false positives cost a little shuffle and never a wrong answer.

The filter takes ``bits_per_row`` bits a row up to ``max_blocks`` blocks of 4 KiB (64 MiB), which is what makes it
safe to broadcast. Beyond that it fills up, more rows take the shuffled path, and the result stays the same.

Cases: null text is the empty text; a null id sorts after all others; rows that repeat both id and text are copies of
each other and one of them stays; an empty table gives an empty result; further columns are kept by keep_first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, fresh, text_of
from tidemark.sources.store import materialise

BLOCK_BITS = 32768  # the bitmap functions of Spark work on 4 KiB bitmaps


def text_digest(text: Column) -> Column:
    """SHA-256 in hex of the text with every run of white space as one space."""
    return F.sha2(F.regexp_replace(text, SPACE, " "), 256)


def _part(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(_part(digest, 1), F.lit(blocks)).cast("int")


def _positions(digest: Column) -> list[Column]:
    bits = _part(digest, 16)
    return [bits.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int"), F.shiftright(bits, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")]


def seen_twice(keys: DataFrame, digest: str, rows: int, bits_per_row: int = 16, max_blocks: int = 16384) -> tuple[DataFrame, int]:
    """The filter as rows (bf_block, bf_bits), at most max_blocks of 4 KiB, and its number of blocks."""
    blocks = max(1, min(max_blocks, -(-rows * bits_per_row // BLOCK_BITS)))
    hits = keys.select(_block(F.col(digest), blocks).alias("bf_block"),
                       F.explode(F.array_distinct(F.array(*_positions(F.col(digest))))).alias("pos"))
    shared = hits.groupBy("bf_block", "pos").agg(F.count("*").alias("n")).where("n > 1")
    return shared.groupBy("bf_block").agg(F.bitmap_construct_agg(F.col("pos").cast("bigint")).alias("bf_bits")), blocks


def _bit(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(pos, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, pos.bitwiseAND(F.lit(7))) == 1


def maybe_repeated(rows: DataFrame, digest: str, flt: DataFrame, blocks: int, out: str) -> DataFrame:
    """Adds the boolean ``out``: false means no other row has this digest. The filter's size is bounded by its build."""
    probe = rows.withColumn("bf_block", _block(F.col(digest), blocks)).join(F.broadcast(flt), "bf_block", "left")
    both = [_bit(F.col("bf_bits"), p) for p in _positions(F.col(digest))]
    return probe.withColumn(out, F.coalesce(both[0] & both[1], F.lit(False))).drop("bf_block", "bf_bits")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    keys = materialise(docs.select(F.col(id_col).alias("id"), text_digest(text_of(text_col)).alias("digest"),
                                   F.monotonically_increasing_id().alias("row")), "exact-keys")
    flt, blocks = seen_twice(keys, "digest", keys.count())
    marked = maybe_repeated(keys, "digest", flt, blocks, "suspect")
    alone = marked.where("not suspect").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest")
    suspects = marked.where("suspect")
    # Written, so that the join has a shuffle on both sides and a hot group's rows can be split among tasks.
    groups = materialise(
        suspects.groupBy("digest").agg(F.count("*").alias("group_size"),
                                       F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
        .where("group_size > 1").select("digest", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")),
        "exact-groups")
    grouped = suspects.join(groups, "digest", "left").select(
        "id", F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "digest")
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one with the smallest id; columns as they are.

    Rows that repeat both id and text are interchangeable; which of their other columns stay is not defined.
    """
    digest, suspect, first = fresh(docs, "digest", "suspect", "first")
    keys = materialise(docs.select(F.col(id_col).alias("id"), text_digest(text_of(text_col)).alias("digest")), "exact-keys")
    flt, blocks = seen_twice(keys, "digest", keys.count())
    flt = materialise(flt, "exact-filter")
    keepers = (maybe_repeated(keys, "digest", flt, blocks, "suspect").where("suspect").groupBy("digest")
               .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("first"))
               .select(F.col("digest").alias("k_digest"), F.col("first.id").alias("k_id")))
    marked = maybe_repeated(docs.withColumn(digest, text_digest(text_of(text_col))), digest, flt, blocks, suspect)
    again = marked.where(F.col(suspect))
    kept = again.join(keepers, (again[digest] == keepers["k_digest"]) & again[id_col].eqNullSafe(keepers["k_id"]), "left_semi")
    whole = marked.where(~F.col(suspect)).unionByName(kept.dropDuplicates([digest, id_col]))
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns])


QUERY_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""
