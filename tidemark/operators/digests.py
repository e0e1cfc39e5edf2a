"""Digests that bind a result to the exact records it was computed from.

A digest is the RFC 6962 Merkle root over the items of a key in order. It commits to every byte and position as a serial
SHA-256 does, is computed in parallel, and means the same for a key of three records and one of a trillion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hex_lower, leaf_hash
from tidemark.operators.merkle import merkle_roots
from tidemark.operators.ordered import stitched_row_number


def ordered_digests(items: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """(key, records, digest) over the binary column ``data`` in ``order`` (unique integer).

    ``items`` is read more than once: pass a written table, not a long computation.
    """
    rows = stitched_row_number(items.select(key, order, data), [key], order, "_n")
    leaves = rows.select(F.col(key).alias("source_id"), (F.col("_n") - 1).alias("idx"), leaf_hash(F.col(data)).alias("leaf"))
    return merkle_roots(leaves).select(F.col("source_id").alias(key), F.col("size").alias("records"), hex_lower(F.col("root")).alias("digest"))
