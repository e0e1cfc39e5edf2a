"""Sharding by a hierarchical weighted hash tree. DataFrame functions only.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, u being a hash of the row's key
and the child's name, and the smallest draw wins, so children win in proportion to their weights. A draw depends on its
own child alone: a weight that changes moves rows only into or out of the subtrees that hold it, and at the levels where
no weight changed every row stays. A shard added as a subtree of its own takes rows only into itself.

Slots number the rows of a shard from 0 without gaps, in order of key. The placed rows are range-partitioned by shard and
key, numbered inside each slice, and slices of a shard are offset by the counts before them, so no task holds a shard.

Cases: a null key is a key of its own; rows that share a key share a shard; null text weighs 8 bytes and has the checksum
of the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.sources.store import materialise

HASH_BITS = 52


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has a number and no children."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def _group(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def shard_tree(shards: int, weights: dict[int, float] | None = None, planned: int = 24, per_rack: int = 2, per_region: int = 6) -> Node:
    """The tree of a shard count: the planned shards in regions of racks, every later shard a region of its own.

    A planned region holds ``per_region`` shards in racks of ``per_rack``. Growth beyond the plan changes no weight of an
    older subtree below the root, so a new shard takes rows from all the others and gives none away.
    """
    if shards < 1:
        raise ValueError("a tree needs a shard")
    leaf = [Node(f"shard-{i}", (weights or {}).get(i, 1.0), (), i) for i in range(shards)]
    inside = min(shards, planned)
    regions = []
    for start in range(0, inside, per_region):
        mine = leaf[start:min(start + per_region, inside)]
        racks = [_group(f"rack-{mine[j].shard}", mine[j:j + per_rack]) for j in range(0, len(mine), per_rack)]
        regions.append(_group(f"region-{start}", racks))
    for late in leaf[inside:]:
        regions.append(_group(f"region-{late.shard}", [_group(f"rack-{late.shard}", [late])]))
    return _group("root", regions)


def _draw(key: Column, child: Node) -> Column:
    digest = F.md5(F.concat(F.lit(child.name + ":"), key))
    whole = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("double")
    return -F.ln((whole + 0.5) / F.lit(float(1 << HASH_BITS))) / F.lit(float(child.weight))


def place(key: Column, node: Node) -> Column:
    """The shard of a key given as text: a nested choice, one level of draws per level of the tree."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = [F.struct(_draw(key, child).alias("draw"), F.lit(i).alias("i")) for i, child in enumerate(node.children)]
    won = F.array_min(F.array(*draws))["i"]
    # The choice is bound once by a one-element transform, so that its draws are not computed again for every branch.
    return F.element_at(F.transform(F.array(won), lambda w: _branch(key, node, w)), 1)


def _branch(key: Column, node: Node, won: Column) -> Column:
    out = None
    for i, child in enumerate(node.children):
        out = F.when(won == i, place(key, child)) if out is None else out.when(won == i, place(key, child))
    return out.cast("int")


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
               weights: dict[int, float] | None = None) -> DataFrame:
    """id, size, text_crc32, shard, slot, grown_shard: where each row goes now and with one more shard of weight 1."""
    text, key = text_of(text_col), key_text(F.col(id_col))
    placed = docs.select(
        F.col(id_col), F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text)).cast("bigint").alias("bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"), place(key, shard_tree(shards, weights)).alias("shard"),
        place(key, shard_tree(shards + 1, weights)).alias("grown_shard"), F.monotonically_increasing_id().alias("row"))
    sliced = materialise(
        placed.repartitionByRange("shard", F.col(id_col).asc_nulls_first(), "text_crc32", "row").withColumn("slice", F.spark_partition_id()),
        "sharded")
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n")).select(
        "shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "slice").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "row")
    return (sliced.withColumn("place", F.row_number().over(inside)).join(offsets, ["shard", "slice"])
            .select(id_col, (F.col("bytes") + 8).alias("size"), "text_crc32", "shard",
                    (F.col("offset") + F.col("place") - 1).cast("bigint").alias("slot"), "grown_shard"))


def tree_sql(shards: int) -> str:
    """The same descent as one SQL expression over a text column ``key``."""

    def draw(child: Node) -> str:
        return (f"-ln((('0x' || substr(md5('{child.name}:' || key), 1, {HASH_BITS // 4}))::BIGINT::DOUBLE + 0.5) / {float(1 << HASH_BITS)!r}) "
                f"/ {float(child.weight)!r}")

    def pick(node: Node) -> str:
        if node.shard is not None:
            return str(node.shard)
        if len(node.children) == 1:
            return pick(node.children[0])
        draws = "[" + ", ".join(draw(c) for c in node.children) + "]"
        arms = " ".join(f"WHEN {i + 1} THEN {pick(c)}" for i, c in enumerate(node.children))
        return f"(CASE list_position({draws}, list_min({draws})) {arms} END)"

    return pick(shard_tree(shards))


def query_sql(shards: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, text, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
p AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 8 AS size, text, {tree_sql(shards)}::INT AS shard, {tree_sql(shards + 1)}::INT AS grown_shard FROM d)
SELECT doc_id, size, shard, grown_shard, 'key' AS law, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot FROM p"""
