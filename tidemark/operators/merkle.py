"""RFC 6962 Merkle trees over per-source leaves, in parallel inside one source.

A tree of any size is a right-to-left fold of perfect subtrees, and every perfect subtree of a prefix tree is an
aligned node (level, index). So roots at many sizes, inclusion paths and consistency proofs all become: list
the aligned nodes that are needed, compute exactly those, join them back, fold.

The hashes are kept in tiles: a tile of round 0 holds up to 8,192 neighbouring leaves of a source, a tile of round r the tops
of as many full tiles below it. Tiles are written once, round by round until no tile is full, so no round is computed
twice and none is planned that the data does not need; full tiles never change, and a log that grows hashes its last tiles
only. Every aligned node lies in one tile, so whatever is asked is one join with the tiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import EMPTY_ROOT, bytes_of
from tidemark.sources.store import materialise

ROUND_BITS = 13
ROUNDS = 5  # 65 levels: every size that a BIGINT holds
MAX_LEVEL = 62
TILE = 1 << ROUND_BITS
TILE_ROWS = "source_id string, round int, tile bigint, n int, hashes array<binary>, top binary"


# The expressions over whole levels are written as SQL: one string instead of a tree of calls.
def _paired(below: str) -> str:
    """The next level of full pairs; a lone right node is left out, as it is no perfect subtree."""
    return f"""CASE WHEN size({below}) < 2 THEN CAST(array() AS array<binary>) ELSE
  transform(sequence(1, CAST(size({below}) DIV 2 AS INT)),
    i -> unhex(sha2(concat(X'01', element_at({below}, i * 2 - 1), element_at({below}, i * 2)), 256))) END"""


_TOP = f"get(aggregate(sequence(1, {ROUND_BITS}), hashes, (level, n) -> {_paired('level')}), 0)"
# All levels above the hashes of one tile, answered for what is asked.
_SOLVE = f"""aggregate(sequence(1, deepest), array(hashes), (levels, n) -> concat(levels, array({_paired('element_at(levels, -1)')})),
  levels -> transform(asked, a -> named_struct('level', a.level, 'node', a.node, 'hash', get(get(levels, a.lift), a.at))))"""
_ASIS = "transform(asked, a -> named_struct('level', a.level, 'node', a.node, 'hash', get(hashes, a.at)))"


def build_tiles(leaves: DataFrame, partial: DataFrame | None = None) -> DataFrame:
    """Written tiles (TILE_ROWS) over leaves(source_id, idx, leaf); ``idx`` is dense per source.

    Without ``partial`` a source starts at 0. With the tiles of a log that are not full yet, its leaves go on from there, and
    the tiles returned are those that are new or have grown.
    """
    current = leaves.select("source_id", F.col("idx").alias("node"), F.col("leaf").alias("hash"))
    made = []
    for number in range(ROUNDS):
        tiles = current.groupBy("source_id", F.expr(f"shiftright(node, {ROUND_BITS})").alias("tile")).agg(
            F.expr(f"transform(sort_array(collect_list(struct(node & {TILE - 1} AS o, hash AS h))), x -> x.h)").alias("hashes"))
        if partial is not None:
            before = partial.where(F.col("round") == number).select("source_id", "tile", F.col("n").alias("had"), F.col("hashes").alias("old"))
            before = before.groupBy("source_id", "tile").agg(F.max_by("old", "had").alias("old"))
            tiles = tiles.join(before, ["source_id", "tile"], "left").withColumn("hashes", F.expr("concat(coalesce(old, CAST(array() AS array<binary>)), hashes)"))
        tiles = tiles.select("source_id", F.lit(number).alias("round"), "tile", F.size("hashes").alias("n"), "hashes")
        made.append(materialise(tiles.withColumn("top", F.expr(f"CASE WHEN n = {TILE} THEN {_TOP} END")), "tiles"))
        full = made[-1].where(f"n = {TILE}")
        if full.isEmpty():
            break
        current = full.select("source_id", F.col("tile").alias("node"), F.col("top").alias("hash"))
    return reduce(DataFrame.unionByName, made)


def as_tiles(leaves: DataFrame) -> DataFrame:
    """Tiles as they are, leaves as tiles."""
    return leaves if "hashes" in leaves.columns else build_tiles(leaves)


def needed_nodes(leaves: DataFrame, needs: DataFrame) -> DataFrame:
    """Hashes of aligned nodes: leaves or tiles, needs(source_id, level, node) -> + hash; null where the leaves end before.

    Needed nodes must be perfect subtrees.
    """
    lift, round_ = f"CAST(level % {ROUND_BITS} AS INT)", f"CAST(level DIV {ROUND_BITS} AS INT)"
    rise = f"({ROUND_BITS} - {lift})"
    asked = needs.select("source_id", "level", "node").distinct().groupBy(
        "source_id", F.expr(round_).alias("round"), F.expr(f"shiftright(node, {rise})").alias("tile")).agg(F.expr(
            f"collect_list(struct(level, node, {lift} AS lift, CAST(node & (shiftleft(1L, {rise}) - 1) AS INT) AS at))").alias("asked"),
            F.expr(f"max({lift})").alias("deepest"))
    # Never broadcast: numbers without hashes look small in a shuffle and are many times larger in a driver's table.
    met = as_tiles(leaves).join(asked.hint("merge"), ["source_id", "round", "tile"])
    # Generated rows keep the solution from being computed once per use.
    solved = met.select("source_id", F.expr(f"explode(CASE WHEN deepest = 0 THEN {_ASIS} ELSE {_SOLVE} END)").alias("r"))
    # A log that has grown may hold several states of a tile: those before a node answer null for it.
    return solved.groupBy("source_id", F.col("r.level").alias("level"), F.col("r.node").alias("node")).agg(F.max("r.hash").alias("hash"))


def tile_sizes(tiles: DataFrame) -> DataFrame:
    """source_id, size: how many leaves the tiles hold."""
    return tiles.where("round = 0").groupBy("source_id").agg(F.max(F.col("tile") * TILE + F.col("n")).alias("size"))


def range_parts(start_level: str, size: str) -> str:
    """Aligned nodes of [x, size) where x is the start of size's partial subtree at start_level, as SQL.

    Every set bit b of size below start_level is one perfect subtree (b, (size >> b) - 1); with start_level
    above the highest bit this is the whole prefix tree.
    """
    return f"""transform(filter(sequence(0, {MAX_LEVEL}), b -> b < {start_level} AND (shiftright({size}, b) & 1) = 1),
      b -> named_struct('level', b, 'node', shiftright({size}, b) - 1))"""


# Root of consecutive perfect subtrees, array<struct<level, hash>>: a fold from right to left.
_FOLD = """aggregate(slice(sort_array({parts}), 2, greatest(size({parts}) - 1, 0)), element_at(sort_array({parts}), 1).hash,
  (right, p) -> unhex(sha2(concat(X'01', p.hash, right), 256)))"""


def fold_parts(parts: str) -> Column:
    return F.expr(_FOLD.format(parts=parts))


def prefix_roots(leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """Root of the first ``size`` leaves for each (source_id, size); size 0 is the empty tree.

    A size beyond the leaves has no root and is left out.
    """
    asked = sizes.select("source_id", "size").distinct()
    parts = asked.where("size > 0").select(
        "source_id", "size", F.expr(f"inline({range_parts(str(MAX_LEVEL + 1), 'size')})"))
    nodes = needed_nodes(leaves, parts)
    roots = (parts.join(nodes, ["source_id", "level", "node"], "left")
             .groupBy("source_id", "size")
             .agg(F.expr("collect_list(struct(level, hash))").alias("parts"), F.expr("count_if(hash IS NULL)").alias("absent"))
             .where("absent = 0").select("source_id", "size", fold_parts("parts").alias("root")))
    empty = asked.where("size = 0").select("source_id", "size", bytes_of(EMPTY_ROOT).alias("root"))
    return roots.unionByName(empty)


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """Root over all leaves of each source: (source_id, size, root)."""
    tiles = as_tiles(leaves)
    return prefix_roots(tiles, tile_sizes(tiles))
