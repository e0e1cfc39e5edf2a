"""Inclusion and consistency proofs in bulk, and their verification, as joins and array folds."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merkle import MAX_LEVEL, ROUND_BITS, TILE, as_tiles, fold_parts, needed_nodes, range_parts

_EMPTY_PATH = "CAST(array() AS array<binary>)"
# How far the boundary leaf of an old tree rises as a right child (trailing one bits of old - 1), and where it gets.
_START = "(bit_count((old - 1) ^ old) - 1)"
_ORIGIN = f"shiftright(old - 1, {_START})"


def siblings(position: str, size: str, from_level: str) -> str:
    """Siblings met on the way from ``position`` (at from_level) to the root of a tree of ``size`` leaves, as SQL.

    array<struct<level, node, side>>: side L for a left sibling, R for a right one. A node that is the last
    of its level with an even index has no sibling and is promoted.
    """
    node = f"shiftright({position}, l - {from_level})"
    last = f"shiftright({size} - 1, l)"
    return f"""transform(
      filter(sequence(0, {MAX_LEVEL - 1}), l -> l >= {from_level} AND {last} > 0 AND (({node} & 1) = 1 OR {node} < {last})),
      l -> named_struct('level', l, 'node', {node} ^ 1, 'side', CASE WHEN ({node} & 1) = 1 THEN 'L' ELSE 'R' END))"""


def _step_parts(leaves: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """Parts of each of steps(key, size, step, level, node): one perfect node, or those of the ragged right edge."""
    whole = "node < shiftright(size - 1, level) OR shiftleft(node + 1, level) = size"
    parts = f"CASE WHEN {whole} THEN array(named_struct('level', level, 'node', node)) ELSE {range_parts('level', 'size')} END"
    pieces = steps.select(*key, "step", F.expr(f"explode({parts})").alias("p")).select(*key, "step", "p.level", "p.node")
    nodes = needed_nodes(leaves, pieces)
    # Shuffled on purpose, as in needed_nodes: there is a row for every step of every proof.
    return (pieces.join(nodes.hint("merge"), ["source_id", "level", "node"])
            .groupBy(*key, "step").agg(F.expr("collect_list(struct(level, hash))").alias("parts")))


def _hash_steps(leaves: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """Proof arrays from steps(key, size, step, level, node)."""
    hashed = _step_parts(leaves, steps, key).select(*key, "step", fold_parts("parts").alias("hash"))
    return hashed.groupBy(*key).agg(
        F.expr("transform(sort_array(collect_list(struct(step, hash))), s -> s.hash)").alias("path"))


def _levels(hashes: list) -> list[list]:
    """All levels of full pairs above the hashes of a tile; what stands on an absent hash is absent."""
    levels = [hashes]
    while len(levels) <= ROUND_BITS:
        below = levels[-1]
        levels.append([_node(below[i], below[i + 1]) for i in range(0, len(below) - 1, 2)])
    return levels


def _node(left: bytes | None, right: bytes | None) -> bytes | None:
    return None if left is None or right is None else hashlib.sha256(b"\x01" + left + right).digest()


def _fold(parts: list, times: int) -> bytes | None:
    """The hash of a step from its parts, the smallest first. A step that is asked for several times has its parts as often."""
    repeated = [h for h in parts for _ in range(times)]
    return reduce(lambda right, left: _node(left, right), repeated[1:], repeated[0])


def _edges(levels: list[list], size: int) -> list[list]:
    """By level: the parts of the last, not full node of the first ``size`` leaves of a tile."""
    edges, parts = [], []
    for level in range(ROUND_BITS):
        edges.append(list(parts))
        if size >> level & 1:
            node = (size >> level) - 1
            parts.append(levels[level][node] if node < len(levels[level]) else None)
    return edges


def _paths_of(levels: list[list], folded: list[list], tile: int, size: int, upper: list, places: np.ndarray, times: int) -> list[list]:
    """Paths of leaves of one tile (places in it) in the tree of the first ``size`` leaves of the source, asked for ``times`` times each."""
    values = [None, *(_fold(parts, times) for parts in upper)]
    edges = _edges(levels, min(size - (tile << ROUND_BITS), TILE))
    columns = []
    for level in range(ROUND_BITS):
        last = (size - 1 >> level) - (tile << ROUND_BITS - level)
        node = places >> level
        other = node ^ 1
        met = (last + tile > 0) & ((node & 1 == 1) | (node < last))
        whole = (other < last) | (((tile << ROUND_BITS - level) + other + 1) << level == size)
        base = len(values)
        values += folded[level]
        values.append(_fold(edges[level], times) if edges[level] else None)
        at = np.where(other < len(folded[level]), base + other, 0)
        columns.append(np.where(met, np.where(whole, at, len(values) - 1), -1))
    columns += [np.full(len(places), i, np.int64) for i in range(1, 1 + len(upper))]
    return [[values[i] for i in row if i >= 0] for row in np.stack(columns, 1).tolist()]


def _whole_runs(batches):
    """The same rows as tables; those that ask for the same are never in two of them."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
        if not rows.num_rows:
            continue
        names, stop = ["source_id", "_tile", "_kind", "_idx", "_size"], rows.num_rows - 1
        columns = [rows.column(n).to_pylist() for n in names]
        if columns[2][stop] == 2:
            while stop and all(c[stop - 1] == c[-1] for c in columns):
                stop -= 1
        else:
            stop += 1
        kept = rows.slice(stop) if stop < rows.num_rows else None
        if stop:
            yield rows.slice(0, stop)
    if kept is not None:
        yield kept


def _tile_paths(names: list[str]):
    """Rows in order of tile and kind (0 the tile, 1 what is above it by size, 2 leaves that are asked for) to asked rows with paths."""

    def run(batches):
        at, levels, uppers = None, {}, {}
        for table in _whole_runs(batches):
            keys = list(zip(table.column("source_id").to_pylist(), table.column("_tile").to_pylist(), strict=True))
            kind = table.column("_kind").to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or kind[i] != kind[i - 1]]
            rows, paths = [], []
            for start, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != at:
                    at, levels, uppers = keys[start], {}, {}
                part = table.slice(start, stop - start)
                if kind[start] == 0:
                    # A log that has grown may hold several states of a tile: the last one has all of them.
                    levels = {1: _levels(part.column("_hashes")[part.num_rows - 1].as_py())}
                elif kind[start] == 1:
                    uppers |= zip(part.column("_size").to_pylist(), part.column("_parts").to_pylist(), strict=True)
                else:
                    found = [[]] * part.num_rows
                    asked = list(zip(part.column("_idx").to_pylist(), part.column("_size").to_pylist(), strict=True))
                    often, alike = Counter(asked), {}
                    for i, (idx, size) in enumerate(asked):
                        if at[0] is not None and idx is not None and size is not None and 0 <= idx < size:
                            alike.setdefault((size, often[idx, size]), []).append((i, idx & TILE - 1))
                    for (size, times), wanted in alike.items():
                        upper = uppers.get(size) or []
                        if not levels:
                            some = [[_fold(parts, times) for parts in upper]] * len(wanted)
                        else:
                            if times not in levels:
                                levels[times] = [[_fold([h], times) for h in level] for level in levels[1]]
                            some = _paths_of(levels[1], levels[times], at[1], size, upper, np.array([o for _, o in wanted], np.int64), times)
                        for (i, _), path in zip(wanted, some, strict=True):
                            found[i] = path
                    rows.append(part)
                    paths.append(pa.array(found, pa.list_(pa.binary())))
            if rows:
                row = pa.concat_tables(rows).column("_row").combine_chunks()
                yield pa.RecordBatch.from_arrays([*(row.field(n) for n in names), pa.concat_arrays(paths)], names=[*names, "path"])

    return run


def inclusion_proofs(leaves: DataFrame, asked: DataFrame) -> DataFrame:
    """Audit paths for asked(source_id, idx, size, ...) over leaves or tiles: adds path array<binary> (leaf to root).

    The lower steps of a path lie in the leaf's own tile, and the upper ones are the same for all leaves of a tile, so what is
    asked meets its tile once, and no row is made for a step of a path but of the upper ones by tile and size. No path is shuffled:
    what else a row needs is best joined to ``asked`` before. A leaf outside its tree has an empty path. What is asked for several times has the parts of
    its steps as often, which is no proof.
    """
    tiles = as_tiles(leaves)
    tile = F.expr(f"shiftright(idx, {ROUND_BITS})")
    above = asked.where("idx >= 0 AND idx < size").select("source_id", tile.alias("idx"), "size").distinct()
    steps = above.select("source_id", "idx", "size", F.expr(f"posexplode({siblings('idx', 'size', str(ROUND_BITS))}) AS (step, s)")).select(
        "source_id", "idx", "size", "step", "s.level", "s.node")
    upper = _step_parts(tiles, steps, ["source_id", "idx", "size"]).groupBy("source_id", "idx", "size").agg(
        F.expr("transform(sort_array(collect_list(struct(step, parts))), s -> transform(sort_array(s.parts), x -> x.hash))").alias("parts"))
    names = asked.columns
    row = F.struct(*names)
    kind = asked.select(row.alias("r")).schema["r"].dataType

    def part(rows: DataFrame, number: int, tile, **known) -> DataFrame:
        kinds = {"_idx": "bigint", "_size": "bigint", "_hashes": "array<binary>", "_parts": "array<array<binary>>", "_row": kind}
        return rows.select("source_id", tile.alias("_tile"), F.lit(number).alias("_kind"), *[known.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    parts = [part(tiles.where("round = 0"), 0, F.col("tile"), _size=F.col("n"), _hashes=F.col("hashes")),
             part(upper, 1, F.col("idx"), _size=F.col("size"), _parts=F.col("parts")),
             part(asked, 2, tile, _idx=F.col("idx"), _size=F.col("size"), _row=row)]
    dealt = reduce(DataFrame.unionByName, parts).repartition("source_id", "_tile").sortWithinPartitions("source_id", "_tile", "_kind", "_size", "_idx")
    return dealt.mapInArrow(_tile_paths(names), T.StructType([*[T.StructField(f.name, f.dataType) for f in asked.schema], T.StructField("path", T.ArrayType(T.BinaryType()))]))


def consistency_proofs(leaves: DataFrame, asked: DataFrame) -> DataFrame:
    """Proofs that the tree of ``old`` leaves is a prefix of the tree of ``size``; adds path array<binary>."""
    anchor = f"""CASE WHEN {_ORIGIN} > 0 THEN array(named_struct('level', {_START}, 'node', {_ORIGIN}, 'side', 'A'))
      ELSE CAST(array() AS array<struct<level:int,node:bigint,side:string>>) END"""
    chain = f"concat({anchor}, {siblings(_ORIGIN, 'size', _START)})"
    steps = asked.where("old > 0 AND old < size").select(
        "source_id", "old", "size", F.expr(f"posexplode({chain}) AS (step, s)")).select(
        "source_id", "old", "size", "step", "s.level", "s.node")
    paths = _hash_steps(leaves, steps, ["source_id", "old", "size"])
    return asked.join(paths.hint("merge"), ["source_id", "old", "size"], "left").withColumn("path", F.expr(f"coalesce(path, {_EMPTY_PATH})"))


def _climb(start: str, path: str, sides: str, left_only: bool) -> str:
    """Folds a path onto start; with left_only, right siblings are skipped (the old tree's view)."""
    right = "acc" if left_only else "unhex(sha2(concat(X'01', acc, s.hash), 256))"
    return f"""aggregate(zip_with({path}, {sides}, (h, s) -> named_struct('hash', h, 'side', s.side)), {start},
      (acc, s) -> CASE WHEN s.side = 'L' THEN unhex(sha2(concat(X'01', s.hash, acc), 256)) ELSE {right} END)"""


def verify_inclusion(proofs: DataFrame) -> DataFrame:
    """Adds ``included`` to (leaf, idx, size, path, root)."""
    sides = siblings("idx", "size", "0")
    good = f"idx < size AND size(path) = size({sides}) AND {_climb('leaf', 'path', sides, False)} = root"
    return proofs.withColumn("included", F.expr(f"coalesce({good}, false)"))


def verify_consistency(proofs: DataFrame) -> DataFrame:
    """Adds ``consistent`` to (old, size, path, old_root, root)."""
    power = "(old & (old - 1)) = 0"
    # For a power of two the old root itself is the first node; otherwise the path states it.
    ready = proofs.withColumns({
        "_sides": F.expr(siblings(_ORIGIN, "size", _START)),
        "_seed": F.expr(f"CASE WHEN {power} THEN old_root ELSE get(path, 0) END"),
        "_rest": F.expr(f"CASE WHEN {power} THEN path ELSE slice(path, 2, greatest(size(path) - 1, 0)) END")})
    grown = (f"size(_rest) = size(_sides) AND {_climb('_seed', '_rest', '_sides', True)} = old_root "
             f"AND {_climb('_seed', '_rest', '_sides', False)} = root")
    good = f"CASE WHEN old <= 0 OR old > size THEN false WHEN old = size THEN size(path) = 0 AND old_root = root ELSE {grown} END"
    return ready.withColumn("consistent", F.expr(f"coalesce({good}, false)")).drop("_sides", "_seed", "_rest")
