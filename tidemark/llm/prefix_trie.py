"""Trie of conversation prefixes: ROLLUP over positional turn columns counts all prefixes together.

A conversation is cut into blocks of ``WIDTH`` turns. A block is one row: the block's number, the key of the node that the
block before ended in, and one column per turn. One ``GROUP BY block, prior, ROLLUP (t0, ..., t7)`` gives every prefix of
every conversation with its members; grouping_id tells how many columns a row keeps, hence its depth.

The key of a node is its depth and the XOR of two 64-bit hashes per turn, taken from the SHA-256 of role and text and from
the turn's position. An XOR can be carried across blocks by windows and summaries, so a block knows the node before it
without waiting for that node's round: all blocks of all conversations go through one ROLLUP, however long the longest is.

What a node says about its subtree needs no walk. Let c be a member; from the depth f(c) on it is the smallest member of its
nodes (the representative), so nodes are (representative, depth), and the nodes below v are, for each member of v, the part
of its path from f(c) on. A first ROLLUP gives f(c); a second one sums what each member brings in.

Orders and hot groups: positions come from range partitions and summaries, running XORs from blocks of blocks, so a
conversation with a third of all turns is never in one task. Aggregates combine before the shuffle; joins shuffle both
sides, so that Spark can split hot keys. The ids that end in a node are written out as texts by ranges of ids in parallel;
only the SHA-256 over a node's texts is sequential, as its definition asks, and it streams.

Cases: null turns sort first, turns of equal number by role and text digest; null role or text is empty; rows without
conv_id are left out; repeated rows are turns of their own; further columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running_in_blocks, sliced
from tidemark.sources.store import materialise

WIDTH = 8  # turns of a block
LONGEST_SHARE = 9  # a conversation takes over 0 to 8 turns
_SLOTS = [f"t{i}" for i in range(WIDTH)]
_RUN = 4096  # blocks of a window, and ids of a piece of text


def positions(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos (from 1), digest (of role and text), n (UTF-8 bytes of the text)."""
    who, said = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("turn"), F.octet_length(said).cast("bigint").alias("n"),
        F.unhex(F.sha2(F.concat(F.length(who), F.lit(":"), who, said), 256)).alias("digest"))
    dealt = materialise(sliced(rows, ["c"], ["turn", "digest"]), "trie-turns")
    return running_in_blocks(dealt, ["c"], ["_slice"], ["turn", "digest"], "pos", F.lit(1).cast("bigint")).select("c", "pos", "digest", "n")


def with_shared_openings(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, pos, digest, n) and all conversations (c): the first h turns of conversation c - c % 5, then the own ones after h."""
    convs = placed.groupBy("c").agg(F.max("pos").alias("own")).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % LONGEST_SHARE)
    convs = materialise(convs.withColumn("donor", F.col("c") - F.col("c") % 5), "trie-convs")
    lengths = convs.select(F.col("c").alias("donor"), F.col("own").alias("there"))
    taken = convs.join(lengths, "donor", "left").select("c", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k"))
    given = placed.where(f"pos < {LONGEST_SHARE} and c % 5 = 0").withColumnRenamed("c", "donor")
    opening = convs.select("c", "h", "donor").join(given, "donor").where("pos <= h").select("c", "pos", "digest", "n")
    rest = placed.join(taken, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "n")
    return opening.unionByName(rest), convs.select("c")


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x.bitwiseXOR(y), columns)


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """c, block, prior (a, b, n of all turns before), t0..t7 (a, b, n of a turn), and the conversation's len, total, end_a, end_b.

    A conversation without turns has one row without turns.
    """
    at = F.col("pos") - 1
    rows = turns.select("c", F.call_function("div", at, F.lit(WIDTH)).alias("block"), (at % WIDTH).alias("slot"), "n",
                        F.xxhash64("pos", "digest").alias("a"), F.xxhash64("digest", F.lit(1), "pos").alias("b"))
    wide = [F.max(F.when(F.col("slot") == i, F.col(x))).alias(f"{x}{i}") for i in range(WIDTH) for x in ("a", "b", "n")]
    held = rows.groupBy("c", "block").agg(*wide, F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("n").alias("xn"), F.count("*").alias("turns"))
    held = materialise(held.withColumn("run", F.call_function("div", F.col("block"), F.lit(_RUN))), "trie-blocks")
    sums = [F.bit_xor("xa").alias("sa"), F.bit_xor("xb").alias("sb"), F.sum("xn").alias("sn")]
    runs = held.groupBy("c", "run").agg(*sums, F.sum("turns").alias("st"))
    across = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = runs.groupBy("c").agg(F.bit_xor("sa").alias("end_a"), F.bit_xor("sb").alias("end_b"), F.sum("sn").alias("total"), F.sum("st").alias("len"))
    runs = runs.select("c", "run", F.bit_xor("sa").over(across).alias("ra"), F.bit_xor("sb").over(across).alias("rb"), F.sum("sn").over(across).alias("rn"))
    inside = Window.partitionBy("c", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    carried = held.withColumns({"la": F.bit_xor("xa").over(inside), "lb": F.bit_xor("xb").over(inside), "ln": F.sum("xn").over(inside)}).join(runs, ["c", "run"])
    prior = [F.coalesce("la", none).bitwiseXOR(F.coalesce("ra", none)).alias("pa"), F.coalesce("lb", none).bitwiseXOR(F.coalesce("rb", none)).alias("pb"),
             (F.coalesce("ln", none) + F.coalesce("rn", none)).alias("pn")]
    slots = [F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"n{i}").alias("n"))).alias(f"t{i}")
             for i in range(WIDTH)]
    facts = [F.coalesce(x, none).alias(x) for x in ("len", "total", "end_a", "end_b")]
    about = convs.join(whole, "c", "left").select("c", *facts)
    full = carried.select("c", "block", *prior, *slots).join(about, "c")
    bare = about.where("len = 0").select("c", none.alias("block"), *[none.alias(p) for p in ("pa", "pb", "pn")],
                                         *[F.lit(None).cast("struct<a:bigint,b:bigint,n:bigint>").alias(t) for t in _SLOTS], "len", "total", "end_a", "end_b")
    return materialise(full.unionByName(bare), "trie-rows")


def _rolled(rows: DataFrame, measures: str) -> DataFrame:
    """One row per node: depth, a, b (its key), up_a, up_b (its parent's), before (bytes of the turns above its last), and the measures."""
    slots = ", ".join(_SLOTS)
    rolled = rows.sparkSession.sql(
        f"SELECT block, pa, pb, pn, {slots}, {WIDTH} - bit_count(grouping_id()) AS kept, {measures} FROM {{rows}} GROUP BY block, pa, pb, pn, ROLLUP ({slots})", rows=rows)
    last = F.coalesce(*reversed([F.col(t) for t in _SLOTS]))
    own = reduce(lambda out, i: F.when(F.col("kept") == i + 1, F.col(f"t{i}").isNotNull()).otherwise(out), range(WIDTH), F.col("block") == 0)
    none = F.lit(0).cast("bigint")
    key = {x: _xor([F.col(f"p{x}"), *[F.coalesce(F.col(f"{t}.{x}"), none) for t in _SLOTS]]) for x in ("a", "b")}
    above = reduce(lambda x, y: x + y, [F.col("pn"), *[F.coalesce(F.col(f"{t}.n"), none) for t in _SLOTS]]) - F.coalesce(last["n"], none)
    names = [m.rsplit(" ", 1)[1] for m in measures.split(", ")]
    return rolled.where(own).select(
        (F.col("block") * WIDTH + F.col("kept")).cast("bigint").alias("depth"), key["a"].alias("a"), key["b"].alias("b"),
        key["a"].bitwiseXOR(F.coalesce(last["a"], none)).alias("up_a"), key["b"].bitwiseXOR(F.coalesce(last["b"], none)).alias("up_b"), above.alias("before"), *names)


def _texts(batches):
    """Sorted (depth, a, b, c) to pieces of text: (depth, a, b, first id, ids joined by commas)."""
    key, ids, out = None, [], []
    for batch in batches:
        for *here, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if here != key or len(ids) == _RUN:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = here, []
            ids.append(c)
        if out:
            yield _batch(out, ["depth", "a", "b", "c", "ids"])
            out = []
    if ids:
        yield _batch([(*key, ids[0], ",".join(map(str, ids)))], ["depth", "a", "b", "c", "ids"])


def _digests(batches):
    """Pieces of text, sorted by node and first id, to one SHA-256 per node."""
    key, state, out = None, None, []
    for batch in batches:
        for *here, _, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if here != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = here, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield _batch(out, ["depth", "a", "b", "ends_sha256"])
            out = []
    if key is not None:
        yield _batch([(*key, state.hexdigest())], ["depth", "a", "b", "ends_sha256"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if x in ("ids", "ends_sha256") else pa.int64() for x in names]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def ends(rows: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the nodes in which conversations end."""
    ended = rows.where("block = 0").select(F.col("len").alias("depth"), F.col("end_a").alias("a"), F.col("end_b").alias("b"), "c")
    order = ["depth", "a", "b", "c"]
    key = "depth bigint, a bigint, b bigint"
    pieces = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_texts, f"{key}, c bigint, ids string")
    return pieces.repartition("depth", "a", "b").sortWithinPartitions(*order).mapInArrow(_digests, f"{key}, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes over turns (c, pos from 1 without gaps, digest, n bytes) of the conversations (c)."""
    rows = blocks(turns, convs)
    first = materialise(_rolled(rows, "min(c) AS conv_id, max(len) AS longest"), "trie-first")
    opened = first.groupBy("conv_id").agg(F.min("depth").alias("f"), F.min_by(F.struct("up_a", "up_b", "before"), "depth").alias("at"),
                                          F.max((F.col("longest") == F.col("depth")).cast("bigint")).alias("leaf"))
    about = rows.where("block = 0").select(F.col("c").alias("conv_id"), "len", "total")
    opened = opened.join(about, "conv_id").select("conv_id", "f", "leaf", "len", "total", "at.up_a", "at.up_b", (F.col("total") - F.col("at.before")).alias("brought"))
    above = first.select((F.col("depth") + 1).alias("f"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent"))
    opened = materialise(opened.join(above, ["f", "up_a", "up_b"], "left").drop("up_a", "up_b"), "trie-opened")
    brings = rows.join(opened.select(F.col("conv_id").alias("c"), "brought", "leaf"), "c", "left").fillna(0, ["brought", "leaf"])
    nodes = _rolled(brings, "min(c) AS conv_id, count(*) AS n_convs, sum(total) AS all_bytes, sum(brought) AS new_bytes, sum(leaf) AS n_leaves")
    branches = opened.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(F.count("*").alias("branches"))
    out = (nodes.join(opened.drop("leaf"), "conv_id").join(branches, ["conv_id", "depth"], "left")
           .join(ends(rows), ["depth", "a", "b"], "left"))
    once = F.col("new_bytes") - F.col("brought") + F.col("total") - F.col("before")  # every node of the subtree, counted once
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("f"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("branches", F.lit(0).cast("bigint")) + (F.col("len") > F.col("depth")).cast("bigint")).alias("n_children"), "n_leaves",
        (F.col("all_bytes") - F.col("n_convs") * F.col("before") - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations after each has taken over its opening from another."""
    placed = materialise(positions(conversations), "trie-placed")
    turns, convs = with_shared_openings(placed)
    return trie(turns, convs)


QUERY_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, c - c % 5 AS donor, xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(0, length(c::VARCHAR)),
  lambda i: [ord(substr(c::VARCHAR, i + 1, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, y: xor(xor(s, y) >> 1, 3988292384::UBIGINT * (xor(s, y) & 1)))) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT v.c, 0 AS part, pos, r, x FROM v JOIN t ON t.c = v.donor AND pos <= h UNION ALL SELECT v.c, 1, pos, r, x FROM v JOIN t ON t.c = v.c AND pos > h),
s AS (SELECT v.c, coalesce(l, []) AS l FROM v LEFT JOIN (SELECT c, list({'r': r, 'x': x} ORDER BY part, pos) AS l FROM b GROUP BY c) USING (c)),
p AS (SELECT c, len(l) AS n, d, l[1:d] AS k FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM s)),
g AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(strlen(k[d].x), 0) AS bytes, max(n) = d AS leaf, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY k, d),
m AS (SELECT p.c, p.d, g.conv_id FROM p JOIN g USING (k, d)),
u AS (SELECT DISTINCT x.conv_id, x.d, y.conv_id AS low, y.d AS low_d FROM m x JOIN m y ON x.c = y.c AND y.d >= x.d),
w AS (SELECT u.conv_id, u.d, sum(leaf::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE u.low_d = u.d + 1) AS n_children
  FROM u JOIN g ON g.conv_id = u.low AND g.d = u.low_d GROUP BY u.conv_id, u.d)
SELECT g.conv_id, g.d::BIGINT AS depth, up.conv_id AS parent_conv_id, g.n_convs, w.n_children, w.n_leaves::BIGINT AS n_leaves, w.saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM g JOIN w ON w.conv_id = g.conv_id AND w.d = g.d LEFT JOIN m up ON up.c = g.conv_id AND up.d = g.d - 1"""
