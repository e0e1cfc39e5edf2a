"""Connected components of a table of links: contracted inside slices of links, then joined across slices by star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import materialise

SLICE_LINKS = 500_000


def _contract(batches):
    """Links (a, b) of one slice to (hi, lo): every id of the slice that is not the smallest of its component there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    ids = np.fromiter(root, np.int64, len(root))
    tops = np.fromiter((find(x) for x in ids.tolist()), np.int64, len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[ids != tops]), pa.array(tops[ids != tops])], names=["hi", "lo"])


def _large_star(edges: DataFrame) -> DataFrame:
    # Written, so that the rows of a hub, which may be in most links, can be split among the tasks of the join.
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = materialise(both.groupBy("hi").agg(F.min("lo").alias("least")).withColumn("least", F.least("hi", "least")), "components")
    return both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    turned = edges.join(least, "hi").where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return turned.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct()


def components(links: DataFrame, slice_links: int = SLICE_LINKS) -> DataFrame:
    """id, comp for the ids in written links (a, b); comp is the smallest id of a component, which keeps no row itself.

    A slice of at most about ``slice_links`` links is contracted in one task. With several slices, rounds of large and small
    stars follow: each writes its edges to the shared folder, their number never grows, and the loop ends when a round changes
    nothing, after about log(slices) rounds. Links of a row to itself and repeated links have no effect.
    """
    slices = max(1, -(-links.count() // slice_links))
    dealt = links.coalesce(slices) if slices == 1 else links.repartition(slices)
    edges = materialise(dealt.select("a", "b").mapInArrow(_contract, "hi bigint, lo bigint"), "components")
    before = None
    while slices > 1:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = materialise(_small_star(_large_star(edges)), "components")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("comp"))
