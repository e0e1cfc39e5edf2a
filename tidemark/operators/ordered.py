"""Order-dependent work that holds up when one source owns a third of all rows.

A plain ``lag() over (partition by source)`` puts a whole source into one task. Here a source is cut into
blocks along its order value. Windows run inside (source, block); one summary row per block carries state
across the seams. Summaries are reduced by ordinary aggregates, so no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import materialise

BLOCK_WIDTH = 1 << 20
BLOCK = "_block"


def block_of(order: Column, width: int = BLOCK_WIDTH) -> Column:
    """Block number of a unique integer order value: at most ``width`` rows of one key share it."""
    return F.call_function("div", order, F.lit(width).cast("bigint"))


def stitched_lag(df: DataFrame, keys: list[str], order: str, columns: list[str],
                 width: int = BLOCK_WIDTH, prefix: str = "prev_", keep_block: bool = False) -> DataFrame:
    """Adds ``prev_<c>``: the value of c in the preceding row of the same keys.

    ``order`` must be an integer that is unique within the keys. The large side is shuffled once, by
    (keys, block); the seam join reuses that partitioning.
    """
    blocked = df.withColumn(BLOCK, block_of(F.col(order), width))
    tails = [(F.max(c) if c == order else F.max_by(c, order)).alias(f"_tail_{c}") for c in columns]
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    seams = blocked.groupBy(*keys, BLOCK).agg(*tails).select(
        *keys, BLOCK, *[F.lag(f"_tail_{c}").over(across).alias(f"_entry_{c}") for c in columns])
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order)
    local = {f"_local_{c}": F.lag(c).over(inside) for c in columns}
    joined = blocked.withColumns({**local, "_opens": F.row_number().over(inside) == 1}).join(seams, [*keys, BLOCK], "left")
    previous = {f"{prefix}{c}": F.when(F.col("_opens"), F.col(f"_entry_{c}")).otherwise(F.col(f"_local_{c}")) for c in columns}
    return joined.withColumns(previous).drop(*local, "_opens", *[f"_entry_{c}" for c in columns], *([] if keep_block else [BLOCK]))


def stitched_running(df: DataFrame, keys: list[str], order: str, out: str, value: Column, kind: str = "sum",
                     inclusive: bool = True, width: int = BLOCK_WIDTH) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` along ``order`` per keys (exclusive of the row when asked)."""
    blocked = df.withColumn(BLOCK, block_of(F.col(order), width)).withColumn("_value", value)
    return _running(blocked, keys, [BLOCK], [order], out, kind, inclusive).drop(BLOCK)


def running_in_blocks(df: DataFrame, keys: list[str], blocks: list[str], order: list[str], out: str,
                      value: Column, kind: str = "sum", inclusive: bool = True) -> DataFrame:
    """As stitched_running for blocks that already exist as columns, such as file splits."""
    return _running(df.withColumn("_value", value), keys, blocks, order, out, kind, inclusive)


def _running(blocked: DataFrame, keys: list[str], blocks: list[str], order: list[str], out: str, kind: str,
             inclusive: bool) -> DataFrame:
    fold = {"sum": F.sum, "max": F.max}[kind]
    before = Window.partitionBy(*keys).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    seams = (
        blocked.groupBy(*keys, *blocks).agg(fold("_value").alias("_total"))
        .withColumn("_carry", fold("_total").over(before)).drop("_total")
    )
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, *blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    joined = blocked.withColumn("_local", fold("_value").over(inside)).join(seams, [*keys, *blocks], "left")
    if kind == "sum":
        result = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        result = F.greatest("_local", "_carry")
    return joined.withColumn(out, result).drop("_local", "_carry", "_value")


def stitched_row_number(df: DataFrame, keys: list[str], order: str, out: str, width: int = BLOCK_WIDTH) -> DataFrame:
    """Dense 1-based position per keys along a unique integer order value."""
    return stitched_running(df, keys, order, out, F.lit(1).cast("bigint"), "sum", True, width)


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partitions by keys and order and tags each row with its slice.

    For orders with ties or several columns, where no block number can be computed from the values. Slices
    follow the order, so the seams between slices of one key can be ordered by any of their rows.
    """
    return df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_slice", F.spark_partition_id())


def spans_between(points: DataFrame, keys: list[str], time: str, widest: int, width: int = BLOCK_WIDTH) -> DataFrame:
    """Consecutive-time differences that matter: every one above ``widest`` and the largest of each key.

    Points are range-partitioned by key and time, so a key that owns most of them is spread out. A slice keeps the
    differences over ``widest``, its largest one and its ends; what is kept is written, and ends of neighbouring slices meet
    across the seams. Output: start, stop, gap and ``before`` (how many points come before stop); some rows may not matter.
    Slices are cut by the range partitioner, so ``width``, the block width of the other functions here, has no effect.
    """
    dealt = sliced(points.select(*keys, time), keys, [time])
    inside = Window.partitionBy(*keys, "_slice").orderBy(time)
    whole = Window.partitionBy(*keys, "_slice")
    rows = dealt.withColumns({"start": F.lag(time).over(inside), "_rank": F.row_number().over(inside)}).withColumn("gap", F.col(time) - F.col("start"))
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_most": F.max(F.struct("gap", "_rank")).over(whole)})
    kept = materialise(rows.where((F.col("gap") > widest) | (F.col("_rank") == F.col("_most._rank")) | (F.col("_rank") == 1) | (F.col("_rank") == F.col("_n"))).select(
        *keys, "_slice", "start", F.col(time).alias("stop"), "gap", "_rank", "_n"), "spans")
    across = Window.partitionBy(*keys).orderBy("_slice")
    seams = kept.where("_rank = _n").select(*keys, "_slice", F.lag("stop").over(across).alias("_last"),
                                            F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    met = kept.join(seams, [*keys, "_slice"])
    start = F.when(F.col("_rank") == 1, F.col("_last")).otherwise(F.col("start"))
    return met.select(*keys, start.alias("start"), "stop", (F.col("stop") - start).alias("gap"), (F.col("_rank") - 1 + F.col("_ahead")).alias("before"))
