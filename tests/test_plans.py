"""Plans that must hold when one source owns most rows."""

import re

from pyspark.sql import functions as F

from tidemark.operators.ordered import stitched_lag, stitched_row_number


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_source_stay_split_above_a_join(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("source_id"),
                                        F.col("id").alias("seq"), F.col("id").alias("v"))
        bad = spark.createDataFrame([("20",)], "source_id string")
        joined = rows.join(bad, "source_id", "left_anti")
        for made in (stitched_lag(joined, ["source_id"], "seq", ["v"], 100), stitched_row_number(joined, ["source_id"], "seq", "n", 100)):
            plan = plan_of(made)
            assert "SortMergeJoin" in plan
            windows = re.findall(r"windowspecdefinition\(source_id#\d+, _block#\d+L, [^\n]*\n(?:[^\n]*Sort[^\n]*\n)?([^\n]*)", plan)
            assert windows and all("Exchange hashpartitioning(source_id" in w and "_block" in w for w in windows), plan
            assert made.count() == 999
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
