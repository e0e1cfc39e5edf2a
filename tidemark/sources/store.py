"""Tables written to the shared folder: the cut between an expensive pass and the analyses that share it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_path


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df once as Parquet and returns the table read back. Survives lost executors and prunes columns."""
    spark = df.sparkSession
    target = path or scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The local path of what lies on a file system that is mounted, which tasks can open themselves; None elsewhere."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    return target.toUri().getPath() if there else None
