"""Running a stream over what is there now, into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ROCKSDB, scratch_path


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A Parquet folder as a stream; the trigger size bounds what one micro-batch holds."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory lives in RocksDB; the stateful processors here need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(stream: DataFrame, label: str, mode: str = "append", target: str | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """Processes all available input in micro-batches, exactly once, and returns the written table."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    root = scratch_path(spark, f"stream-{label}")
    out = target or f"{root}/out"
    started = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
               .option("checkpointLocation", checkpoint or f"{root}/checkpoint").trigger(availableNow=True).start())
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
