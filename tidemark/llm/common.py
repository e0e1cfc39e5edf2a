"""What the operators share: table access, word rules, and broadcasts behind a size check."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare
from tidemark.sources.store import materialise

# White space of the word rule: words are [^\x20\x09-\x0D]+, which is what bytes.split() gives in Python.
SPACE = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 8 << 20
# Rows of an Arrow batch; documents are long, so the default of 10,000 would be tens of megabytes and more.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Ships the package to the workers and bounds the Arrow batches of document rows."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def text_of(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def stored_small(df: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Writes df and hints a broadcast only if its counted rows stay within max_rows; else joins shuffle it."""
    kept = materialise(df, label)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str, label: str, max_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows whose id is in ids (one column). Rows with a null id stay."""
    gone = stored_small(ids.select(F.col(ids.columns[0]).alias("_gone")).where("_gone is not null").distinct(), label, max_rows)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def trimmed(run):
    """A function over Arrow batches that gives its memory back to the system at the end: workers are kept, and there are several."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's only
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES):
    """A batch in row ranges whose texts come to at most ``most`` bytes, or of one row."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8 (bytes.lower and bytes.split know ASCII only)."""
    return text.encode().lower().split() if text else []


def remainder_of_five(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
