"""Evidence bundles: record filter, manifest facts, writing, and offline re-verification."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import running_in_blocks, stitched_running
from tidemark.sources.store import mounted

WHOLE_SOURCE = "none (whole source)"
RECORDS_PER_FILE = 200_000
FILE_BYTES = 32 << 20
# What a task reads of a long file, and bytes and rows of a batch that tasks make.
SPLIT_BYTES, BATCH_BYTES, LISTED_ROWS = 64 << 20, 16 << 20, 8192
# Findings that decide a bundle's verdict.
INTEGRITY_IDS = "^F-(CHAIN|FORK|SIG|ANCHOR|RETENTION)"


@dataclass(frozen=True)
class RecordFilter:
    """Bounds are inclusive; 0, None and "" mean no bound. Times are pinned texts and nanoseconds."""

    from_seq: int = 0
    to_seq: int = 0
    from_ns: int | None = None
    to_ns: int | None = None
    actor: str = ""

    def condition(self) -> Column:
        terms = []
        if self.from_seq:
            terms.append(F.col("seq") >= self.from_seq)
        if self.to_seq:
            terms.append(F.col("seq") <= self.to_seq)
        if self.actor:
            terms.append(F.col("actor") == self.actor)
        if self.from_ns is not None:
            terms.append(F.col("time_ns") >= self.from_ns)
        if self.to_ns is not None:
            terms.append(F.col("time_ns") <= self.to_ns)
        # A null time fails a time bound, as it should.
        return F.coalesce(reduce(Column.__and__, terms), F.lit(False)) if terms else F.lit(True)

    def text(self) -> str:
        parts = []
        if self.from_seq or self.to_seq:
            parts.append(f"seq {self.from_seq}..{self.to_seq}")
        if self.from_ns is not None or self.to_ns is not None:
            parts.append(f"event_time {_pinned(self.from_ns)}..{_pinned(self.to_ns)}")
        if self.actor:
            parts.append(f"actor={self.actor}")
        return "; ".join(parts) or WHOLE_SOURCE


def _pinned(ns: int | None) -> str:
    from datetime import datetime, timedelta, timezone

    if ns is None:
        return "0001-01-01T00:00:00.000000000Z"
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=ns // 1_000_000_000)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + f".{ns % 1_000_000_000:09d}Z"


def manifest_facts(records: DataFrame, chosen: RecordFilter) -> DataFrame:
    """One row per source: what the bundle of the filtered records states about itself.

    ``records(source_id, seq, actor, time_ns, record_hash)`` is the whole pulled range.
    """
    keep = chosen.condition()
    kept_seq = F.when(keep, F.col("seq"))
    return records.groupBy("source_id").agg(
        F.count_if(keep).alias("record_count"), F.min(kept_seq).alias("first_seq"), F.max(kept_seq).alias("last_seq"),
        F.min_by("record_hash", kept_seq).alias("first_hash"), F.max_by("record_hash", kept_seq).alias("last_hash"),
        F.max_by("record_hash", "seq").alias("chain_head")).withColumn("filter", F.lit(chosen.text()))


def file_hashes(spark: SparkSession, directory: str) -> DataFrame:
    """(file, sha256) of every file of a bundle but the manifest's own and the writer's success marks.

    Files are named by their path below the bundle, whatever they are called, so that a file slipped in is seen. Spark's
    reader skips names that begin with a dot or an underscore; they are no part of what a reader of the bundle gets.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    root = directory.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_replace(F.element_at(F.split("path", "/" + re.escape(root) + "/"), -1), "^/+", "")
    return files.select(name.alias("file"), F.sha2("content", 256).alias("sha256")).where(~F.col("file").rlike("^manifest(-files)?/"))


def write_bundle(records: DataFrame, chosen: RecordFilter, directory: str, notes: DataFrame | None = None,
                 keys: DataFrame | None = None, receipts: DataFrame | None = None) -> None:
    """Writes one source's bundle: records.jsonl with the exact bytes in seq order, notes, keys, receipts, manifest.

    ``records`` adds record_bytes to what manifest_facts needs. A directory that already holds a bundle is refused.
    """
    spark = records.sparkSession
    kept = records.where(chosen.condition())
    lines = kept.select("seq", F.col("record_bytes").cast("string").alias("value")).repartitionByRange("seq").sortWithinPartitions("seq")
    (lines.select("value").write.mode("errorifexists").option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .text(f"{directory}/records.jsonl"))
    if notes is not None:
        # The writer ends every note's last line, so the note's own final newline is left out.
        (notes.orderBy("pos").select(F.regexp_replace("note", "\n$", "").alias("value")).write
         .text(f"{directory}/checkpoints.txt"))
    if keys is not None:
        keys.write.json(f"{directory}/keys.json")
    if receipts is not None:
        receipts.write.json(f"{directory}/anchors.jsonl")
    file_hashes(spark, directory).write.json(f"{directory}/manifest-files")
    manifest_facts(records, chosen).write.json(f"{directory}/manifest")


# What a folder's name escapes, as Spark's writers do.
_ESCAPED = re.compile('[\x01-\x1f"#%\'*/:=?\\\\\x7f{}\\[\\]^]')


def _folder(column: str, value) -> str:
    text = "" if value is None else str(value)
    return f"{column}=" + (_ESCAPED.sub(lambda m: f"%{ord(m.group()):02X}", text) or "__HIVE_DEFAULT_PARTITION__")


def _file_writer(root: str, folders: list[str]):
    """Sorted rows (value, *folders) to one file per folder of a task; yields (file, sha256) of what was written below a local path.

    A file is written under another name and renamed, so an attempt that is repeated puts the same bytes in the same place.
    """
    def run(batches):
        import hashlib
        import os
        import uuid

        import pyarrow as pa

        base = root.rsplit("/", 1)[-1]
        at, out, made, state, done = None, None, "", None, []

        def close():
            out.close()
            folder = "/".join(_folder(c, v) for c, v in zip(folders, at, strict=True))
            os.replace(made, f"{root}/{folder}/part-00000.txt")
            done.append((f"{base}/{folder}/part-00000.txt", state.hexdigest()))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in folders), strict=True))
            for key, value in zip(keys, batch.column("value").cast(pa.binary()).to_pylist(), strict=True):
                if key != at or out is None:
                    if out is not None:
                        close()
                    folder = "/".join(_folder(c, v) for c, v in zip(folders, key, strict=True))
                    os.makedirs(f"{root}/{folder}", exist_ok=True)
                    at, made, state = key, f"{root}/{folder}/.{uuid.uuid4().hex}", hashlib.sha256()
                    out = open(made, "wb")
                line = (value or b"") + b"\n"
                state.update(line)
                out.write(line)
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done]), pa.array([h for _, h in done])], names=["file", "sha256"])
    return run


def _by_source(rows: DataFrame, order: list[str], path: str) -> DataFrame | None:
    """Text lines (source_id, [file], ..., value) as one file per source and file number, in order; (file, sha256) of them.

    On a file system that is mounted, the tasks open the files themselves: Hadoop's local file system starts a process for every
    folder and file that it makes, and bundles of many sources are mostly small files. Elsewhere Spark writes them at once, and
    they are hashed by reading (None).
    """
    folders = ["source", *(["file"] if "file" in rows.columns else [])]
    dealt = rows.withColumnRenamed("source_id", "source").repartition(*folders).sortWithinPartitions(*folders, *order).select("value", *folders)
    if local := mounted(rows.sparkSession, path):
        return dealt.mapInArrow(_file_writer(local, folders), "file string, sha256 string")
    dealt.write.mode("errorifexists").option("lineSep", "\n").partitionBy(*folders).text(path)
    return None


def write_bundles(records: DataFrame, chosen: RecordFilter, directory: str, notes: DataFrame | None = None, keys: DataFrame | None = None,
                  receipts: DataFrame | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Writes the bundles of many sources at once: records/source=<id>/file=<n>, checkpoints, keys, receipts, manifest.

    ``records`` as for write_bundle; notes(source_id, pos, note), keys and receipts have a source_id each. Records are cut into
    files of about ``file_bytes`` along their numbers, so a source of any size is written by many tasks, and each file can be
    hashed by one. A directory that already holds bundles is refused.
    """
    spark = records.sparkSession
    size = (F.octet_length("record_bytes") + 1).cast("bigint")
    kept = records.where(chosen.condition()).select("source_id", "seq", F.col("record_bytes").cast("string").alias("value"), size.alias("size"))
    placed = stitched_running(kept, ["source_id"], "seq", "ahead", F.col("size"), "sum", False)
    # Claims the folder, and refuses one that is there.
    spark.range(0).write.mode("errorifexists").json(f"{directory}/manifest-claim")
    written = [_by_source(placed.withColumn("file", F.call_function("div", F.col("ahead"), F.lit(file_bytes).cast("bigint"))), ["seq"], f"{directory}/records")]
    if notes is not None:
        # The writer ends every note's last line, so the note's own final newline is left out.
        written.append(_by_source(notes.select("source_id", "pos", F.regexp_replace("note", "\n$", "").alias("value")), ["pos"], f"{directory}/checkpoints"))
    for name, rows in (("keys", keys), ("anchors", receipts)):
        if rows is not None:
            lines = rows.select("source_id", F.to_json(F.struct(*[c for c in rows.columns if c != "source_id"])).alias("value"))
            written.append(_by_source(lines, ["value"], f"{directory}/{name}"))
    listed = digests(spark, directory) if None in written else _with_source(reduce(DataFrame.unionByName, written))
    listed.write.json(f"{directory}/manifest-files")
    manifest_facts(records, chosen).write.json(f"{directory}/manifest")


def _below(path: Column, directory: str) -> Column:
    root = directory.rstrip("/").rsplit("/", 1)[-1]
    return F.regexp_replace(F.element_at(F.split(path, "/" + re.escape(root) + "/"), -1), "^/+", "")


def _unescaped(name: str) -> Column:
    """Names of folders, and paths of the reader, escape by percent signs alone."""
    return F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))


def _hash_lines(batches):
    """Lines (file, size, split, row, value) in order to (file, sha256); a file need not end with a newline."""
    import hashlib

    import pyarrow as pa

    at, state, left = None, None, 0
    done: list[tuple[str, str]] = []
    for batch in batches:
        for file, size, value in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if file != at:
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state, left = file, hashlib.sha256(), size
            line = value + b"\n"
            state.update(line[:left])
            left -= len(line)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done]), pa.array([h for _, h in done])], names=["file", "sha256"])
            done = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], names=["file", "sha256"])


def _seen(name: str) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    marked = name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
    return not (marked or name.startswith(".") or name.endswith("._COPYING_"))


def _lister(deep: bool):
    """Folders (path) to what is in them, or with ``deep`` to the files below; files (path, size) stay as they are."""
    def run(batches):
        import os

        import pyarrow as pa

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

        paths, sizes = [], []
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                folders = []
                if size is None:
                    folders.append(path)
                else:
                    paths.append(path)
                    sizes.append(size)
                while folders:
                    with os.scandir(folders.pop()) as found:
                        for x in found:
                            if not _seen(x.name):
                                continue
                            folder = x.is_dir()
                            if folder and deep:
                                folders.append(x.path)
                                continue
                            paths.append(x.path)
                            sizes.append(None if folder else x.stat().st_size)
                            if len(paths) >= LISTED_ROWS:
                                yield packed()
                                paths, sizes = [], []
        if paths:
            yield packed()
    return run


def _tasks(spark: SparkSession) -> int:
    # Stated, so that small rows that stand for much work are not put together.
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _found(spark: SparkSession, local: str) -> DataFrame:
    """(path, size) of the files below a mounted folder. Tasks list them, as the driver cannot hold those of many sources."""
    level = spark.createDataFrame([(local.rstrip("/"), None)], "path string, size bigint").mapInArrow(_lister(False), "path string, size bigint")
    for deep in (False, False, True):
        level = level.repartition(_tasks(spark), "path").mapInArrow(_lister(deep), "path string, size bigint")
    return level.where("size > 0")


def _hash_files(root: str):
    """Files (path) to (file, sha256), with names below ``root``; no task holds a file."""
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            paths, hashes = batch.column("path").to_pylist(), []
            for path in paths:
                with open(path, "rb") as f:
                    hashes.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([x[len(root) + 1:] for x in paths], pa.string()), pa.array(hashes, pa.string())], names=["file", "sha256"])
    return run


def _read_lines(root: str, width: int):
    """Parts of files (path, size, split), ``width`` bytes each, to their lines with their place; a line belongs to the part where it begins."""
    def run(batches):
        from urllib.parse import unquote

        import pyarrow as pa

        def packed():
            values = pa.array([x[-1] for x in rows], pa.binary())
            # Bytes as they are, whether they are UTF-8 or not, as Spark's reader has them.
            text = pa.Array.from_buffers(pa.string(), len(values), values.buffers())
            columns = zip(*(x[:-1] for x in rows), strict=True)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), text], names=["source_id", "file", "path", "split", "row", "value"])

        rows, held = [], 0
        for batch in batches:
            for path, size, split in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "split")), strict=True):
                names = dict(x.split("=", 1) for x in path[len(root) + 1:].split("/")[:-1] if "=" in x)
                source, file = (None if x is None or x == "__HIVE_DEFAULT_PARTITION__" else unquote(x) for x in (names.get("source"), names.get("file")))
                with open(path, "rb") as f:
                    if split:
                        f.seek(split - 1)
                        f.readline()
                    at, stop, row = f.tell(), min(split + width, size), 0
                    while at < stop and (line := f.readline()):
                        at += len(line)
                        row += 1
                        rows.append((source, file, path, split, row, line.removesuffix(b"\n")))
                        held += len(line)
                        if len(rows) >= LISTED_ROWS or held >= BATCH_BYTES:
                            yield packed()
                            rows, held = [], 0
        if rows:
            yield packed()
    return run


def digests(spark: SparkSession, directory: str, whole_bytes: int = 4 * FILE_BYTES) -> DataFrame:
    """(source_id, file, sha256) of every file below a directory of bundles but the manifests.

    On a mounted file system tasks list and read the files. Elsewhere files up to ``whole_bytes`` are hashed as they are; longer
    ones, which another writer has made, are streamed line by line through one task each, so that no task ever holds a file.
    """
    if local := mounted(spark, directory):
        found = _found(spark, local).mapInArrow(_hash_files(local.rstrip("/")), "file string, sha256 string")
        return _with_source(found.where(~F.col("file").rlike("^manifest(-files|-claim)?/")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    found = files.where(F.col("length") <= whole_bytes).select(_below(F.col("path"), directory).alias("file"), F.sha2("content", 256).alias("sha256"))
    # A second listing of the folder only where there is a long file to stream.
    if not files.where(F.col("length") > whole_bytes).select("length").isEmpty():
        found = found.unionByName(_streamed(spark, directory, whole_bytes))
    return _with_source(found.where(~F.col("file").rlike("^manifest(-files|-claim)?/")))


def _streamed(spark: SparkSession, directory: str, whole_bytes: int) -> DataFrame:
    """(file, sha256) of the files longer than ``whole_bytes``."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(directory).where(F.col("_metadata.file_size") > whole_bytes).select(
        _below(_unescaped("_metadata.file_path"), directory).alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"))
    return lines.repartition("file").sortWithinPartitions("file", "split", "row").mapInArrow(_hash_lines, "file string, sha256 string")


def _with_source(found: DataFrame) -> DataFrame:
    return found.withColumn("source_id", F.regexp_extract("file", "/source=([^/]*)/", 1)).select(_unescaped("source_id").alias("source_id"), "file", "sha256")


def source_lines(spark: SparkSession, path: str, cut: bool, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of a part of bundles with their place: (source_id, ordinal from 1, value). Records are ``cut`` into files.

    On a mounted file system tasks list the files and read them, long ones by ``split_bytes``.
    """
    file = F.col("file").cast("bigint") if cut else F.lit(0).cast("bigint")
    if local := mounted(spark, path):
        parts = _found(spark, local).withColumn("split", F.expr(f"explode(sequence(0L, size - 1, {split_bytes}L))")).repartition(_tasks(spark), "path", "split")
        read = parts.mapInArrow(_read_lines(local.rstrip("/"), split_bytes), "source_id string, file string, path string, split bigint, row bigint, value string")
        lines = read.withColumn("file", file)
        return running_in_blocks(lines, ["source_id"], ["file", "path", "split"], ["row"], "ordinal", F.lit(1).cast("bigint")).select("source_id", "ordinal", "value")
    read = spark.read.option("lineSep", "\n").schema("value string, source string" + (", file string" if cut else "")).text(path)
    lines = read.select(F.col("source").alias("source_id"), file.alias("file"), F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    return running_in_blocks(lines, ["source_id"], ["file", "path", "split"], ["row"], "ordinal", F.lit(1).cast("bigint")).select("source_id", "ordinal", "value")


def read_manifest(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    facts = spark.read.schema(
        "source_id string, record_count bigint, first_seq bigint, last_seq bigint, first_hash string, last_hash string, "
        "chain_head string, filter string").json(f"{directory}/manifest")
    return facts, spark.read.schema("file string, sha256 string").json(f"{directory}/manifest-files")


def compare_files(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Status of every file: ok, mismatch, missing, unlisted."""
    joined = listed.withColumnRenamed("sha256", "_want").join(present.withColumnRenamed("sha256", "_have"), "file", "full_outer")
    status = (F.when(F.col("_have").isNull(), F.lit("missing")).when(F.col("_want").isNull(), F.lit("unlisted"))
              .when(F.col("_have") != F.col("_want"), F.lit("mismatch")).otherwise(F.lit("ok")))
    return joined.select("file", status.alias("status"))


def compare_records(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Mismatches between recomputed facts and the manifest, per source, as text (empty when they agree)."""
    f = found.select("source_id", *[F.col(c).alias(f"_{c}") for c in ("record_count", "first_seq", "last_seq", "first_hash", "last_hash")])
    joined = manifest.join(f, "source_id", "left").withColumn("_record_count", F.coalesce("_record_count", F.lit(0)))

    def differs(name: str, label: str, show: bool) -> Column:
        text = F.concat(F.lit(f"{label} "), F.col(f"_{name}").cast("string"), F.lit(" != manifest "), F.col(name).cast("string")) if show \
            else F.lit(f"{label} mismatch")
        return F.when(~F.col(f"_{name}").eqNullSafe(F.col(name)), text)

    some = F.col("_record_count") > 0
    parts = [differs("record_count", "record_count", True), F.when(some, differs("first_seq", "first_seq", True)),
             F.when(some, differs("last_seq", "last_seq", True)), F.when(some, differs("first_hash", "first_record_sha256", False)),
             F.when(some, differs("last_hash", "last_record_sha256", False))]
    return joined.select("source_id", F.concat_ws("; ", *parts).alias("mismatches"))
