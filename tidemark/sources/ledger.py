"""Tables that jobs add to or merge into, with one commit record per change.

A change is written first, as Parquet in a folder of its own, and counts from the moment its record ``commits/<n>`` exists.
A record is published by a rename that never overwrites, so of two jobs that want the same number one has to look again,
and a job that dies before its rename leaves files that nobody reads. A record names its writer and batch: a batch that is
there already is not applied again, so a job or a micro-batch can simply be repeated.

Records are a few hundred bytes and are listed by the driver: one per batch, whatever the size of the batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another job has committed since the version that a change was made for."""


@dataclass(frozen=True)
class Commit:
    version: int
    writer: str
    batch: int
    parts: dict[str, str] = field(default_factory=dict)  # name -> folder


class _Records:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._read = jvm.org.apache.commons.io.IOUtils.toString
        self._charset = jvm.java.nio.charset.StandardCharsets.UTF_8
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for name in ("commits", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    def commits(self, since: int = 0) -> list[Commit]:
        """All commits after a version, in order."""
        found = []
        for status in self._fs.listStatus(self._path(f"{self.root}/commits")):
            name = status.getPath().getName()
            if name.isdigit() and int(name) > since:
                stream = self._fs.open(status.getPath())
                try:
                    found.append(Commit(version=int(name), **json.loads(self._read(stream, self._charset))))
                finally:
                    stream.close()
        return sorted(found, key=lambda c: c.version)

    def publish(self, commit: Commit) -> bool:
        """False if the version is taken."""
        made = self._path(f"{self.root}/data/{uuid.uuid4().hex}.json")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps({"writer": commit.writer, "batch": commit.batch, "parts": commit.parts}).encode()))
        out.close()
        try:
            self._context.rename(made, self._path(f"{self.root}/commits/{commit.version:020d}"), self._no_options)
        except Exception as problem:
            if "FileAlreadyExistsException" not in str(problem):
                raise
            self._fs.delete(made, False)
            return False
        return True

    def store(self, name: str, rows: DataFrame) -> str:
        target = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(target)
        return target


class Ledger(_Records):
    """Append-only tables, one per part name, that grow together: a commit adds to all of them or to none."""

    def version(self) -> int:
        return max((c.version for c in self.commits()), default=0)

    def applied(self, writer: str, batch: int) -> Commit | None:
        return next((c for c in self.commits() if c.writer == writer and c.batch == batch), None)

    def append(self, parts: dict[str, DataFrame], writer: str, batch: int, made_for: int | None = None) -> bool:
        """Adds rows; False if this batch is in already. With ``made_for`` raises Conflict if the version has moved on since."""
        if self.applied(writer, batch):
            return False
        stored = {name: self.store(name, rows) for name, rows in parts.items()}
        while True:
            there = self.commits()
            if any(c.writer == writer and c.batch == batch for c in there):
                return False
            version = max((c.version for c in there), default=0)
            if made_for is not None and version != made_for:
                raise Conflict(f"made for version {made_for}, found {version}")
            if self.publish(Commit(version + 1, writer, batch, stored)):
                return True

    def read(self, part: str, schema: str, only: Commit | None = None, upto: int | None = None) -> DataFrame:
        commits = [only] if only else [c for c in self.commits() if upto is None or c.version <= upto]
        paths = [c.parts[part] for c in commits if part in c.parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


class Snapshots(_Records):
    """A table of one row per key that is merged: a commit is a whole new snapshot, and the last commit counts.

    A change reads the last snapshot and gives the next one. If another job commits meanwhile, it is computed again on what
    that job has left, so merges apply one after the other. Snapshots before the last ``keep`` are removed.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keep: int = 8):
        super().__init__(spark, root)
        self.schema, self.keep = schema, keep

    def current(self) -> DataFrame:
        return self._at(self.commits())

    def _at(self, commits: list[Commit]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(commits[-1].parts["rows"]) if commits else self.spark.createDataFrame([], self.schema)

    def merge(self, change: Callable[[DataFrame], dict[str, DataFrame]], writer: str, batch: int) -> Commit:
        """The commit of a change, which gives ``rows``, the next snapshot, and may give further parts, such as receipts.

        If this batch is in already, its commit as it was.
        """
        while True:
            there = self.commits()
            done = next((c for c in there if c.writer == writer and c.batch == batch), None)
            if done:
                return done
            made = change(self._at(there))
            made["rows"] = made["rows"].select(*self.spark.createDataFrame([], self.schema).columns)
            parts = {name: self.store(name, rows) for name, rows in made.items()}
            commit = Commit((there[-1].version if there else 0) + 1, writer, batch, parts)
            if self.publish(commit):
                for old in there[:-self.keep]:
                    self._fs.delete(self._path(old.parts["rows"]), True)
                return commit
            for path in parts.values():
                self._fs.delete(self._path(path), True)

    def purge(self) -> None:
        """Removes all snapshots but the last one, where what a change took out must be gone."""
        for old in self.commits()[:-1]:
            self._fs.delete(self._path(old.parts["rows"]), True)

    def part(self, commit: Commit, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(commit.parts[name])
