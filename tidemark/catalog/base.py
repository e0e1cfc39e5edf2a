"""Query registration and access to the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare


class Tables:
    """The driver's parquet tables of one scale factor, read lazily."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = prepare(spark)
        self.directory = directory.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.directory}/{name}.parquet"


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where it exists, the SQL that yields the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return register
