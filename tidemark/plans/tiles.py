"""A log of Merkle tiles that grows: written once, extended by new leaves only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merkle import TILE, TILE_ROWS, build_tiles, tile_sizes
from tidemark.sources.ledger import Conflict, Ledger
from tidemark.sources.store import materialise


class TileLog:
    """The tiles of many sources in one table of commits. Full tiles are final; a batch adds tiles and the new state of the last ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.ledger = Ledger(spark, root)

    def tiles(self, upto: int | None = None) -> DataFrame:
        """All tiles, with every state that a last tile has had."""
        return self.ledger.read("tiles", TILE_ROWS, upto=upto)

    def grow(self, leaves: DataFrame, writer: str, batch: int) -> bool:
        """Adds leaves(source_id, idx, leaf) that go on where each source ends; False if the batch is in already.

        Only the tiles that are not full are read. Leaves that leave a gap or repeat a number are refused as a whole.
        """
        while True:
            if self.ledger.applied(writer, batch):
                return False
            version = self.ledger.version()
            known = self.tiles(version)
            ranges = leaves.groupBy("source_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))
            wrong = ranges.join(tile_sizes(known), "source_id", "left").where("lo <> coalesce(size, 0) or hi - lo + 1 <> n").select("source_id").limit(5).collect()
            if wrong:
                raise ValueError(f"leaves do not go on from what is stored: {[r[0] for r in wrong]}")
            made = build_tiles(leaves, materialise(known.where(F.col("n") < TILE), "tiles-open"))
            try:
                return self.ledger.append({"tiles": made}, writer, batch, made_for=version)
            except Conflict:
                continue
