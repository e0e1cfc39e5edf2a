"""State tables that several runs share: accepted checkpoint heads, and salts that are minted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import checkpoints as cps
from tidemark.operators import pseudonyms as ps
from tidemark.sources.ledger import Snapshots
from tidemark.sources.store import materialise

HEAD_ROWS = "origin string, size bigint, root binary, pos bigint"
VERDICT_ROWS = "origin string, pos bigint, size bigint, root binary, status string"
SALT_ROWS = "actor string, salt binary, pseudonym string, created string"
_BEFORE_ALL = -(1 << 62)


class Heads:
    """The accepted head of every origin, over any number of runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = Snapshots(spark, root, HEAD_ROWS)

    def current(self) -> DataFrame:
        return self.table.current()

    def accept(self, submitted: DataFrame, writer: str, batch: int) -> DataFrame:
        """Judges submissions (origin, pos, size, root) against the stored heads, in receipt order, and stores what they leave.

        Returns the verdicts (VERDICT_ROWS). A batch that is in already is not judged again; its verdicts are read back.
        """
        def change(stored: DataFrame) -> dict[str, DataFrame]:
            rows = submitted.select("origin", "pos", "size", "root")
            # A stored head is the submission before all others of its origin.
            known = stored.select("origin", F.lit(_BEFORE_ALL).alias("pos"), "size", "root")
            judged = materialise(cps.judge_submissions(known.unionByName(rows)).select("origin", "pos", "size", "root", "status"), "heads-judged")
            new = cps.heads(judged.where((F.col("status") == "accepted") & (F.col("pos") != _BEFORE_ALL)))
            grown = stored.unionByName(new).groupBy("origin").agg(F.max_by(F.struct("size", "root", "pos"), "size").alias("h"))
            return {"rows": grown.select("origin", "h.*"), "verdicts": judged.where(F.col("pos") != _BEFORE_ALL)}

        return self.table.part(self.table.merge(change, writer, batch), "verdicts", VERDICT_ROWS)


class Salts:
    """One salt per actor, drawn once. A salt counts when it is stored: who comes later, or again, reads the stored one."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = Snapshots(spark, root, SALT_ROWS)

    def current(self) -> DataFrame:
        return self.table.current()

    def mint(self, events: DataFrame, created: str, writer: str, batch: int) -> DataFrame:
        """The salt table with a salt for each actor of the events. A run that dies before its commit leaves no salt behind."""
        def change(stored: DataFrame) -> dict[str, DataFrame]:
            # Written once: a random column that is computed twice would differ.
            minted = materialise(ps.mint_salts(ps.new_actors(events, stored), created), "salts-minted")
            return {"rows": stored.unionByName(minted)}

        self.table.merge(change, writer, batch)
        return self.current()

    def erase(self, requests: DataFrame, writer: str, batch: int) -> DataFrame:
        """Removes the salts of the actors in requests, from all snapshots."""
        self.table.merge(lambda stored: {"rows": ps.erase(stored, requests)}, writer, batch)
        self.table.purge()
        return self.current()
