"""Erasable actor pseudonyms: HMAC-SHA256 under a per-actor salt that lives in a table of its own."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import hmac_hex, pad_keys

SALT_BYTES = 32


@F.pandas_udf(T.BinaryType())
def random_salt(actors: pd.Series) -> pd.Series:
    return pd.Series([os.urandom(SALT_BYTES) for _ in actors])


def new_actors(events: DataFrame, salts: DataFrame) -> DataFrame:
    """Actors that have no salt yet."""
    seen = events.where(F.coalesce("actor", F.lit("")) != "").select("actor").distinct()
    return seen.join(salts.select("actor"), "actor", "left_anti")


def mint_salts(actors: DataFrame, created: str) -> DataFrame:
    """Rows to append to the salt table. Random: write them once and read them back before use."""
    minted = actors.withColumn("salt", random_salt.asNondeterministic()("actor"))
    return with_pseudonyms(minted).select("actor", "salt", "pseudonym", F.lit(created).alias("created"))


def with_pseudonyms(salts: DataFrame) -> DataFrame:
    """One HMAC per actor, not per event."""
    padded = pad_keys(salts)
    return padded.withColumn("pseudonym", hmac_hex(F.col("ipad"), F.col("opad"), F.col("actor"))).drop("ipad", "opad")


def pseudonymise(events: DataFrame, salts: DataFrame) -> DataFrame:
    """Adds ``pseudonym``: null for an actor whose salt is absent or erased."""
    known = with_pseudonyms(salts.select("actor", "salt")).select("actor", "pseudonym")
    return events.join(known, "actor", "left")


def erase(salts: DataFrame, requests: DataFrame) -> DataFrame:
    """The next salt table: records keep their pseudonyms, but nothing can derive them any more."""
    return salts.join(requests.select("actor").distinct(), "actor", "left_anti")
