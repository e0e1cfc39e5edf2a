"""A training corpus from documents: five stages, each over all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes the result of
each stage as Parquet to the shared folder and gives it to the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, exact, near_dedup, toxicity
from tidemark.llm.common import ready, remainder_of_five, table
from tidemark.llm.queries import RANKS
from tidemark.sources.store import materialise

TOXIC_AT = 0.5
# A pair at 0.8 falls below the cutoff with a chance under 1e-4.
NEAR = near_dedup.Rules(percent=80, cutoff=0.66)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below TOXIC_AT. The score is learned from the labelled rows of these documents."""
    ready(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder_of_five("doc_id") != 0)
    scored = model.score(docs.select(F.struct("*").alias("doc"), "text"), ["doc"])
    return scored.where(F.col("score") < TOXIC_AT).select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the smallest id."""
    ready(spark)
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, linked from a similarity of 0.8 on, the document of the smallest id."""
    ready(spark)
    return near_dedup.keep_one(docs, rules=NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids (little-endian, 32 bits each), their number and digest, and the digest of the text they decode to."""
    ready(spark)
    coded = bpe.round_trip(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("byte_bpe", tokenize)]
# Learned scores, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = materialise(stage(spark, rows, sf_dir), f"corpus-{name}")
    return rows
