"""Boosted trees with isotonic calibration on a bounded labelled sample, and their use on any number of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, usable: Column, max_rows: int) -> DataFrame:
    """id, label of at most max_rows usable rows, those with the least hash of the id; a repeated id counts once."""
    once = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("label"))
    return once.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)


@dataclass
class Scorer:
    """trees and calibration, or the base rate alone where the sample has one class only."""

    base: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def apply(self, rows: DataFrame, features: str, out: str) -> DataFrame:
        """Adds ``out``, the calibrated probability; a hundredth of it is the uncalibrated one, to order ties."""
        if self.trees is None:
            return rows.withColumn(out, F.lit(self.base))
        scored = self.trees.transform(rows.withColumn("_vector", array_to_vector(features))).withColumn("_raw", vector_to_array("_chance")[1])
        scored = self.calibration.transform(scored)
        return scored.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("_calibrated") + 0.01 * F.col("_raw")))).drop(
            "_vector", "_margin", "_chance", "_class", "_raw", "_calibrated")


def fit(sample: DataFrame, features: str, label: str, id_col: str, trees: int = 20, depth: int = 4) -> Scorer:
    """Trees are fitted on three quarters of the sample by hash of the id, the calibration on the last quarter."""
    rows = sample.select(id_col, array_to_vector(features).alias("_vector"), F.col(label).alias("label"))
    part = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(4))
    grown, rest = rows.where(part != 0), rows.where(part == 0)
    counts = {(r["rest"], r["label"]): r["n"] for r in rows.groupBy((part == 0).alias("rest"), "label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    base = sum(n for (_, y), n in counts.items() if y == 1.0) / total if total else 0.5
    if len(counts) < 4:
        return Scorer(base)
    learner = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_class", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7,
                            minInstancesPerNode=5)
    model = learner.setProbabilityCol("_chance").setRawPredictionCol("_margin").fit(grown)
    margins = model.transform(rest).withColumn("_raw", vector_to_array("_chance")[1])
    return Scorer(base, model, IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated").fit(margins))
