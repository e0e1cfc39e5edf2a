"""Quality by hierarchical empirical Bayes: a document's own evidence and the record of its host and path.

Evidence is a calibrated classifier over dense features of the text (boosted trees on a bounded labelled sample). Sites are
grouped aggregates over all documents: labelled ones count as they are, unlabelled ones by their evidence with a weight of
``soft``. The global rate is the prior of hosts, a host's posterior the prior of its paths; the strength of each prior comes
from the spread between its groups (method of moments), so sparse sites shrink towards what stands above them. The score adds
the log odds of the evidence and of the path, less those of the global rate, which both contain.

Cases: null and empty texts have the features of an empty text; a null host or path is a site of its own; rows that repeat
count as often as they stand there; a label that repeats counts once; without labels of both classes the evidence is the
base rate; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import fit, labelled_sample
from tidemark.llm.common import text_slices
from tidemark.sources.store import materialise

MAX_SAMPLE, SOFT = 20_000, 0.2
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_SIGNS = b"!?*#$%&@|^~"
_STOPS = b".,;:"
_DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.lower().split()
    n, size = max(1, len(words)), max(1, len(raw))
    letters = max(1, size - len(raw.translate(None, _LETTERS)))
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    return [math.log1p(len(words)), len(raw) / n, len(set(words)) / n, sum(1 for a, b in zip(words, words[1:]) if a == b) / n,
            (len(raw) - len(raw.translate(None, _CAPITALS))) / letters, share(_SIGNS), share(_STOPS), share(_DIGITS), share(b"|"),
            1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines))]


def with_features(rows: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    fields = [rows.schema[c] for c in keep]

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, whole.num_columns - 1):
                made = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.float64()))], names=[*keep, "features"])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["features array<double>"])
    return rows.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, kinds)


def _odds(p: Column) -> Column:
    held = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.ln(held / (1 - held))


def _strength(groups: DataFrame, n: str, good: str, prior: Column) -> float:
    """Observations that the prior is worth: from the variance between groups beyond that of sampling."""
    rate = F.col(good) / F.col(n)
    m = groups.where(F.col(n) > 0).agg(
        F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * (rate - prior) ** 2).alias("spread"), F.sum(F.col(n) * prior * (1 - prior)).alias("noise")).first()
    if not m["n"]:
        return 1.0
    noise = m["noise"] / m["n"]
    between = max(1e-6, m["spread"] / m["n"] - noise * m["k"] / m["n"])
    return min(1e6, max(1.0, noise / between - 1))


def site_posteriors(evidence: DataFrame, soft: float = SOFT) -> tuple[DataFrame, float]:
    """host, path, host_n, path_n, host_rate, path_rate, and the global rate; evidence has host, path, label, evidence."""
    weight = F.when(F.col("label").isNotNull(), F.lit(1.0)).otherwise(F.lit(soft))
    paths = materialise(evidence.groupBy("host", "path").agg(
        F.sum(weight).alias("path_n"), F.sum(weight * F.coalesce("label", "evidence")).alias("path_good")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good"))
    total = paths.agg(F.sum("path_good") / F.sum("path_n")).first()[0]
    total = 0.5 if total is None else float(total)
    a = _strength(hosts, "host_n", "host_good", F.lit(total))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + a * total) / (F.col("host_n") + a))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    b = _strength(joined, "path_n", "path_good", F.col("host_rate"))
    rated = joined.withColumn("path_rate", (F.col("path_good") + b * F.col("host_rate")) / (F.col("path_n") + b))
    return materialise(rated.select("host", "path", "host_n", "path_n", "host_rate", "path_rate"), "quality-sites"), total


def classify(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, host: Column, path: Column, label_col: str = "quality",
             max_sample: int = MAX_SAMPLE, soft: float = SOFT, keep_at: float = 0.5) -> DataFrame:
    """id, host, path, evidence, host_rate, path_rate, score, keep of every row; labels count only where ``usable`` holds."""
    chosen = materialise(labelled_sample(labels, id_col, label_col, usable, max_sample).select(F.col(id_col).alias("_id"), "label"), "quality-labels")
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).select("_id", "label", F.col(text_col).cast("string").alias("text"))
    scorer = fit(materialise(with_features(rows, ["_id", "label"], "text"), "quality-sample"), "features", "label", "_id")
    named = docs.select(F.col(id_col).alias("_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = scorer.apply(with_features(named, ["_id", "host", "path"], "text"), "features", "evidence").drop("features")
    known = labels.where(usable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    evidence = materialise(scored.join(known, "_id", "left"), "quality-evidence")
    sites, total = site_posteriors(evidence, soft)
    joined = evidence.join(sites.withColumnsRenamed({"host": "s_host", "path": "s_path"}),
                           F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")), "left")
    odds = _odds(F.col("evidence")) + _odds(F.col("path_rate")) - _odds(F.lit(total))
    score = 1 / (1 + F.exp(-odds))
    return joined.select(F.col("_id").alias(id_col), "host", "path", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= keep_at).alias("keep"))
