"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: terms (whole words, and stems of five letters) whose share of toxic sample documents is many times
their share of the others. Features are densities of lexicon words and stems, how near they stand to a second-person pronoun,
hits that show only after obfuscation is undone (0 for o, @ for a, letters split by marks), and rates of capitals, marks and
stretched letters. Labels are read for a sample of at most ``max_sample`` rows; nothing but the text enters a score.

Cases: null and empty texts get the score of a text without features; rows that repeat get equal scores; a sample without
both classes gives every row the base rate (0.5 without any label); an empty table gives an empty result; ids without
labels are scored all the same.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Scorer, fit, labelled_sample
from tidemark.llm.common import text_slices, trimmed
from tidemark.sources.store import materialise

MAX_SAMPLE, LEXICON, STEM, NEAR = 20_000, 400, 5, 5
# Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
MARKS = "\"'`.,;:!?()[]{}<>*_-~#%&$@/\\|+=^…“”„«»¿¡"
_UNDO = str.maketrans("013457@$!", "oleastasi")
_DISGUISED = re.compile(r"(?<!\S)\S*[^\W\d_][*._\-@$!0-9]+[^\W\d_]\S*")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_SIGNS = b"!?*#$%&@"
FEATURES = ("length words stems distinct near pronouns disguised masked capitals shouts questions signs stretched").split()


def bare(words: list[str]) -> list[str]:
    return [w.strip(MARKS) for w in words]


def plain(word: str) -> str:
    """A word with common disguises undone."""
    return "".join(c for c in word.translate(_UNDO) if c.isalpha())


@dataclass(frozen=True)
class Lexicon:
    words: frozenset
    stems: frozenset

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        lower = bare(text.lower().split())
        n = max(1, len(lower))
        words = [i for i, w in enumerate(lower) if w in self.words]
        stems = [i for i, w in enumerate(lower) if w[:STEM] in self.stems and len(w) > STEM]
        pronouns = [i for i, w in enumerate(lower) if w in SECOND_PERSON]
        near = sum(1 for i in {*words, *stems} if self._near(pronouns, i)) if pronouns else 0
        masked = [m.strip(MARKS).lower() for m in _DISGUISED.findall(text)]
        disguised = sum(1 for m in masked if m not in self.words and ((p := plain(m)) in self.words or (len(p) > STEM and p[:STEM] in self.stems)))
        raw = text.encode()
        letters = max(1, len(raw) - len(raw.translate(None, _LETTERS)))
        return [math.log1p(len(lower)), 100 * len(words) / n, 100 * len(stems) / n, math.log1p(len({lower[i] for i in words}) + len({lower[i][:STEM] for i in stems})),
                100 * near / n, 100 * len(pronouns) / n, 100 * disguised / n, 100 * len(masked) / n, (len(raw) - len(raw.translate(None, _CAPITALS))) / letters,
                100 * text.count("!") / n, 100 * text.count("?") / n, 100 * (len(raw) - len(raw.translate(None, _SIGNS))) / n,
                100 * sum(1 for _ in _STRETCHED.finditer(text)) / n]

    @staticmethod
    def _near(pronouns: list[int], i: int) -> bool:
        at = bisect_left(pronouns, i - NEAR)
        return at < len(pronouns) and pronouns[at] <= i + NEAR


def learn_lexicon(sample: DataFrame, text_col: str, size: int = LEXICON, least: int = 5, ratio: float = 20.0) -> Lexicon:
    """The ``size`` terms of most weight in a labelled sample; counts are by document."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, 1):
                for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = {w for w in bare((text or "").lower().split()) if w.isalpha()}
                    terms = ["w" + w for w in found] + ["s" + s for s in {w[:STEM] for w in found if len(w) > STEM}]
                    if terms:
                        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([y] * len(terms))], names=["term", "label"])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)
    if not toxic or not clean:
        return Lexicon(frozenset(), frozenset())
    terms = sample.select("label", F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), "term string, label double")
    counts = terms.groupBy("term").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    lift = ((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("good") + 0.5) / (clean + 1))
    best = counts.withColumn("lift", lift).where((F.col("bad") >= least) & (F.col("lift") >= ratio)).orderBy((F.col("bad") * F.ln("lift")).desc(), "term").limit(size)
    chosen = [r["term"] for r in best.collect()]
    return Lexicon(frozenset(t[1:] for t in chosen if t[0] == "w"), frozenset(t[1:] for t in chosen if t[0] == "s"))


def with_features(rows: DataFrame, keep: list[str], lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """keep + features (array of doubles in the order of FEATURES)."""
    fields = [rows.schema[c] for c in keep]
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, whole.num_columns - 1):
                made = [shared.value.features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.float64()))], names=[*keep, "features"])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["features array<double>"])
    return rows.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(trimmed(run), kinds)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    scorer: Scorer

    def score(self, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """keep + score in [0, 1]."""
        return self.scorer.apply(with_features(docs, keep, self.lexicon, text_col), "features", "score").drop("features")


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_sample: int = MAX_SAMPLE) -> ToxicityModel:
    """Learns lexicon, trees and calibration from at most max_sample labelled rows for which ``usable`` holds."""
    chosen = materialise(labelled_sample(labels, id_col, label_col, usable, max_sample).select(F.col(id_col).alias("_id"), "label"), "toxicity-labels")
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).select(F.col("_id"), "label", F.col(text_col).cast("string").alias("text"))
    sample = materialise(rows, "toxicity-sample")
    lexicon = learn_lexicon(sample, "text")
    features = materialise(with_features(sample, ["_id", "label"], lexicon), "toxicity-features")
    return ToxicityModel(lexicon, fit(features, "features", "label", "_id"))
