"""Tokenizing, language models, classifiers beside brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import bpe, quality, suffix_tree, toxicity
from tidemark.llm.common import remainder_of_five
from tidemark.llm.queries import RANKS

PATTERN = public_tokenizers.PATTERN
BYTES = bpe.read_ranks(public_tokenizers.path(RANKS))
SMALL = bpe.TreeCodec(BYTES, PATTERN, leaf=9, piece=6)
PIECES = ["a", "b", " ", "  ", "'s", "'", "re", "ll", "\n", "\t", "1", "23", "é", "ß", "漢字", "...", "=", "-----", "　", "\x1c", "\x85", "the", "a" * 30, "=" * 30, " " * 20, "😀"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=80))
def test_tree_encodes_as_the_library(text):
    ids = SMALL.encode(text)
    assert ids.tolist() == SMALL.encoding.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


def test_long_runs():
    codec = bpe.TreeCodec(BYTES, PATTERN)
    for text in ("ab" * 40_000, "漢字テスト" * 8_000, "=" * 50_000, " " * 50_000 + "x", "word " * 20_000):
        assert codec.encode(text).tolist() == codec.encoding.encode_ordinary(text)


def test_round_trip(spark):
    table = cases.rows()
    coded = bpe.round_trip(cases.docs(spark), BYTES, PATTERN, ["doc_id", "id"]).collect()
    assert len(coded) == len(table)
    reference = Counter((r[0], bytes(np.array(SMALL.encoding.encode_ordinary(r[1] or ""), "<u4").tobytes()), (r[1] or "").encode()) for r in table)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in coded) == reference
    halves = bpe.decode(bpe.encode(cases.docs(spark), BYTES, PATTERN, ["doc_id"]), BYTES, PATTERN, ["doc_id"]).collect()
    assert Counter(bytes(r["decoded"]) for r in halves) == Counter((r[1] or "").encode() for r in table)
    assert bpe.round_trip(cases.empty(spark), BYTES, PATTERN, ["doc_id"]).count() == 0


def test_suffix_tree_base(spark):
    table = cases.rows()
    counts = Counter()
    for r in table:
        if cases.remainder(r[0]) != 1:
            counts.update(w.lower() for w in cases.words(r[1]))
            counts[b""] += 1
    total, distinct = sum(counts.values()), len(counts)
    expected = Counter()
    for r in table:
        w = [x.lower() for x in cases.words(r[1])] + [b""]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        expected[r[0], cases.remainder(r[0]) == 1, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)] += 1
    found = suffix_tree.learn_and_score(cases.docs(spark), remainder_of_five("doc_id") == 1).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    assert all(r["score"] < 0 for r in found)


@pytest.mark.parametrize("depth", [1, 3])
def test_suffix_tree_predicts(spark, depth):
    # Words that follow each other by a rule: the tree must find it, and its distributions must sum to one.
    rng = random.Random(2)
    texts = []
    for d in range(300):
        words, w = [], rng.randrange(12)
        for _ in range(40):
            w = (w * 5 + 1 + (rng.random() < 0.1)) % 12
            words.append(f"word{w}")
        texts.append((d, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rules = suffix_tree.Rules(depth=depth, context_share=1e-3)
    counts = suffix_tree.word_counts(docs)
    symbols = suffix_tree.symbols_of(counts, rules)
    tree = suffix_tree.grow_tree(docs, symbols, rules)
    assert np.allclose((10.0 ** tree.log_next).sum(axis=1), 1, atol=1e-4)
    assert len(tree.contexts[0]) >= 12
    got = suffix_tree.learn_and_score(docs, remainder_of_five("doc_id") == 1, rules=rules).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.5 * got[1]


def test_suffix_tree_of_rare_words(spark, monkeypatch):
    # No word reaches a share of its own, and all end alike; what follows what is known by the words alone.
    monkeypatch.setattr(suffix_tree, "ASKED_TOKENS", 50)
    rng = random.Random(3)
    vocabulary = [f"w{n}xy" for n in range(4000)]
    texts = [(d, " ".join(rng.sample(vocabulary, 30))) for d in range(200)]
    seen = texts[7][1].split()
    texts += [(1000, " ".join(seen)), (1001, " ".join(sorted(seen)))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    rules = suffix_tree.Rules(symbol_share=0.01, context_share=0.01)
    held_out = F.col("doc_id") >= 1000
    found = {r["doc_id"]: r for r in suffix_tree.learn_and_score(docs, held_out, rules=rules).collect()}
    assert found[1000]["base_score"] == pytest.approx(found[1001]["base_score"]) and found[1000]["score"] > found[1001]["score"] + 10
    # Brute force over all runs of up to three words, on the probabilities of the tree over classes.
    training = docs.where(~held_out)
    symbols = suffix_tree.symbols_of(suffix_tree.word_counts(training), rules)
    tree = suffix_tree.grow_tree(training, symbols, rules)
    split = {d: [w.encode() for w in t.split()] + [b""] for d, t in texts}
    runs = Counter(tuple(w[i - k:i + 1]) for d, w in split.items() if d < 1000 for k in range(3) for i in range(k, len(w)))
    for d, words in split.items():
        symbol = np.array([0 if not w else symbols.read([w])[1][0] for w in words])
        state, total = tree.states_of(symbol, np.arange(len(words)) == 0), 0.0
        for i, w in enumerate(words):
            p = 10.0 ** (tree.log_next[state[i], symbol[i]] + math.log10(runs[(w,)] + 0.5) - symbols.log_mass[symbol[i]])
            for k in range(1, min(i, rules.depth) + 1):
                p = (runs[tuple(words[i - k:i + 1])] + rules.prior * p) / (runs[tuple(words[i - k:i])] + rules.prior)
            total += math.log10(p)
        assert found[d]["score"] == pytest.approx(total, abs=1e-4)


def test_suffix_tree_empty(spark):
    assert suffix_tree.learn_and_score(cases.empty(spark), remainder_of_five("doc_id") == 1).count() == 0
    unknown = suffix_tree.learn_and_score(cases.docs(spark), F.lit(True)).collect()  # nothing to learn from
    assert len(unknown) == len(cases.rows()) and {r["train_tokens"] for r in unknown} == {0}


def labelled(spark, n: int = 400):
    rng = random.Random(4)
    texts, labels = [], []
    for d in range(n):
        bad = d % 4 == 0
        words = cases.prose(rng, rng.randint(20, 60)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot", "you moron"]))
        junk = d % 5 == 0
        texts.append((d, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words), f"src{d % 3}", "en"))
        labels.append((d, int(not junk), int(bad)))
    return spark.createDataFrame(texts, "doc_id bigint, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, remainder_of_five("doc_id") != 0)
    assert {"scum", "idiot", "moron"} <= model.lexicon.words
    scored = model.score(docs, ["doc_id"]).join(labels, "doc_id").where(remainder_of_five("doc_id") == 0).collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in scored) >= 0.95 * len(scored)


def test_toxicity_disguise():
    lexicon = toxicity.Lexicon(frozenset(["moron"]), frozenset())
    at = toxicity.FEATURES.index("disguised")
    assert lexicon.features("what a m0r0n indeed")[at] > 0 and lexicon.features("m.o.r.o.n")[at] > 0 and lexicon.features("plain words")[at] == 0
    assert lexicon.features("you are a moron")[toxicity.FEATURES.index("near")] > 0


def test_toxicity_cases(spark):
    docs = cases.docs(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, none, F.lit(True))
    assert {r["score"] for r in model.score(docs, ["doc_id"]).collect()} == {0.5}
    assert model.score(cases.empty(spark), ["doc_id"]).count() == 0


def test_quality(spark):
    docs, labels = labelled(spark)
    rated = quality.classify(docs, labels, remainder_of_five("doc_id") != 0, "doc_id", "text", F.col("source"), F.concat_ws("/", "source", "lang"))
    found = rated.join(labels, "doc_id").where(remainder_of_five("doc_id") == 0).collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in found) >= 0.95 * len(found)


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "big/a", float(i % 10 < 3), 0.5) for i in range(500)] + [("good", "good/a", 1.0, 0.5)] * 200 + [("new", "new/a", 1.0, 0.5)] + [(None, None, None, 0.9)]
    sites, total = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, label double, evidence double"))
    rate = {r["host"]: r["path_rate"] for r in sites.collect()}
    assert abs(rate["big"] - 0.3) < 0.02 and rate["good"] > 0.95
    assert total < rate["new"] < rate["good"] and None in rate


def test_quality_cases(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rated = quality.classify(cases.docs(spark), none, F.lit(True), "doc_id", "text", F.col("source"), F.col("lang"))
    assert rated.count() == len(cases.rows())
    assert quality.classify(cases.empty(spark), none, F.lit(True), "doc_id", "text", F.col("source"), F.col("lang")).count() == 0


def test_digest_columns(spark):
    from tidemark.llm.queries import op2_byte_bpe
    r = op2_byte_bpe(spark, "/root/testdata/sf0.001").where("doc_id = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 0").first()["text"]
    ids = SMALL.encoding.encode_ordinary(text)
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
        len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
