"""N-gram join, collocations and the conversation trie beside brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import near_dedup, ngram_join, phrases, prefix_trie
from tidemark.llm.common import ready


def components_of(table, percent):
    """doc_id -> smallest id reachable; rows that repeat an id are one document."""
    flat = [(r[0], cases.shingle_set(r[1])) for r in table if r[0] is not None]
    root = {d: d for d, _ in flat}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def edited(rng, base, edits):
    words = list(base)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"e{rng.randint(0, 10**9)}"
    return " ".join(words)


TINY = ngram_join.Rules(cold=4, slice_tokens=500, bucket_bytes=2000, shard_docs=3, shard_tokens=600, pivots=2)


@pytest.mark.parametrize("rules", [ngram_join.Rules(), TINY])
def test_ngram_join(spark, rules):
    ready(spark)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
    # A dense group around the threshold, an id with two texts that ties two groups, and a group whose members share a passage only.
    other = cases.prose(rng, 60)
    more = [(1000 + i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 8, 20]))) for i in range(60)]
    more += [(2000, other), (2001, other + " end"), (2001, edited(rng, base, 1)), *[(3000 + i, " ".join(base[:40]) + " " + cases.prose(rng, 100)) for i in range(20)]]
    docs = cases.docs(spark).unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True).repartition(5)
    table = [(r[0], r[1]) for r in cases.rows()] + more
    expected = components_of(table, 80)
    found = ngram_join.join_components(docs, rules=rules).collect()
    assert len(found) == len(table)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == expected
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)
    sizes = collections.Counter((r[0], len(cases.shingle_set(r[1]))) for r in table)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in found) == sizes


def test_ngram_join_empty(spark):
    assert ngram_join.join_components(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("kind", ["near", "ngram"])
def test_borderline_group_emits_no_pairs(spark, kind, monkeypatch):
    # 1,200 documents at a similarity of about 0.69 to each other: no link, and nothing near their 719,400 pairs leaves a task.
    ready(spark)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    table = []
    for i in range(1200):
        words = list(base)
        for at in rng.sample(range(5, 400, 10), 8):
            words[at] = f"e{i}-{at}"
        table.append((i, " ".join(words)))
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(8)
    written = []
    module = near_dedup if kind == "near" else ngram_join
    whole = module.materialise

    def counted(df, label, path=None):
        out = whole(df, label, path)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(module, "materialise", counted)
    found = near_dedup.similar(docs) if kind == "near" else ngram_join.join_components(docs)
    assert all(r["component_id"] == r["doc_id"] for r in found.collect())
    assert max(n for label, n in written if label not in ("ngram-prefixes", "ngram-hot")) < 40 * len(table), written


def test_near_dedup_at_the_deepest(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    table = [(d, edited(rng, base, rng.choice([0, 1, 2, 3, 5, 8, 13, 20, 40]))) for d in range(120)]
    rules = near_dedup.Rules(small=1, rest=1, pivots=1, salt_rows=8, deepest=1)
    found = near_dedup.similar(spark.createDataFrame(table, "doc_id bigint, text string"), rules=rules).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == cases.near_components(table)


def counted_phrases(table, least=10, first=2000):
    words, grams = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, text in table:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang].update(w)
            for k in (1, 2, 3):
                grams[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in grams.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items() if len(q) == 3):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sum(words[lang].values()), -s))
    return sorted(out)


@pytest.mark.parametrize("rules", [phrases.Rules(), phrases.Rules(chunk_words=40, bucket_bytes=500, small=8, hot=20), phrases.Rules(chunk_words=7, most_known=3, small=2)])
def test_collocations(spark, rules):
    ready(spark)
    rng = random.Random(6)
    table = []
    for i in range(80):
        text = " ".join(rng.choice(["Alpha beta", "alpha BETA gamma", "delta, epsilon", "x\ty z", "é ö.", "one", "two;", "a b c"]) for _ in range(rng.randint(0, 60)))
        table.append((rng.choice(["en", "de", None]), text))
    table += [("en", None), ("de", ""), ("fr", "x y z " * 11), ("fr", " \t . ,"), ("en", "Ünï cödé " * 300)]
    docs = spark.createDataFrame([(i, *r, "s") for i, r in enumerate(table)], "doc_id bigint, lang string, text string, word string").repartition(4)
    found = phrases.collocations(docs, rules=rules).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found) == counted_phrases(table)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_collocations_start_again_when_numbers_meet(spark, monkeypatch):
    # Seeds that make two words one number are given up for others.
    ready(spark)
    docs = spark.createDataFrame([("en", "aa bb cc " * 12)], "lang string, text string")
    seeds = []
    whole = phrases.count_words
    monkeypatch.setattr(phrases, "count_words", lambda texts, salt, *rest: seeds.append(salt) or whole(texts, salt, *rest))
    real = phrases.pointers

    def meeting(texts, salt, *rest):
        rows = real(texts, salt, *rest)
        return rows.withColumn("word", F.when((F.col("word") == "bb") & (F.rand(1) < 2), F.lit("bb")).otherwise(F.col("word"))).unionByName(
            rows.where("word = 'bb'").withColumn("word", F.lit("other"))) if salt == 0 else rows

    monkeypatch.setattr(phrases, "pointers", meeting)
    assert [r["phrase"] for r in phrases.collocations(docs).collect()] and seeds == [0, 1]


def nodes_of(table):
    own = collections.defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [(r, x) for _, _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + mine[h:]
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = sorted(c for c in cs if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below),
                    sum(not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members) for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_prefix_trie(spark, monkeypatch):
    rng = random.Random(7)
    table = []
    for c in [*range(-7, 40), 10**12, 10**12 + 3]:
        for t in range(rng.choice([1, 2, 3, 9, 17, 30])):
            table.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "héé", "", None, "a", "b"])))
    table += [(5, None, "user", "first"), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (6, 3, "u", "tie b"), (None, 1, "user", "left out"), (12, 0, "12", "x"), (12, 0, "1", "2x")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = spark.createDataFrame(table, schema).withColumns({"c": F.lit(1), "depth": F.lit("x"), "pos": F.lit(2)}).repartition(5)
    monkeypatch.setattr(prefix_trie, "_RUN", 2)  # long conversations and many ends take several pieces
    found = prefix_trie.rebuilt_trie(rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == nodes_of(table)
    assert prefix_trie.rebuilt_trie(rows.limit(0)).count() == 0
