"""Exact, near and substring deduplication beside brute force."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import components, exact, near_dedup, repeats


def groups_by_text(table):
    out = collections.defaultdict(list)
    for r in table:
        out[re.sub(r"[ \t-\r]+", " ", r[1] or "")].append(r[0])
    return out


def test_exact_groups(spark):
    table = cases.rows()
    found = exact.exact_groups(cases.docs(spark)).collect()
    assert len(found) == len(table)
    expected = groups_by_text(table)
    by_size = collections.Counter()
    for ids in expected.values():
        known = [i for i in ids if i is not None]
        by_size[min(known) if known else None, len(ids)] += len(ids)
    assert collections.Counter((r["keep_id"], r["group_size"]) for r in found) == by_size
    assert sum(r["kept"] for r in found) == len(expected)
    assert len({r["text_sha256"] for r in found}) == len(expected)


def test_exact_full_filter_stays_right(spark, monkeypatch):
    # A filter of one block for everything: more rows are shuffled, the result is the same.
    whole = exact.seen_twice
    monkeypatch.setattr(exact, "seen_twice", lambda keys, digest, rows: whole(keys, digest, rows, 1, 1))
    assert exact.exact_groups(cases.docs(spark)).where("kept").count() == len(groups_by_text(cases.rows()))


def test_exact_keep_first(spark):
    docs = cases.docs(spark)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    expected = groups_by_text(cases.rows())
    assert len(found) == len(expected)
    for r in found:
        known = [i for i in expected[re.sub(r"[ \t-\r]+", " ", r["text"] or "")] if i is not None]
        assert r["doc_id"] == (min(known) if known else None)


@pytest.mark.parametrize("rules", [near_dedup.Rules(), near_dedup.Rules(small=2, rest=2, pivots=2, salt_rows=3)])
def test_near_components(spark, rules):
    table = cases.rows()
    expected = cases.near_components(table)
    found = near_dedup.similar(cases.docs(spark), rules=rules).collect()
    assert len(found) == len(table)
    for r in found:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert r["component_id"] == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {r[0]: len(cases.shingle_set(r[1])) for r in table}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in found if r["doc_id"] is not None)


def test_near_keeps_columns(spark):
    docs = cases.docs(spark)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    expected = cases.near_components(cases.rows())
    assert {r["doc_id"] for r in kept.collect()} - {None} == set(expected.values())


def test_near_dense_group(spark):
    # A base and 150 copies with one to forty edited words: dense, borderline and unrelated members of large nodes.
    import random
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    table = []
    for d in range(150):
        words = list(base)
        for i in rng.sample(range(300), rng.choice([0, 1, 2, 3, 5, 8, 13, 20, 40])):
            words[i] = f"e{rng.randint(0, 10**6)}"
        table.append((d, " ".join(words)))
    expected = cases.near_components(table)
    found = near_dedup.similar(spark.createDataFrame(table, "doc_id bigint, text string"), rules=near_dedup.Rules(small=8, rest=16)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


@pytest.mark.parametrize("slice_links", [1000, 10])
def test_components(spark, slice_links):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    found = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint"), slice_links).collect()}
    assert found == {**{i: 1 for i in range(2, 61)}, 200: 100, 300: 100}


@pytest.mark.parametrize("rules", [repeats.Rules(), repeats.Rules(shard=3, block_words=50, max_blocks=1, bits_per_entry=1)])
def test_repeats(spark, rules):
    table = cases.rows()
    expected = cases.removed_words(table)
    found = repeats.without_repeats(cases.docs(spark), rules=rules).collect()
    assert len(found) == len(table)
    left = collections.Counter((k[0], v) for k, v in ((((r[0], r[1])), expected[r[0], r[1]]) for r in table))
    assert collections.Counter((r["doc_id"], (r["n_words"], r["n_removed"], r["kept"])) for r in found) == left
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_empty(spark):
    none = cases.empty(spark)
    assert exact.exact_groups(none).count() == 0 and exact.keep_first(none).count() == 0
    assert near_dedup.similar(none).count() == 0 and near_dedup.keep_one(none).columns == none.columns
    assert repeats.without_repeats(none).count() == 0


def test_hot_join_can_be_split(spark):
    # Both sides of the join with the groups are shuffles of their own, so that a third of all rows in one group can be split.
    joined = exact.exact_groups(cases.docs(spark))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "keep_row" in plan and F is not None
