"""Rows that near deduplication deals to groups, beside the number of documents that share one passage."""

import random

from tests.llm import cases
from tidemark.llm import near_dedup

RULES = near_dedup.Rules(small=8, salt_rows=4, pivots=2)


def scattered(count):
    """Documents that share one passage and nothing else."""
    rng, passage = random.Random(3), [f"p{i}" for i in range(16)]
    return [(d, " ".join([f"w{rng.randint(0, 10**9)}" for _ in range(30)] + passage)) for d in range(count)]


def dealt(spark, monkeypatch, table):
    rows, links = [], near_dedup.Comparer.links

    def counted(self, groups):
        rows.append(groups.count())
        return links(self, groups)

    monkeypatch.setattr(near_dedup.Comparer, "links", counted)
    found = near_dedup.similar(spark.createDataFrame(table, "doc_id bigint, text string"), rules=RULES).collect()
    monkeypatch.undo()
    assert {r["doc_id"]: r["component_id"] for r in found} == cases.near_components(table)
    return sum(rows)


def test_near_groups_per_document(spark, monkeypatch):
    assert dealt(spark, monkeypatch, scattered(240)) <= 20 * 240
