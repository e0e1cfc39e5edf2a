"""Links between the largest components of neighbouring size classes."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases  # noqa: F401
from tidemark.llm import ngram_join


def test_hot_links_between_two_large_size_classes(spark):
    # Two dense groups in neighbouring size classes, tied by one pair alone, whose members are no pivots.
    core, more = list(range(100)), list(range(200, 226))
    small = [core + [1000 + 10 * k + j for j in range(4)] for k in range(12)]
    big = [core + more + [2000 + 10 * k + j for j in range(4)] for k in range(11)] + [core + more[:22] + small[11][-4:]]
    sets = small + big
    linked = [(i, j) for i in range(12) for j in range(12, 24) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
    assert linked == [(11, 23)]
    table = [(k, k, len(x), bytearray(np.array(sorted(x), "<u8").tobytes())) for k, x in enumerate(sets)]
    classes = spark.createDataFrame(table, "k bigint, rep bigint, n int, tokens binary")
    prefix = classes.select("k", "n", F.explode(F.sequence(F.lit(0), F.lit(ngram_join.ORDERS - 1))).alias("o"), F.lit(1).cast("bigint").alias("token"),
                            F.lit(True).alias("hot"), F.lit(1).alias("few"))
    for shard_docs in (3, 5, 512):
        rules = ngram_join.Rules(shard_docs=shard_docs, pivots=2)
        found = {(r["a"], r["b"]) for r in ngram_join.hot_links(prefix, classes, rules).collect()}
        joined = list(range(24))
        for a, b in found:
            joined = [joined[b] if x == joined[a] else x for x in joined]
        assert len(set(joined)) == 1, shard_docs
