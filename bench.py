"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import REGISTRY, Tables  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = ["findings_assess", "chain_verify", "merkle_root", "prefix_roots", "observation_windows", "retention_expire",
            "checkpoint_forks", "outage_pairs", "map_generic", "input_digest"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, name="tidemark-bench")
    tables = Tables(spark, sf_dir)
    # The first query of a session pays for starting the JVM's code paths; it is not part of any figure.
    REGISTRY["source_span"].build(tables).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.time()
            REGISTRY[name].build(tables).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    rows = {name: tables.read(name).count() for name in ("events", "lineitem", "orders")}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
