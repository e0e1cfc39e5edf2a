"""Runs queries beside their SQL in DuckDB and compares names, counts and values."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, decimal.Decimal):
        return f"decimal:{v}"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dict):
        return str(sorted((plain(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return f"bool:{v}"
    return str(v) if v is not None else "\0null"


def compare(spark, sf_dir: str, name: str, allow_empty: bool = False) -> list[str]:
    import duckdb
    from tidemark.catalog import REGISTRY, Tables

    q = REGISTRY[name]
    df = q.build(Tables(spark, sf_dir))
    columns = df.columns
    rows = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return [] if rows or allow_empty else ["no rows"]
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    res = con.execute(q.sql)
    names = [d[0] for d in res.description]
    expected = res.fetchall()
    if sorted(columns) != sorted(names):
        return [f"columns {sorted(columns)} != {sorted(names)}"]
    order_a = [columns.index(c) for c in sorted(columns)]
    order_b = [names.index(c) for c in sorted(columns)]
    a = sorted(tuple(plain(r[i]) for i in order_a) for r in rows)
    b = sorted(tuple(plain(r[i]) for i in order_b) for r in expected)
    problems = []
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        set_a, set_b = set(a), set(b)
        only_a = [r for r in a if r not in set_b][:2]
        only_b = [r for r in b if r not in set_a][:2]
        problems.append(f"columns {sorted(columns)}\n   spark  {only_a}\n   duckdb {only_b}")
    if not a and not allow_empty:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tidemark.catalog import REGISTRY
    from tidemark.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    names = argv or list(REGISTRY)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(spark, sf_dir, name)
        except Exception as error:  # report and go on with the other queries
            problems = [str(error)[:600]]
        bad += bool(problems)
        kind = "S" if REGISTRY[name].sql else "R"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {name} {time.time() - start:.1f}s", *problems, flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
