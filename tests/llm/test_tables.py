"""Sharding, decontamination, URL filters and the pipeline."""

import collections
import datetime
import math
import re
import zlib

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tests.oracle import plain
from tidemark.llm import decontam, exact, sharding, url_filters
from tidemark.llm.common import text_of
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_registered_sql(spark):
    for name, sql in ORACLE_SQL.items():
        found = QUERIES[name](spark, SMALL)
        con = duckdb.connect()
        for table in ("documents", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        res = con.execute(sql)
        names = [d[0] for d in res.description]
        columns = sorted(found.columns)
        assert sorted(names) == columns
        got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall()), name


def test_sharding(spark):
    table = cases.rows()
    found = sharding.shard_rows(cases.docs(spark), 24).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == collections.Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in table)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard_of = {(r["doc_id"], r["shard"]) for r in found}
    assert len(shard_of) == len({d for d, _ in shard_of})
    assert sharding.shard_rows(cases.empty(spark), 24).count() == 0


def test_sharding_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, shard, grown_shard, slot FROM ({sharding.query_sql(24)})").fetchall()}
    assert {r["doc_id"]: (r["size"], r["shard"], r["grown_shard"], r["slot"]) for r in sharding.shard_rows(docs, 24).collect()} == expected


def test_sharding_weights_and_growth(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    placed = keys.select(*[sharding.place(F.col("key"), t).alias(n) for n, t in (
        ("even", sharding.shard_tree(24)), ("more", sharding.shard_tree(26)), ("last", sharding.shard_tree(27)),
        ("heavy", sharding.shard_tree(24, {0: 4.0})), ("few", sharding.shard_tree(5)), ("one", sharding.shard_tree(1)))]).collect()
    even, heavy = (collections.Counter(r[c] for r in placed) for c in ("even", "heavy"))
    assert len(even) == 24 and all(abs(n - 20_000 / 24) < 150 for n in even.values())
    assert abs(heavy[0] / (sum(heavy.values()) - heavy[0]) - 4 / 23) < 0.02
    assert all(r["last"] in (r["more"], 26) for r in placed)
    # A weight that rises in one region moves rows only into that region.
    assert all(r["heavy"] == r["even"] or r["heavy"] < 6 for r in placed)
    assert {r["one"] for r in placed} == {0} and len({r["few"] for r in placed}) == 5


ITEMS = [(1, "In 2019 the city of Rome counted 4350 bridges and each bridge was 12 km from the next one."),
         (2, "How many apples does Maria have if she buys 12 apples and gives 5 to Peter every day?"), (3, "short item of six words only"), (4, "1 2 3 4 5 6 7 8 9 10"), (5, None)]


def test_template_tokens(spark):
    text = "In May 2021, Anna ran 12.5 km in 3 hours; it cost $5."
    found = spark.createDataFrame([(text,)], "t string").select(decontam.template_tokens(text_of("t")).alias("t")).first()["t"]
    assert found == ["In", "\x01AMay", "\x01N2021", "\x01AAnna", "ran", "\x01N12.5", "\x01Ukm", "in", "\x01N3", "\x01Uhours", "it", "cost", "\x01N5"] or "\x01N5" in found


def test_decontamination(spark):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    texts = [(1, f"{filler} {ITEMS[0][1]} {filler}"), (2, ITEMS[1][1].upper().replace("?", "")), (3, f"{filler}. {ITEMS[1][1].replace('Maria', 'Lena').replace('12', '31').replace('Peter', 'Hans')}"),
             (4, f"{filler} {ITEMS[1][1].replace('buys 12', 'buys 31')}"), (5, f"so here is a short item of six words only {filler}"), (6, "9 8 7 6 5 4 3 2 1 0 1 2 3 4"), (7, filler * 50),
             (8, "How many apples does Maria have if she buys pears"), (9, None), (10, ""), (None, ITEMS[0][1]), (1, f"{filler} {ITEMS[0][1]} {filler}")]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id bigint, text string, item_id string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs, bench).collect()}
    assert {k for k in found} >= {(1, 1), (3, 2), (4, 2), (5, 3)}
    assert not {d for d, _ in found} & {6, 7, 9, 10, None}
    assert found[1, 1]["same_values"] and found[1, 1]["covered"] > 0.9 and not found[3, 2]["same_values"]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and {6, 7, 9, 10, None} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id = 1").count() == 0
    # The shuffled form of the join gives the same rows.
    again = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs, bench, max_index=0).collect()}
    assert again == found
    assert decontam.contamination(docs, bench.limit(0)).count() == 0 and decontam.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_inconsistent_slots(spark):
    item = "Tell us whether Maria saw the red house or whether Maria saw the green garden today"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, item.replace("Maria", "Lena")), (2, item.replace("Maria", "Lena", 1))], "doc_id bigint, text string")
    assert {r["doc_id"] for r in decontam.contamination(docs, bench).collect()} == {1}


def test_decontamination_case_and_lines(spark):
    """Names are met in any capitals and behind any white space."""
    item, german = ITEMS[1][1], "Wie viele Straßen und Häuser hat der Ort, wenn jeder Bürger ein Haus und jede Straße 12 Häuser bekommt?"
    wrapped = item.replace(" Maria", "\nMaria").replace(" Peter", "\u00a0  Peter")
    texts = [item.upper(), item.lower(), wrapped, wrapped.replace("Maria", "Lena").replace("Peter", "Hans"), german.upper(), german.lower(), ". ".join(item.split(" Maria ")), "plain words only " * 9]
    bench = spark.createDataFrame([(2, item), (3, german)], "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs, bench).collect()}
    assert set(found) >= {(0, 2), (1, 2), (2, 2), (3, 2), (4, 3), (5, 3)} and 7 not in {d for d, _ in found}
    assert all(found[k]["covered"] == 1 and found[k]["same_values"] for k in ((0, 2), (1, 2), (2, 2), (4, 3), (5, 3)))
    assert found[3, 2]["covered"] == 1 and not found[3, 2]["same_values"]


def test_decontamination_short_items(spark):
    """Items of few words are met by verbatim copies, in any capitals, and by nothing else."""
    items = [(1, "What is 12 times 15?"), (2, "1 2 3 4 5 6 7 8 9 10"), (3, "Zanzibar"), (4, "Call Maria 5 km on 6 May 2019 at 7 h"), (5, "?!"), (6, "2 plus 2")]
    texts = [(1, "so what is 12 times 15 then"), (2, "so what is 12 times 16 then"), (3, "row 1 2 3 4 5 6 7 8 9 10 11"), (4, "row 2 3 4 5 6"), (5, "in ZANZIBAR town"),
             (6, "CALL MARIA 5 KM ON 6 MAY 2019 AT 7 H"), (7, "2 plus 3"), (8, "2 plus 2"), (9, "?!"), (10, "9 8 7 6 5 4 3 2 1 0")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs, bench).collect()}
    assert set(found) == {(1, 1), (3, 2), (5, 3), (6, 4), (8, 6)}
    assert all(r["same_values"] and r["covered"] == 1 for r in found.values())
    again = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs, bench, max_index=0).collect()}
    assert again == found


def test_decontamination_pieces(spark):
    """Inserted words, a slot of two values and a long item copied in part."""
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    pieces, long = " ".join(w[:44]), " ".join(w[44:120])
    slots = "A box of 3 apples and 3 oranges is on the table and the tall man who came in takes them all to his old house by the sea"
    bench = spark.createDataFrame([(1, pieces), (2, long), (3, slots)], "item_id bigint, text string")
    cut = " ".join(w[:11]) + " one " + " ".join(w[11:22]) + " two more " + " ".join(w[22:33]) + " three " + " ".join(w[33:44])
    texts = [(1, f"before {cut} after"), (2, " ".join(["x", *w[60:73], "y"])), (3, " ".join(["x", *w[60:72], "y"])),
             (4, slots.replace("3 apples", "4 apples").replace("3 oranges", "7 oranges")), (5, " ".join(w[:11]) + " end"), (6, " gap ".join(" ".join(w[k:k + 5]) for k in range(0, 44, 5)))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs, bench).collect()}
    assert set(found) == {(1, 1), (2, 2), (4, 3)}
    assert found[1, 1]["matched"] == 16 and found[1, 1]["item_windows"] == 37 and (found[1, 1]["start"], found[1, 1]["end"]) == (1, 49)
    assert (found[2, 2]["start"], found[2, 2]["end"], found[2, 2]["matched"]) == (1, 14, 6) and found[2, 2]["same_values"]
    again = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs, bench, max_index=0).collect()}
    assert again == found


def test_decontamination_brute_force(spark):
    """Planted passages as they stand: every document that holds a whole item is found, and no other."""
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in bench.collect()]
    holds = {r["doc_id"] for r in docs.collect() if any(i in " ".join(re.findall(r"\w+", (r["text"] or "").lower())) for i in items)}
    assert {r["doc_id"] for r in decontam.contamination(docs, bench).collect()} == holds


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_url_filters(spark):
    changes = [("ads", "domain", "bad.com", "add", day(10)), ("ads", "domain", "bad.com", "add", day(11)), ("ads", "domain", "bad.com", "remove", day(20)),
               ("ads", "domain", "bad.com", "add", day(30)), ("spam", "prefix", "ok.com/x", "add", day(0)), ("spam", "domain", "both.com", "remove", day(5)),
               ("more", "domain", "bad.com", "add", day(15)), ("tie", "domain", "tie.com", "add", day(1)), ("tie", "domain", "tie.com", "remove", day(1))]
    captures = [(1, "http://bad.com/a", day(9)), (2, "http://bad.com/a", day(10)), (3, "https://www.BAD.com:80/a?x", day(16)), (4, "http://bad.com", day(20)), (5, "http://bad.com", day(99)),
                (6, "http://notbad.com/", day(12)), (7, "http://ok.com/x/y", day(1)), (8, "http://ok.com/xy", day(1)), (9, "http://ok.com/x?q", day(1)), (10, None, day(1)), (11, "bad.com", day(12)),
                (12, "http://bad.com/", None), (None, "http://bad.com/", day(12)), (13, "http://tie.com/", day(3)), (13, "http://tie.com/", day(3)), (14, "http://com/", day(12)), (15, "http://u:p@bad.com./z", day(12))]
    found = url_filters.judge(spark.createDataFrame([(*c, "h") for c in captures], "page_id bigint, url string, at timestamp, host string").drop("host"),
                              spark.createDataFrame(changes, "list string, kind string, pattern string, action string, at timestamp"), "page_id", "url", "at").collect()
    assert len(found) == len(captures)
    assert {r["page_id"]: r["lists"] for r in found if r["blocked"]} == {2: "ads", 3: "ads,more", 4: "more", 5: "ads,more", 7: "spam", 9: "spam", None: "ads", 15: "ads"}
    none = spark.createDataFrame([], "page_id bigint, url string, at timestamp")
    assert url_filters.judge(none, spark.createDataFrame(changes, "list string, kind string, pattern string, action string, at timestamp"), "page_id", "url", "at").count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) and 0 < len(ids) <= docs.count()
    # Each stage holds on its own input.
    kept = docs.where(F.col("doc_id").isin(ids))
    assert exact.exact_groups(kept).where("not kept").count() == 0
    comps = cases.near_components([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert all(d == c for d, c in comps.items())
    assert decontam.contamination(kept, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    clean = [d for d, t in labels.items() if t == 0]
    leaked = {r["doc_id"] for r in decontam.contamination(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    twins = {r["doc_id"] for r in exact.exact_groups(docs).where("group_size > 1").collect()}
    near = {d for d, c in cases.near_components([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if d != c}
    lost = [d for d in clean if d not in set(ids) and d not in leaked | twins | near]
    assert len(lost) <= 0.02 * len(clean)
    assert math.isclose(sum(r["n_tokens"] > 0 for r in out), len(out))


def test_pipeline_cases(spark):
    rows, none = cases.docs(spark), cases.empty(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, SMALL)
        assert kept.columns == rows.columns and kept.count() > 0, name
        assert stage(spark, none, SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() == len(cases.rows())
