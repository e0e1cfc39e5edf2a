"""Steps whose seconds must not grow with the number of sources, blobs or segments."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.sources import frames as fr


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _blob(n: int) -> bytes:
    return b"".join(bytes([5]) + b"%05d" % i + bytes(32) for i in range(n))


def test_frames_of_many_blobs_leave_in_one_batch():
    blobs = pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(300)]), pa.array([_blob(3)] * 299 + [b"\x05abc"])], names=["path", "content"])
    out = list(fr._decode(iter([blobs])))
    assert len(out) == 1 and out[0].num_rows == 299 * 3 + 1
    assert out[0].to_pylist()[-1] == {"path": "p299", "frame_pos": 0, "record_bytes": None, "claimed_hash": None, "error": "truncated"}


def test_batches_of_frames_are_cut(monkeypatch):
    monkeypatch.setattr(fr, "BATCH_ROWS", 4)
    blobs = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([_blob(3), b"", _blob(7)])], names=["path", "content"])
    rows = [r for batch in fr._decode(iter([blobs])) for r in batch.to_pylist()]
    assert [(r["path"], r["frame_pos"]) for r in rows] == [("a", i) for i in range(3)] + [("c", i) for i in range(7)]


def test_damaged_blobs_are_decoded_once(spark):
    blobs = spark.range(4).select(F.col("id").cast("string").alias("path"), F.lit(_blob(2)).alias("content"))
    report = fr.corruption_report(fr.decode_frames(blobs))
    assert _plan(report).count("MapInArrow") == 1
    assert {(r.reason, r.frame_pos, r.last_good_seq) for r in report.collect()} == {("hash mismatch", 0, None)}


def test_many_short_sources_are_cut_into_segments_without_a_group_each(spark):
    from tidemark.operators.segments import segments_by_age

    # Source n has n + 1 records, 30 apart: at most 3 records or an age of 60, whichever comes first.
    rows = spark.range(60).select(F.col("id").cast("string").alias("source_id"), F.explode(F.sequence(F.lit(1), F.col("id") + 1)).alias("seq"))
    cut = segments_by_age(rows.withColumn("time_ns", F.col("seq") * 30), 3, 60, 8)
    plan = _plan(cut)
    assert "MapInArrow" in plan and "MapGroups" not in plan and "MapCoGroups" not in plan
    got = {(r.source_id, r.seq): r.segment for r in cut.collect()}
    assert got == {(str(n), seq): (seq - 1) // 2 for n in range(60) for seq in range(1, n + 2)}


def test_intake_puts_no_record_bytes_in_order(spark):
    from tidemark.plans.ingest import content_status

    deliveries = spark.createDataFrame([(1, "s", 1, 2), (2, "s", 3, 4)], "delivery bigint, source_id string, seq_first bigint, seq_last bigint")
    record = F.encode(F.concat(F.lit('{"source_id":"s","seq":'), F.col("seq").cast("string"), F.lit("}")), "UTF-8")
    frames = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 5)], "delivery bigint, position bigint, seq bigint").withColumn("record_bytes", record)
    status = content_status(deliveries, frames.withColumn("claimed_hash", F.sha2("record_bytes", 256)).drop("seq"))
    plan = _plan(status).splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "Window [" in line) + 1]
    assert "Project" in below and "record_bytes" not in below.split("Project [")[1].replace("octet_length(record_bytes", "").split(" AS bytes")[-1].split("]")[0]
    assert {r.delivery: r.content for r in status.collect()} == {1: "ok", 2: "out_of_order"}


def test_rows_of_an_intact_chain_keep_no_hash_texts(spark):
    from tidemark.operators import chain, passes

    bodies = spark.range(1, 8).select(F.lit("s").alias("source_id"), F.col("id").alias("seq"), F.concat(
        F.lit('{"v":2,"source_id":"s","seq":'), F.col("id").cast("string"), F.lit(',"event_type":"app.click","prev_hash":"')).alias("body"))
    frames = chain.build_chain(bodies).withColumn("ordinal", F.col("seq")).drop("seq")
    rows = passes.one_pass(frames, width=3).rows.orderBy("ordinal").collect()
    assert all(r.claimed_hash is None for r in rows)
    # Blocks are 1-2, 3-5 and 6-7: rows that open one are compared with the block before, rows that close one are what is compared with.
    assert [r.ordinal for r in rows if r.prev_hash is not None] == [1, 3, 6]
    assert [r.ordinal for r in rows if r.record_hash is not None] == [1, 2, 3, 5, 6, 7]


def test_records_are_judged_without_their_schema(spark):
    from tidemark.operators.chain import parse_record

    texts = ['{"v":2}', ' \t\r\n{"v":2}', "{}", "[1]", "null", "1", '"{"', "", " ", "{", '{"v":2', '{"v":2} more', "﻿{}", " {}", "\x0b{}", "\x1e{}", '{"v":2,"v":3}', None]
    lines = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("record_bytes", F.encode("text", "UTF-8"))
    strict = F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False))
    looked = lines.select("text", strict.alias("strict"), parse_record(F.col("record_bytes")).isNotNull().alias("parsed"))
    assert [r for r in looked.collect() if r.strict != r.parsed] == []
    assert "schemaOfVariant" not in _plan(lines.select(parse_record(F.col("record_bytes"))))


def test_numbers_are_searched_for_once_in_a_line(spark):
    from tidemark.operators.mapping import with_fields

    numbers = ["0", "-0", "7", "-7", "1.0", "1e3", "9223372036854775807", "9223372036854775808", "18446744073709551615", "20000000000000000000", "100.00"]
    lines = spark.createDataFrame([('{"a":%s,"b":[%s]}' % (n, n),) for n in numbers], "value string").withColumn("_json", F.try_parse_json("value"))
    fields = with_fields(lines, {"a": "a", "b": "b.0"})
    shown = [{"-0": "0", "1e3": "1000.0", "100.00": "100.0"}.get(n, n) for n in numbers]
    assert [(r.a_text, r.b_text) for r in fields.collect()] == [(n, n) for n in shown]
    assert _plan(fields).count("get_json_object") == 3


def test_events_of_one_split_are_dealt_out(spark, tables):
    from tidemark.catalog import REGISTRY

    assert "RepartitionByExpression" in _plan(REGISTRY["json_paths"].build(tables))


def test_lines_are_written_into_more_files_as_they_grow(spark, tables, monkeypatch):
    from tidemark.catalog import mapping

    monkeypatch.setattr(mapping, "LINES_PER_FILE", 50, raising=False)
    half = tables.read("events").count() // 2
    assert [len(spark.read.text(path).inputFiles()) for path in mapping.written_lines(tables)] == [half // 50] * 2


def test_findings_hash_no_lines(spark, tables, monkeypatch):
    from tidemark.catalog import mapping
    from tidemark.plans import assess

    asked = []
    monkeypatch.setattr(assess, "line_digests", asked.append)
    run = assess.assess_files(spark, mapping.written_lines(tables), mapping.GENERIC, assess.AssessPolicy())
    assert asked == [] and run.findings.columns
    run.digests
    assert asked == [run.mapped]


def test_blocks_of_numbers_meet_by_their_ends(spark):
    from tidemark.operators import assess as a

    numbers = {"dense": list(range(1, 40)), "holes": [n for n in range(200) if n % 7 in (1, 2, 5)], "far": [1, 2, 10**6, 10**6, 10**6 + 4], "one": [5], "twice": [3, 3, 3, 9, 9]}
    seqs = a.distinct_sequences(spark.createDataFrame([(k, n) for k, ns in numbers.items() for n in ns], "source_id string, seq bigint"))
    for width in (1, 3, 10, 1 << 20):
        facts = a.sequence_facts(a.block_steps(seqs, width), stitched=False)
        assert "Join" not in _plan(facts)
        assert sorted(facts.collect()) == sorted(a.sequence_facts(a.gap_steps(seqs, width)).collect())
