"""Steps whose memory or results change with the size of the tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import proofs
from tidemark.operators.merkle import build_tiles


def _plan(df) -> list[str]:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def test_proofs_broadcast_nothing(spark):
    ids = spark.range(600)
    leaves = ids.select(F.lit("s").alias("source_id"), F.col("id").alias("idx"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    tiles = build_tiles(leaves.where("idx >= 0"))
    asked = ids.select(F.concat(F.lit("s"), F.substring(F.col("id").cast("string"), 1, 0)).alias("source_id"), F.col("id").alias("idx"), F.lit(600).cast("bigint").alias("size"))
    assert [line for line in _plan(proofs.inclusion_proofs(tiles, asked)) if "BroadcastExchange" in line] == []


def test_verified_inclusions_meet_their_leaves_by_a_shuffle(spark, tables):
    from tidemark.catalog.chaining import inclusion_rows

    assert [line for line in _plan(inclusion_rows(tables).select("idx", "leaf")) if "BroadcastHashJoin" in line and "idx#" in line] == []


def test_paths_are_not_shuffled(spark, tables):
    from tidemark.catalog.chaining import inclusion_rows

    lines = _plan(inclusion_rows(tables))
    made = [i for i, line in enumerate(lines) if "MapInArrow" in line]
    assert made and [line for line in lines[:made[0]] if "Exchange" in line] == []


def test_spans_of_late_events(spark, tmp_path):
    from tidemark.catalog import REGISTRY, Tables

    spark.createDataFrame([(599_999,), (36_000_000,)], "event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    rows = {r.event_id: r for r in REGISTRY["format_spans"].build(Tables(spark, str(tmp_path))).collect()}
    for number, row in rows.items():
        s = (number * number * 40_000 - 1_000_000 + 500_000) // 1_000_000
        assert row.span == f"{s // 86400}d{s % 86400 // 3600:02d}h"
        assert row.duration == f"{s // 3600}h{s % 3600 // 60}m{s % 60}s"
        assert row.minutes == f"{s // 60}m{s % 60:02d}s"
    assert rows[599_999].day == str((datetime(1970, 1, 1) + timedelta(microseconds=599_999**2 * 40_000 - 1_000_000)).date())


def test_two_decimals_as_printf(spark):
    from tidemark.functions.texts import two_decimals
    from tidemark.operators.continuity import coverage_text

    values = [0.0, 0.004, 0.005, 0.015, 0.045, 0.125, 0.135, 0.375, 0.995, 0.999, 1.0, 1.005, 2.675, 15.625, 15.875, 50.0, 99.995, 99.9999, 100.0]
    values += [n / 640 * 100 for n in range(641)] + [n / 1000 for n in range(1, 3000, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_decimals(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in rows if r.t != f"{r.v:.2f}"] == []
    # What a summary and a report show of 5 heartbeats of 32.
    assert spark.sql("SELECT 5L AS observed, 32L AS expected").select(coverage_text()).first()[0] == "15.62 %"


def test_bundles_of_many_small_files_start_no_process_for_each(spark, tmp_path):
    from tidemark.operators import export

    records = spark.range(900).select(
        F.concat(F.lit("s/%"), (F.col("id") % 300).cast("string")).alias("source_id"), (F.col("id") + 1).alias("seq"), F.lit("").alias("actor"),
        F.lit(None).cast("bigint").alias("time_ns"), F.sha2(F.col("id").cast("string"), 256).alias("record_hash"), F.encode(F.col("id").cast("string"), "UTF-8").alias("record_bytes"))
    path = f"{tmp_path}/b"
    export.write_bundles(records, export.RecordFilter(), path, file_bytes=1)
    # Hadoop's local file system leaves a checksum beside each file that it has made, after starting a process for each.
    assert not [p for p in (tmp_path / "b" / "records").rglob("*") if p.name.endswith(".crc")]
    _, listed = export.read_manifest(spark, path)
    present = export.digests(spark, path).drop("source_id")
    assert {r.status for r in export.compare_files(listed, present).collect()} == {"ok"} and listed.count() == 900
    assert export.source_lines(spark, f"{path}/records", True).select("source_id").distinct().count() == 300
    with pytest.raises(Exception, match="(?i)exist"):
        export.write_bundles(records, export.RecordFilter(), path, file_bytes=1)


def test_signatures_of_one_source_are_made_and_checked_in_many_tasks(spark, tables):
    from tidemark.catalog.bundling import event_notes, signers
    from tidemark.operators import checkpoints as cps

    # By their bytes alone, all notes would be put into one task.
    notes = event_notes(tables)
    assert any("REPARTITION_BY_NUM" in line for line in _plan(notes))
    assert sum("REPARTITION_BY_NUM" in line for line in _plan(cps.verify_signatures(notes, signers(tables)).select("pos", "sig_ok"))) >= 2


def test_ed25519_of_rfc_8032():
    from tidemark.functions import ed25519 as ed

    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    signature = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert ed.public_key(seed) == key and ed.sign(seed, b"") == signature and ed.verify(key, b"", signature)
    for n in range(40):
        own, message = bytes([n]) * 32, bytes(range(n))
        made = ed.sign(own, message)
        assert ed.verify(ed.public_key(own), message, made) and not ed.verify(ed.public_key(own), message + b"x", made) and not ed.verify(key, message, made)
        assert not ed.verify(ed.public_key(own), message, made[:-1] + bytes([made[-1] ^ 1]))


def test_files_of_bundles_are_listed_and_read_by_tasks(spark, tmp_path):
    import hashlib
    import os

    from tidemark.operators import export

    lines = {("a/b", 0): [b"one", b"", b"three\r", b"4" * 40], ("a/b", 1): [b"\xff not UTF-8", b"last"], ("c", 0): [b"x"]}
    wanted = {}
    for (source, file), rows in lines.items():
        folder = tmp_path / "b" / "records" / f"source={source.replace('/', '%2F')}" / f"file={file}"
        folder.mkdir(parents=True)
        data = b"\n".join(rows) + (b"\n" if file == 0 else b"")
        (folder / "part-00000.txt").write_bytes(data)
        (folder / ".hidden").write_bytes(b"no")
        wanted[os.path.relpath(folder / "part-00000.txt", tmp_path / "b")] = hashlib.sha256(data).hexdigest()
    (tmp_path / "b" / "_SUCCESS").write_bytes(b"no")
    (tmp_path / "b" / "manifest").mkdir()
    (tmp_path / "b" / "manifest" / "part-0").write_bytes(b"no")
    (tmp_path / "b" / "slipped in").write_bytes(b"yes")
    wanted["slipped in"] = hashlib.sha256(b"yes").hexdigest()
    found = export.digests(spark, f"{tmp_path}/b")
    read = export.source_lines(spark, f"{tmp_path}/b/records", True)
    # The driver has listed no file.
    assert list(found.inputFiles()) == [] and list(read.inputFiles()) == []
    assert {r.file: r.sha256 for r in found.collect()} == wanted
    whole = {s: [x for (t, _), rows in lines.items() if t == s for x in rows] for s, _ in lines}
    for split in (1, 7, 1 << 20):
        rows = export.source_lines(spark, f"{tmp_path}/b/records", True, split).select("source_id", "ordinal", F.col("value").cast("binary").alias("v")).collect()
        assert {s: [bytes(r.v) for r in sorted((r for r in rows if r.source_id == s), key=lambda r: r.ordinal)] for s in whole} == whole
        assert sorted(r.ordinal for r in rows if r.source_id == "a/b") == [1, 2, 3, 4, 5, 6]
