"""Files: gzip inputs, blobs read from disk, bundles, notes, live intake."""

import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import export
from tidemark.operators.mapping import map_lines
from tidemark.plans.bundles import bundle_verdict, verify_bundle
from tidemark.sources import frames as fr
from tidemark.sources import jsonl
from tidemark.sources import registries as reg
from tidemark.sources.profiles import load_profile
from tests.test_captured import BEATS, frames, records


def test_gzip_and_caps(spark, tmp_path):
    lines = [f'{{"source":"s","seq":{i},"time":"2026-03-01T00:00:00Z"}}' for i in range(1, 11)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:5]) + "\n\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as out:
        out.write("\n".join(lines[5:]))
    mapped = map_lines(jsonl.scan_jsonl(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz")]), load_profile("generic"))
    assert [int(r["seq"]) for r in jsonl.with_ordinals(mapped).orderBy("ordinal").collect()] == list(range(1, 11))
    capped = jsonl.apply_caps(mapped, 4, 0)
    assert capped.count() == 4 and jsonl.truncation(capped, 4, 0).first()["truncated"]
    assert not jsonl.truncation(mapped, 0, 0).first()["truncated"]


def test_blobs_from_disk(spark, tmp_path):
    rows = records(BEATS)
    encode = lambda r: bytes([len(r[2]) & 127 | 128, len(r[2]) >> 7]) + bytes(r[2]) + bytes.fromhex(r[3])
    good = b"".join(map(encode, rows))
    (tmp_path / "good.seg").write_bytes(good)
    (tmp_path / "short.seg").write_bytes(good[:-3])
    (tmp_path / "zero.seg").write_bytes(encode(rows[0]) + b"\x00")
    decoded = fr.decode_frames(fr.read_blobs(spark, str(tmp_path)))
    assert decoded.where("error IS NULL").count() == 5 + 4 + 1
    report = {r["path"].rsplit("/", 1)[1]: (r["reason"], r["last_good_seq"]) for r in fr.corruption_report(decoded).collect()}
    assert report == {"short.seg": ("truncated", 4), "zero.seg": ("implausible length", 1)}


def bundle(spark, path, chosen=export.RecordFilter()):
    data = frames(spark, records(BEATS)).select(
        "source_id", (F.col("ordinal") + 1).alias("seq"), F.lit("").alias("actor"), F.lit(None).cast("bigint").alias("time_ns"),
        F.col("claimed_hash").alias("record_hash"), "record_bytes")
    export.write_bundle(data, chosen, path)


def test_bundle_and_changed_record(spark, tmp_path):
    path = str(tmp_path / "b")
    bundle(spark, path)
    assert bundle_verdict(verify_bundle(spark, path)).first()["ok"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        bundle(spark, path)
    part = next(p for p in glob.glob(f"{path}/records.jsonl/part-*") if open(p).read())
    text = open(part).read()
    for hidden in glob.glob(f"{path}/records.jsonl/.*.crc"):
        open(hidden, "wb").close()
    open(part, "w").write(text.replace("system.heartbeat", "system.heartbeaT", 1))
    failed = {r["label"] for r in verify_bundle(spark, path).where("status = 'fail'").collect()}
    assert {"file integrity", "hash chain"} <= failed


def test_filtered_bundle_rests_on_hashes(spark, tmp_path):
    path = str(tmp_path / "b")
    bundle(spark, path, export.RecordFilter(from_seq=2, to_seq=3))
    checks = {r["label"]: r["status"] for r in verify_bundle(spark, path).collect()}
    assert checks == {"file integrity": "pass", "record integrity": "pass", "chain/checkpoints": "info"}


def test_filter_text():
    assert export.RecordFilter().text() == "none (whole source)"
    assert export.RecordFilter(from_seq=2, actor="a").text() == "seq 2..0; actor=a"


def test_bundle_notes_are_split(spark, tmp_path):
    notes = [f"log/s\n{n}\nAAAA\n\n— signer BBBB\n" for n in (1, 2)]
    (tmp_path / "checkpoints.txt").write_text("".join(notes))
    assert [r["note"] for r in reg.split_bundle_notes(spark, str(tmp_path / "checkpoints.txt")).orderBy("pos").collect()] == notes


def test_bad_registry_key_fails(spark, tmp_path):
    (tmp_path / "keys.json").write_text('{"sources":[{"source_id":"s","origin":"o","key_name":"k","public_key":"AAAA"}]}')
    with pytest.raises(Exception, match="bad public key"):
        reg.scan_registry(spark, str(tmp_path / "keys.json"), whole_files=True).collect()


def test_pseudonyms_follow_the_salt_table(spark):
    import hmac

    from tidemark.operators import pseudonyms as ps

    salt = bytes(range(32))
    salts = spark.createDataFrame([("ann", bytearray(salt))], "actor string, salt binary")
    events = spark.createDataFrame([("ann",), ("bob",)], "actor string")
    got = {r["actor"]: r["pseudonym"] for r in ps.pseudonymise(events, salts).collect()}
    assert got == {"ann": hmac.new(salt, b"ann", hashlib.sha256).hexdigest(), "bob": None}
    minted = ps.mint_salts(ps.new_actors(events, salts), "2026-01-01T00:00:00Z").collect()
    assert [r["actor"] for r in minted] == ["bob"] and len(minted[0]["salt"]) == 32
