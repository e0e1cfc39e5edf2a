"""Queries over files and bundles: frames, notes, registries, receipts, signatures, export and re-verification."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.base import Tables, query
from tidemark.catalog.chaining import LEAF_SQL, PREFIX_SQL, segment_sizes, whole_leaves
from tidemark.catalog.logs import BODY_SQL, CAPTURED_SQL, DAY_US, TAMPER_SQL, WHOLE_SQL, frames, stored_frames, tampered, whole_log
from tidemark.catalog.sqltext import root_name
from tidemark.functions.hashing import base64_text, hex_lower, key_id, leaf_hash
from tidemark.functions.notes import SIGNATURE_PREFIX, checkpoint_text
from tidemark.functions.times import parse_pinned_ns
from tidemark.operators import chain, checkpoints as cps, export
from tidemark.operators.merkle import merkle_roots, prefix_roots
from tidemark.plans import bundles as plan
from tidemark.session import scratch_path
from tidemark.sources import frames as fr
from tidemark.sources import registries as reg
from tidemark.sources.store import materialise

# Fixture signers: capture agents hold real keys, these come from fixed seeds.
SIGNERS, STRANGER = 5, 99


def _seed(number: int) -> bytes:
    return hashlib.sha256(f"fixture signer {number}".encode()).digest()


@F.pandas_udf(T.BinaryType())
def public_keys(numbers: pd.Series) -> pd.Series:
    from tidemark.functions.ed25519 import public_key

    return numbers.map(lambda n: public_key(_seed(int(n))))


@F.pandas_udf(T.BinaryType())
def signatures(numbers: pd.Series, texts: pd.Series) -> pd.Series:
    from tidemark.functions.ed25519 import sign

    return pd.Series([sign(_seed(int(n)), m.encode()) for n, m in zip(numbers, texts)])


def signers(t: Tables) -> DataFrame:
    """Registered keys of the event log, one per region."""
    return t.read("region").select(
        F.lit("events").alias("source_id"), F.lit("log/events").alias("origin"), F.col("r_regionkey").cast("bigint").alias("reg_pos"),
        F.concat(F.lit("signer-g"), F.col("r_regionkey").cast("string")).alias("key_name"), public_keys("r_regionkey").alias("public_key"))


def sign_notes(rows: DataFrame, number, name) -> DataFrame:
    """Adds note: the text, a blank line and one signature line by fixture signer ``number``."""
    # Signing is much work for few bytes, as is checking.
    spread = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "source_id", "pos")
    keyed = spread.withColumns({"_n": number, "_name": name})
    keyed = keyed.withColumns({"_key": public_keys("_n"), "_sig": signatures("_n", "text")})
    blob = base64_text(F.concat(F.unhex(key_id(F.col("_name"), F.col("_key"))), F.col("_sig")))
    note = F.concat("text", F.lit("\n" + SIGNATURE_PREFIX), "_name", F.lit(" "), blob, F.lit("\n"))
    return keyed.withColumn("note", note).drop("_n", "_name", "_key", "_sig")


def event_notes(t: Tables) -> DataFrame:
    """A signed note per 256 events; some changed after signing, some by an unregistered signer."""
    roots = prefix_roots(whole_leaves(t), segment_sizes(t))
    texts = roots.select("source_id", F.col("size").alias("pos"), "size", "root", checkpoint_text(F.lit("log/events"), F.col("size"), F.col("root")).alias("text"))
    block = F.call_function("div", F.col("size") + 255, F.lit(256).cast("bigint"))
    number = F.when(block % 7 == 5, F.lit(STRANGER)).otherwise(block % SIGNERS).cast("int")
    name = F.concat(F.lit("signer-g"), (block % SIGNERS).cast("string"))
    signed = sign_notes(texts, number, name)
    changed = F.replace(F.col("note"), F.lit("log/events"), F.lit("log/Events"))
    return signed.withColumn("note", F.when(block % 7 == 3, changed).otherwise(F.col("note"))).drop("text")


@query("checkpoint_sigs", f"""WITH {WHOLE_SQL}, sizes AS (SELECT max(seq) AS size FROM whole_log GROUP BY (seq - 1) // 256)
SELECT 'events' AS source_id, size AS pos, (size + 255) // 256 % 7 NOT IN (3, 5) AS sig_ok FROM sizes""")
def checkpoint_sigs(t: Tables):
    notes = materialise(event_notes(t), "notes")
    return cps.verify_signatures(notes, signers(t)).select("source_id", "pos", "sig_ok")


@query("scan_checkpoints", f"""WITH {PREFIX_SQL}
SELECT 'log/' || CASE WHEN (size + 255) // 256 % 7 = 3 THEN 'Events' ELSE 'events' END AS origin, size, h AS root FROM {root_name('p')}""")
def scan_checkpoints(t: Tables):
    # Notes are persisted as one JSON string per line and read back.
    path = scratch_path(t.spark, "notes")
    quoted = F.to_json(F.array("note"))
    event_notes(t).select(F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("value")).write.text(path)
    parsed = cps.parse_notes(reg.scan_notes(t.spark, path))
    return parsed.select("origin", "size", hex_lower(F.col("root")).alias("root"))


REGISTRY_SQL = """registry AS (SELECT 's' || (c_custkey % 700) AS source_id, 'log/' || (c_custkey % 700) || '/' || (c_custkey // 700 % 2) AS origin, c_name AS key_name, sha256(c_name) AS public_key, c_custkey FROM customer)"""


def written_registry(t: Tables) -> str:
    """Registry documents of up to a hundred keys each, in order of registration."""
    path = scratch_path(t.spark, "registry")
    key = F.col("c_custkey")
    entry = F.struct(
        F.concat(F.lit("s"), (key % 700).cast("string")).alias("source_id"),
        F.concat(F.lit("log/"), (key % 700).cast("string"), F.lit("/"), (F.call_function("div", key, F.lit(700).cast("bigint")) % 2).cast("string")).alias("origin"),
        F.col("c_name").alias("key_name"), base64_text(F.unhex(F.sha2(F.encode("c_name", "UTF-8"), 256))).alias("public_key"))
    documents = (t.read("customer").groupBy(F.call_function("div", key, F.lit(100).cast("bigint")).alias("doc"))
                 .agg(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), entry.alias("e")))), lambda x: x["e"]).alias("sources")))
    documents.repartitionByRange(4, "doc").sortWithinPartitions("doc").select("sources").write.json(path)
    return path


@query("scan_registry", f"WITH {REGISTRY_SQL} SELECT source_id, origin, key_name, public_key FROM registry")
def scan_registry(t: Tables):
    return reg.scan_registry(t.spark, written_registry(t)).withColumn("public_key", hex_lower(F.col("public_key"))).drop("reg_pos")


@query("registry_heads", f"""WITH {REGISTRY_SQL} SELECT source_id, max_by(origin, c_custkey) AS origin, max_by(key_name, c_custkey) AS key_name,
  max_by(substr(sha256(encode(key_name) || unhex('0A01') || unhex(public_key)), 1, 8), c_custkey) AS key_id, count(*) AS keys FROM registry GROUP BY source_id""")
def registry_heads(t: Tables):
    return cps.registry_heads(reg.scan_registry(t.spark, written_registry(t)))


@query("scan_receipts", """SELECT 'log/' || (o_custkey % 40) AS origin, o_orderkey AS size, to_base64(unhex(sha256(o_orderpriority))) AS root_b64, 'tsa' AS tsa,
  sha256(CAST(o_orderkey AS VARCHAR)) AS imprint, epoch_us(o_orderdate) * 1000 AS gen_ns, o_orderkey % 2 = 0 AS qualified FROM orders""")
def scan_receipts(t: Tables):
    path = scratch_path(t.spark, "receipts")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000000Z"))
    t.read("orders").select(
        F.concat(F.lit("log/"), (F.col("o_custkey") % 40).cast("string")).alias("origin"), F.col("o_orderkey").alias("size"),
        base64_text(F.unhex(F.sha2(F.encode("o_orderpriority", "UTF-8"), 256))).alias("root"), F.lit("tsa").alias("tsa"), F.lit("").alias("token"),
        F.sha2(F.encode(F.col("o_orderkey").cast("string"), "UTF-8"), 256).alias("imprint"), stamp.alias("gen_time"), stamp.alias("anchored_at"),
        (F.col("o_orderkey") % 2 == 0).alias("qualified")).write.json(path)
    return reg.scan_receipts(t.spark, path).select(
        "origin", "size", "root_b64", "tsa", hex_lower(F.col("imprint")).alias("imprint"), parse_pinned_ns(F.col("gen_time")).alias("gen_ns"), "qualified")


BLOB_FRAMES = 16


def blobs(t: Tables) -> DataFrame:
    """Segment blobs of the users' chains, 16 frames each."""
    encoded = fr.frame_bytes(F.col("record_bytes"), F.unhex("claimed_hash"))
    segment = F.call_function("div", F.col("seq") - 1, F.lit(BLOB_FRAMES).cast("bigint"))
    packed = F.sort_array(F.collect_list(F.struct("seq", F.hex(encoded).alias("h"))))
    content = F.unhex(F.array_join(F.transform(packed, lambda x: x["h"]), ""))
    return (frames(t).groupBy("source_id", segment.alias("segment")).agg(content.alias("content"))
            .withColumn("path", F.concat("source_id", F.lit("/"), F.col("segment").cast("string"))))


@query("scan_frames", f"""WITH RECURSIVE {BODY_SQL} SELECT source_id || '/' || ((seq - 1) // 16) AS path, (seq - 1) % 16 AS frame_pos, record, claimed_hash, CAST(NULL AS VARCHAR) AS error FROM frames""")
def scan_frames(t: Tables):
    return fr.decode_frames(blobs(t)).select("path", "frame_pos", F.col("record_bytes").cast("string").alias("record"), "claimed_hash", "error")


@query("scan_corruption", f"""WITH RECURSIVE {BODY_SQL}, b AS (SELECT source_id, (seq - 1) // 16 AS segment, count(*) AS n, min(seq) AS first, max(seq) AS last FROM frames GROUP BY ALL)
SELECT source_id || '/' || segment AS path, CASE WHEN (CAST(source_id AS BIGINT) + segment) % 5 = 1 THEN 'truncated' ELSE 'hash mismatch' END AS reason,
  CASE WHEN (CAST(source_id AS BIGINT) + segment) % 5 = 1 THEN n - 1 ELSE 0 END AS frame_pos,
  CASE WHEN (CAST(source_id AS BIGINT) + segment) % 5 = 1 AND n > 1 THEN last - 1 END AS last_good_seq FROM b WHERE (CAST(source_id AS BIGINT) + segment) % 5 IN (1, 2)""")
def scan_corruption(t: Tables):
    # Some blobs lose their last ten bytes, some have a byte of their first record changed.
    m = (F.col("source_id").cast("bigint") + F.col("segment")) % 5
    text = F.hex("content")
    cut = F.substring(text, F.lit(1), F.length(text) - 20)
    flipped = F.overlay(text, F.lit("20"), F.lit(31))
    damaged = blobs(t).withColumn("content", F.unhex(F.when(m == 1, cut).when(m == 2, flipped).otherwise(text)))
    return fr.corruption_report(fr.decode_frames(damaged))


FROM_NS, TO_NS = 1704500000_000000000, 1706000000_000000000
CHOSEN = export.RecordFilter(from_seq=100, to_seq=9000, from_ns=FROM_NS, to_ns=TO_NS, actor="u17")


def whole_records(t: Tables) -> DataFrame:
    record = chain.parse_record(F.col("record_bytes"))
    return whole_log(t).select("source_id", "seq", "time_ns", record["actor"].alias("actor"), F.sha2("record_bytes", 256).alias("record_hash"))


@query("export_filter", f"""WITH {WHOLE_SQL} SELECT seq, sha256(record) AS record_hash FROM whole_log
WHERE seq BETWEEN 100 AND 9000 AND time_ns BETWEEN {FROM_NS} AND {TO_NS} AND json_extract_string(record, '$.actor') = 'u17'""")
def export_filter(t: Tables):
    return whole_records(t).where(CHOSEN.condition()).select("seq", "record_hash")


def chained_records(t: Tables) -> DataFrame:
    return frames(t).select("source_id", "seq", F.lit("").alias("actor"), F.lit(None).cast("bigint").alias("time_ns"), F.col("claimed_hash").alias("record_hash"))


MANIFEST_SQL = """manifests AS (SELECT source_id, count(*) FILTER (k) AS record_count, min(seq) FILTER (k) AS first_seq, max(seq) FILTER (k) AS last_seq,
  min_by(claimed_hash, seq) FILTER (k) AS first_hash, max_by(claimed_hash, seq) FILTER (k) AS last_hash, max_by(claimed_hash, seq) AS chain_head, 'seq 3..40' AS filter
  FROM (SELECT *, seq BETWEEN 3 AND 40 AS k FROM frames) GROUP BY source_id)"""


@query("export_manifest", f"WITH RECURSIVE {BODY_SQL}, {MANIFEST_SQL} SELECT * FROM manifests")
def export_manifest(t: Tables):
    return export.manifest_facts(chained_records(t), export.RecordFilter(from_seq=3, to_seq=40))


@query("bundle_records", f"""WITH RECURSIVE {BODY_SQL}, {MANIFEST_SQL} SELECT source_id, CASE CAST(source_id AS BIGINT) % 4 WHEN 1 THEN 'record_count ' || record_count || ' != manifest ' || (record_count + 1)
  WHEN 2 THEN 'last_seq ' || last_seq || ' != manifest ' || (last_seq + 1) || '; last_record_sha256 mismatch' ELSE '' END AS mismatches FROM manifests""")
def bundle_records(t: Tables):
    found = export.manifest_facts(chained_records(t), export.RecordFilter(from_seq=3, to_seq=40))
    m = F.col("source_id").cast("bigint") % 4
    stated = found.withColumns({
        "record_count": F.col("record_count") + F.when(m == 1, 1).otherwise(0), "last_seq": F.col("last_seq") + F.when(m == 2, 1).otherwise(0),
        "last_hash": F.when(m == 2, F.reverse("last_hash")).otherwise(F.col("last_hash"))})
    return export.compare_records(found, stated)


# Bundles of all users together, in files of 4 KB. Some users' records are damaged before they are bundled, some users' notes
# are signed by nobody who is registered. Users whose damage cuts a record off are left out.
BUNDLE_BYTES = 4096
LINES_SQL = """lines AS (SELECT source_id, ordinal AS seq, strlen(record) + 1 AS size, sum(strlen(record) + 1) OVER (PARTITION BY source_id ORDER BY ordinal) - strlen(record) - 1 AS ahead,
  sha256(record) AS h FROM tampered WHERE CAST(source_id AS BIGINT) % 7 <> 6),
record_files AS (SELECT source_id, count(DISTINCT ahead // 4096) AS files FROM lines GROUP BY source_id)"""


def written_bundles(t: Tables) -> tuple[str, DataFrame]:
    """Bundles of all users with signed notes; their folder and the registered keys."""
    chained = stored_frames(t)
    user = F.col("source_id").cast("bigint")
    kept = materialise(tampered(t, chained).where(user % 7 != 6), "bundle-records")
    sources = chained.where(user % 7 != 6)
    leaves = sources.select("source_id", (F.col("seq") - 1).alias("idx"), leaf_hash(F.col("record_bytes")).alias("leaf"))
    origin = F.concat(F.lit("log/"), "source_id")
    texts = merkle_roots(leaves).select("source_id", F.col("size").alias("pos"), checkpoint_text(origin, F.col("size"), F.col("root")).alias("text"))
    notes = materialise(sign_notes(texts, F.when(user % 5 == 2, F.lit(STRANGER)).otherwise(F.lit(0)), F.lit("signer-g0")), "signed")
    key = t.read("region").limit(1).select(F.lit("signer-g0").alias("key_name"), public_keys(F.lit(0)).alias("public_key"))
    keys = materialise(texts.select("source_id", origin.alias("origin")).crossJoin(F.broadcast(key)), "signers")
    records = kept.select("source_id", F.col("ordinal").alias("seq"), F.lit("").alias("actor"), F.lit(None).cast("bigint").alias("time_ns"),
                          F.sha2("record_bytes", 256).alias("record_hash"), "record_bytes")
    path = scratch_path(t.spark, "bundles")
    export.write_bundles(records, export.RecordFilter(), path, notes, keys.withColumn("public_key", base64_text(F.col("public_key"))), file_bytes=BUNDLE_BYTES)
    return path, keys


@query("export_bundle", f"""WITH RECURSIVE {TAMPER_SQL}, {LINES_SQL} SELECT l.source_id, count(*) AS record_count, min(seq) AS first_seq, max(seq) AS last_seq, min_by(h, seq) AS first_hash,
  max_by(h, seq) AS last_hash, max_by(h, seq) AS chain_head, 'none (whole source)' AS filter, any_value(files) + 2 AS files FROM lines l JOIN record_files USING (source_id) GROUP BY l.source_id""")
def export_bundle(t: Tables):
    path, _ = written_bundles(t)
    facts, listed = export.read_manifest(t.spark, path)
    per = t.spark.read.schema("source_id string, file string, sha256 string").json(f"{path}/manifest-files").groupBy("source_id").agg(F.count("*").alias("files"))
    return facts.join(per, "source_id")


@query("bundle_files", f"""WITH RECURSIVE {TAMPER_SQL}, {LINES_SQL}
SELECT 'records' AS kind, 'ok' AS status, CAST(sum(files) AS BIGINT) AS files FROM record_files UNION ALL SELECT 'records', 'missing', 1
UNION ALL SELECT 'checkpoints', 'mismatch', count(*) FROM record_files UNION ALL SELECT 'keys', 'unlisted', count(*) FROM record_files""")
def bundle_files(t: Tables):
    # The listing is altered: one kind of file gets a wrong hash, one kind is not listed, one listed file is not there.
    path, _ = written_bundles(t)
    _, listed = export.read_manifest(t.spark, path)
    is_notes = F.col("file").startswith("checkpoints/")
    altered = listed.withColumn("sha256", F.when(is_notes, F.reverse("sha256")).otherwise(F.col("sha256")))
    extra = listed.limit(1).select(F.lit("records/source=0/file=lost").alias("file"), F.col("sha256"))
    compared = export.compare_files(altered.where(~F.col("file").startswith("keys/")).unionByName(extra), export.digests(t.spark, path).drop("source_id"))
    return compared.groupBy(F.substring_index("file", "/", 1).alias("kind"), "status").agg(F.count("*").alias("files"))


@query("bundle_verdict", f"""WITH {CAPTURED_SQL} SELECT source_id, NOT (u % 7 = 3 AND n >= 5 OR u % 7 = 4 AND n >= 6 OR u % 7 = 5 AND n >= 8) AND u % 5 <> 2 AS ok
FROM (SELECT source_id, CAST(source_id AS BIGINT) AS u, count(*) AS n FROM captured GROUP BY source_id) WHERE u % 7 <> 6""")
def bundle_verdict(t: Tables):
    path, keys = written_bundles(t)
    stored = reg.notes_of(export.source_lines(t.spark, f"{path}/checkpoints", False), ["source_id"]).select("source_id", "note")
    notes = cps.parse_notes(stored).withColumn("pos", F.col("size"))
    checked = materialise(cps.verify_signatures(notes, keys), "checked")
    return plan.bundle_verdict(plan.verify_bundles(t.spark, path, checked)).select("source_id", "ok")
