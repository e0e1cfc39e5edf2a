"""Queries over captured records: hashes, chains, digests, Merkle roots and proofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import Tables, query
from tidemark.catalog.logs import (
    BODY_SQL, CAPTURED_SQL, TAMPER_SQL, WHOLE_SQL, bodies, captured, frames, tampered, whole_log,
)
from tidemark.catalog.sqltext import LEVELS, merkle_sql, root_name
from tidemark.functions.hashing import hex_lower, leaf_hash, sha_bin, sha_hex
from tidemark.operators import chain as c
from tidemark.operators import proofs as p
from tidemark.operators.digests import ordered_digests
from tidemark.operators.merkle import TILE, build_tiles, merkle_roots, prefix_roots
from tidemark.plans.tiles import TileLog
from tidemark.session import scratch_path
from tidemark.sources.store import materialise

FIELDS = ["v", "source_id", "seq", "event_type", "event_time", "payload_clear", "key_id", "prev_hash"]


def whole_leaves(t: Tables):
    return whole_log(t).select("source_id", (F.col("seq") - 1).alias("idx"), leaf_hash(F.col("record_bytes")).alias("leaf"))


LEAF_SQL = f"""{WHOLE_SQL},
leaves AS (SELECT source_id, seq - 1 AS i, sha256(unhex('00') || encode(record)) AS h FROM whole_log)"""
SIZES_SQL = """sizes AS (SELECT source_id, max(seq) AS size FROM whole_log GROUP BY source_id, (seq - 1) // 256),
prefix_leaves AS (SELECT l.source_id, s.size, l.i, l.h FROM leaves l JOIN sizes s ON l.source_id = s.source_id AND l.i < s.size)"""


def segment_sizes(t: Tables):
    log = whole_log(t)
    segment = F.call_function("div", F.col("seq") - 1, F.lit(256).cast("bigint"))
    return log.groupBy("source_id", segment.alias("segment")).agg(F.max("seq").alias("size")).select("source_id", "size")


@query("record_hash", f"WITH {WHOLE_SQL} SELECT seq, sha256(record) AS record_hash FROM whole_log")
def record_hash(t: Tables):
    return whole_log(t).select("seq", sha_hex(F.col("record_bytes")).alias("record_hash"))


@query("leaf_hash", f"WITH {LEAF_SQL} SELECT i AS idx, h AS leaf FROM leaves")
def leaf_hashes(t: Tables):
    return whole_leaves(t).select("idx", hex_lower(F.col("leaf")).alias("leaf"))


@query("payload_hash", """SELECT event_id, sha256(props) AS payload_hash FROM events""")
def payload_hash(t: Tables):
    return t.read("events").select("event_id", F.sha2(F.encode("props", "UTF-8"), 256).alias("payload_hash"))


@query("assign_seq", """SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS ordinal,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) + user_id % 5 AS seq FROM events""")
def assign_seq(t: Tables):
    log = captured(t).select("source_id", "ordinal")
    heads = log.select("source_id").distinct().withColumn("last_seq", F.col("source_id").cast("bigint") % 5)
    return c.assign_sequence(log, "ordinal", heads)


@query("chain_build", f"""WITH RECURSIVE {BODY_SQL}
SELECT source_id, seq, record, claimed_hash AS record_hash FROM frames""")
def chain_build(t: Tables):
    return frames(t).select("source_id", "seq", F.col("record_bytes").cast("string").alias("record"),
                            F.col("claimed_hash").alias("record_hash"))


@query("parse_records", f"""WITH RECURSIVE {BODY_SQL}
SELECT CAST(json_extract_string(record, '$.v') AS INTEGER) AS v, source_id, seq, json_extract_string(record, '$.event_type') AS event_type,
  json_extract_string(record, '$.event_time') AS event_time,
  json_extract(record, '$.payload_clear.health.clock_drift_ms')::VARCHAR AS drift,
  json_extract_string(record, '$.key_id') AS key_id,
  json_extract_string(record, '$.prev_hash') AS prev_hash, sha256(record) AS record_hash, false AS parse_error FROM frames""")
def parse_records(t: Tables):
    parsed = c.parsed_frames(frames(t).drop("source_id", "seq"))
    fields = parsed.select("record.*", "record_hash", "parse_error")
    return fields.select(
        "v", "source_id", "seq", "event_type", "event_time",
        F.get_json_object("payload_clear", "$.health.clock_drift_ms").alias("drift"), "key_id", "prev_hash",
        "record_hash", "parse_error")


def checked(t: Tables):
    # Written once: the chain behind it is serial.
    parsed = c.parsed_frames(tampered(t))
    return materialise(parsed.select("source_id", "ordinal", "claimed_hash", "record_hash", "parse_error",
                                     F.col("record.seq").alias("seq"), F.col("record.prev_hash").alias("prev_hash")), "checked")


CHECK_SQL = f"""{TAMPER_SQL},
checked AS (SELECT source_id, ordinal, claimed_hash, sha256(record) AS record_hash, NOT json_valid(record) AS parse_error,
  CASE WHEN json_valid(record) THEN CAST(json_extract_string(record, '$.seq') AS BIGINT) END AS seq,
  CASE WHEN json_valid(record) THEN json_extract_string(record, '$.prev_hash') END AS prev_hash FROM tampered),
linked AS (SELECT *, lag(seq) OVER w AS pseq, lag(record_hash) OVER w AS phash FROM checked
  WINDOW w AS (PARTITION BY source_id ORDER BY ordinal)),
errors AS (SELECT source_id, ordinal, kind, CASE kind
    WHEN 'hash' THEN 'chain: seq ' || (coalesce(pseq, 0) + 1) || ' hash mismatch: claimed ' || claimed_hash || ' computed ' || record_hash
    WHEN 'parse' THEN 'chain: record does not parse'
    WHEN 'gap' THEN 'chain: sequence gap: expected seq ' || (coalesce(pseq, 0) + 1) || ', got ' || seq
    WHEN 'link' THEN 'chain: seq ' || seq || ' prev_hash mismatch: expected ' || coalesce(phash, repeat('0', 64)) || ', got ' || prev_hash
  END AS message FROM (SELECT *, CASE WHEN record_hash <> claimed_hash THEN 'hash' WHEN parse_error THEN 'parse'
    WHEN phash IS NOT NULL AND seq <> coalesce(pseq, 0) + 1 THEN 'gap' WHEN prev_hash <> coalesce(phash, repeat('0', 64)) THEN 'link' END AS kind
    FROM linked) WHERE kind IS NOT NULL),
first_errors AS (SELECT source_id, min_by(kind, ordinal) AS kind, min_by(message, ordinal) AS message FROM errors GROUP BY source_id),
verdicts AS (SELECT source_id, kind IS NULL AS chain_valid, kind, message
  FROM (SELECT DISTINCT source_id FROM checked) LEFT JOIN first_errors USING (source_id))"""


@query("chain_verify", f"WITH RECURSIVE {CHECK_SQL} SELECT * FROM verdicts")
def chain_verify(t: Tables):
    return c.chain_verdicts(checked(t))


@query("frame_hash_check", f"""WITH RECURSIVE {TAMPER_SQL}
SELECT source_id, ordinal, CASE WHEN length(claimed_hash) <> 64 THEN 'digest_length' WHEN length(record) = 0 THEN 'frame_length'
  WHEN sha256(record) <> claimed_hash THEN 'hash_mismatch' ELSE 'ok' END AS status FROM tampered""")
def frame_hash_check(t: Tables):
    from tidemark.operators.intake import frame_status

    return tampered(t).select("source_id", "ordinal", frame_status().alias("status"))


@query("captured_span", f"""WITH RECURSIVE {BODY_SQL}
SELECT source_id, count(*) AS records, min_by(seq, seq) AS seq_first, max_by(seq, seq) AS seq_last, max_by(claimed_hash, seq) AS chain_head,
  min(json_extract_string(record, '$.event_time')) AS time_first, max(json_extract_string(record, '$.event_time')) AS time_last,
  false AS encrypted, coalesce(arg_min(json_extract_string(record, '$.key_id'), seq) FILTER (json_extract_string(record, '$.key_id') IS NOT NULL), '') AS key_id
FROM frames GROUP BY source_id""")
def captured_span(t: Tables):
    from tidemark.operators.captured import captured_spans, records_of
    from tidemark.functions.times import format_pinned

    spans = captured_spans(records_of(frames(t).withColumnRenamed("seq", "ordinal")))
    return spans.select(
        "source_id", "records", "seq_first", "seq_last", "chain_head", format_pinned(F.col("first_ns")).alias("time_first"),
        format_pinned(F.col("last_ns")).alias("time_last"), "encrypted", "key_id")


@query("input_digest", f"""WITH {WHOLE_SQL},
leaves AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) - 1 AS i, sha256(unhex('00') || unhex(sha256(record))) AS h FROM whole_log),
{merkle_sql('leaves', 'd')}
SELECT source_id, records, h AS digest FROM {root_name('d')} JOIN (SELECT source_id, count(*) AS records FROM leaves GROUP BY source_id) USING (source_id)""")
def input_digest(t: Tables):
    hashed = whole_log(t).select("source_id", "ordinal", sha_bin(F.col("record_bytes")).alias("hash"))
    return ordered_digests(hashed, "source_id", "ordinal", "hash")


@query("merkle_root", f"""WITH {LEAF_SQL}, {merkle_sql('leaves', 'm')}
SELECT r.source_id, (SELECT count(*) FROM leaves) AS size, h AS root FROM {root_name('m')} r""")
def merkle_root(t: Tables):
    return merkle_roots(whole_leaves(t)).select("source_id", "size", hex_lower(F.col("root")).alias("root"))


PREFIX_SQL = f"{LEAF_SQL}, {SIZES_SQL}, {merkle_sql('prefix_leaves', 'p', 'source_id, size')}"


@query("prefix_roots", f"WITH {PREFIX_SQL} SELECT source_id, size, h AS root FROM {root_name('p')}")
def prefix_root(t: Tables):
    return prefix_roots(whole_leaves(t), segment_sizes(t)).select("source_id", "size", hex_lower(F.col("root")).alias("root"))


def asked_inclusions(t: Tables):
    # Every record proven in the tree of the first checkpoint that covers it; each record once.
    log = whole_log(t)
    segment = F.call_function("div", F.col("seq") - 1, F.lit(256).cast("bigint"))
    last = log.groupBy("source_id").agg(F.max("seq").alias("last"))
    return materialise(log.join(last, "source_id").select(
        "source_id", (F.col("seq") - 1).alias("idx"), F.least((segment + 1) * 256, F.col("last")).alias("size")), "asked")


def inclusion_rows(t: Tables):
    leaves = whole_leaves(t)
    tiles = build_tiles(leaves)
    roots = prefix_roots(tiles, segment_sizes(t))
    # Leaves and roots are met first: paths are long, and are not shuffled. Leaves of one number stay together, so that nothing is asked for more often.
    own = leaves.groupBy("source_id", "idx").agg(F.collect_list(F.struct("leaf")).alias("own"))
    asked = asked_inclusions(t).join(own.hint("merge"), ["source_id", "idx"]).join(roots, ["source_id", "size"])
    return p.inclusion_proofs(tiles, asked).select("source_id", "idx", "size", "root", "path", F.expr("inline(own)"))


def levels_sql(columns: str) -> str:
    """The levels of all prefix trees as one table (l, columns)."""
    return " UNION ALL ".join(f"SELECT {n} AS l, {columns} FROM {'prefix_leaves' if n == 0 else f'p_{n}'}" for n in range(LEVELS + 1))


@query("inclusion_proofs", f"""WITH {PREFIX_SQL}, levels AS ({levels_sql('size, i, h')}),
asked AS (SELECT source_id, seq - 1 AS idx, least(((seq - 1) // 256 + 1) * 256, (SELECT max(seq) FROM whole_log)) AS size FROM whole_log),
steps AS (SELECT source_id, idx, a.size, l, h FROM asked a JOIN levels v ON v.size = a.size AND v.i = xor(a.idx >> l, 1))
SELECT a.source_id, a.idx, a.size, coalesce(path, []) AS path FROM asked a LEFT JOIN (SELECT idx, list(h ORDER BY l) AS path FROM steps GROUP BY idx) USING (idx)""")
def inclusion_proofs(t: Tables):
    proofs = p.inclusion_proofs(whole_leaves(t), asked_inclusions(t))
    return proofs.select("source_id", "idx", "size", F.transform("path", lambda h: F.lower(F.hex(h))).alias("path"))


@query("inclusion_verify", f"""WITH {WHOLE_SQL} SELECT source_id, seq - 1 AS idx,
  least(((seq - 1) // 256 + 1) * 256, (SELECT max(seq) FROM whole_log)) AS size, (seq - 1) % 10 <> 3 AS included FROM whole_log""")
def inclusion_verify(t: Tables):
    # One record in ten is altered after its proof was made and must fail.
    rows = inclusion_rows(t)
    altered = F.when(F.col("idx") % 10 == 3, F.reverse(F.hex("leaf"))).otherwise(F.hex("leaf"))
    return p.verify_inclusion(rows.withColumn("leaf", F.unhex(altered))).select("source_id", "idx", "size", "included")


def asked_consistency(t: Tables):
    """Each checkpoint size with the next one, and each with the final size."""
    sizes = segment_sizes(t)
    segment = F.call_function("div", F.col("size") + 255, F.lit(256).cast("bigint"))
    numbered = sizes.withColumn("n", segment)
    following = numbered.select("source_id", (F.col("n") - 1).alias("n"), F.col("size").alias("later"))
    final = sizes.groupBy("source_id").agg(F.max("size").alias("later"))
    steps = numbered.join(following, ["source_id", "n"]).select("source_id", F.col("size").alias("old"), F.col("later").alias("size"))
    ends = sizes.join(final, "source_id").select("source_id", F.col("size").alias("old"), F.col("later").alias("size"))
    return materialise(steps.unionByName(ends).distinct(), "asked")


PAIRS_SQL = """pairs AS (SELECT a.source_id, a.size AS old, b.size FROM sizes a JOIN sizes b ON (b.size + 255) // 256 = (a.size + 255) // 256 + 1
  UNION SELECT source_id, size, (SELECT max(size) FROM sizes) FROM sizes)"""


@query("consistency_proofs", f"""WITH {PREFIX_SQL}, levels AS ({levels_sql('size, i, h')}), {PAIRS_SQL},
begun AS (SELECT *, bit_count(xor(old - 1, old)) - 1 AS s FROM pairs WHERE old < size),
steps AS (SELECT old, b.size, -1 AS l, h FROM begun b JOIN levels v ON v.size = b.size AND v.l = s AND v.i = (old - 1) >> s AND v.i > 0
  UNION ALL SELECT old, b.size, l, h FROM begun b JOIN levels v ON v.size = b.size AND v.l >= s AND v.i = xor((old - 1) >> l, 1))
SELECT p.source_id, p.old, p.size, coalesce(path, []) AS path FROM pairs p LEFT JOIN (SELECT old, size, list(h ORDER BY l) AS path FROM steps GROUP BY old, size) USING (old, size)""")
def consistency_proofs(t: Tables):
    proofs = p.consistency_proofs(whole_leaves(t), asked_consistency(t))
    return proofs.select("source_id", "old", "size", F.transform("path", lambda h: F.lower(F.hex(h))).alias("path"))


@query("consistency_verify", f"""WITH {WHOLE_SQL}, sizes AS (SELECT source_id, max(seq) AS size FROM whole_log GROUP BY source_id, (seq - 1) // 256),
pairs AS (SELECT a.source_id, a.size AS old, b.size FROM sizes a JOIN sizes b ON (b.size + 255) // 256 = (a.size + 255) // 256 + 1
  UNION SELECT source_id, size, (SELECT max(size) FROM sizes) FROM sizes)
SELECT source_id, old, size, (old // 256) % 7 <> 2 AS consistent FROM pairs""")
def consistency_verify(t: Tables):
    # The claimed old root is altered for one size in seven and must fail.
    tiles = build_tiles(whole_leaves(t))
    roots = materialise(prefix_roots(tiles, segment_sizes(t)), "roots")
    proofs = p.consistency_proofs(tiles, asked_consistency(t))
    rows = (proofs.join(roots, ["source_id", "size"])
            .join(roots.select("source_id", F.col("size").alias("old"), F.col("root").alias("old_root")), ["source_id", "old"]))
    altered = F.when(F.call_function("div", F.col("old"), F.lit(256).cast("bigint")) % 7 == 2, F.reverse(F.hex("old_root"))
                     ).otherwise(F.hex("old_root"))
    return p.verify_consistency(rows.withColumn("old_root", F.unhex(altered))).select("source_id", "old", "size", "consistent")


@query("merkle_tiles", f"""WITH {LEAF_SQL}, {merkle_sql('leaves', 'm')}, low AS (SELECT source_id, i // {TILE} AS tile, count(*) AS n FROM leaves GROUP BY ALL),
high AS (SELECT source_id, count(*) AS n FROM low WHERE n = {TILE} GROUP BY source_id)
SELECT low.source_id, 0 AS round, tile, CAST(low.n AS INTEGER) AS n, CASE WHEN low.n = {TILE} THEN h END AS top FROM low LEFT JOIN m_13 ON m_13.source_id = low.source_id AND m_13.i = tile
UNION ALL SELECT source_id, 1, 0, CAST(n AS INTEGER), NULL FROM high""")
def merkle_tiles(t: Tables):
    return build_tiles(whole_leaves(t)).select("source_id", "round", "tile", "n", hex_lower(F.col("top")).alias("top"))


@query("tile_roots", f"WITH {PREFIX_SQL} SELECT source_id, size, h AS root FROM {root_name('p')}")
def tile_roots(t: Tables):
    """Roots from a log of tiles that has grown three times, with one of the batches repeated."""
    leaves = materialise(whole_leaves(t), "leaves")
    third = F.call_function("div", F.col("idx") * 3, F.lit(leaves.count()).cast("bigint"))
    log = TileLog(t.spark, scratch_path(t.spark, "tile-log"))
    for batch in (0, 1, 1, 2):
        log.grow(leaves.where(third == batch), "log", batch)
    return prefix_roots(log.tiles(), segment_sizes(t)).select("source_id", "size", hex_lower(F.col("root")).alias("root"))
