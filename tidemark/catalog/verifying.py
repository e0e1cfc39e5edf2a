"""Queries over captured sources: continuity, transport, checkpoints, anchors, findings and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import Tables, query
from tidemark.catalog.chaining import CHECK_SQL
from tidemark.catalog.logs import (
    CAPTURED_SQL, DAY_US, TAMPER_SQL, captured, sql_duration, sql_minutes, sql_pinned, stored_frames, tampered,
)
from tidemark.catalog.sqltext import merkle_sql, root_name
from tidemark.functions.texts import ADVICE, CHAIN_KINDS, TEXTS, filled_sql, quoted
from tidemark.functions.hashing import base64_text, hex_lower, leaf_hash
from tidemark.operators import captured as cap
from tidemark.operators import checkpoints as cps
from tidemark.operators import continuity as con
from tidemark.operators.merkle import prefix_roots
from tidemark.operators.ordered import stitched_row_number
from tidemark.plans import report
from tidemark.plans import verify as plan
from tidemark.sources.store import materialise

DAY_NS = DAY_US * 1000
HOUR_NS = 3_600_000_000_000
POLICY = plan.VerifyPolicy(interval_ns=12 * HOUR_NS, max_silence_ns=DAY_NS, max_drift_ms=2400)

WINDOWS_SQL = f"""beats AS (SELECT source_id, ordinal, time_ns, row_number() OVER (PARTITION BY source_id ORDER BY time_ns) AS n
  FROM {{log}} WHERE event_type = 'system.heartbeat'),
spans AS (SELECT source_id, n - 1 AS before, lag(time_ns) OVER (PARTITION BY source_id ORDER BY time_ns) AS start_ns, time_ns AS end_ns FROM beats),
stops AS (SELECT DISTINCT source_id, before FROM (SELECT source_id, event_type,
  sum(CASE WHEN event_type = 'system.heartbeat' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY ordinal) AS before FROM {{log}})
  WHERE event_type = 'system.agent_stopped'),
windows AS (SELECT s.source_id, start_ns, end_ns, end_ns - start_ns AS gap_ns, t.before IS NOT NULL AS bounded
  FROM spans s LEFT JOIN stops t ON t.source_id = s.source_id AND t.before = s.before WHERE end_ns - start_ns > {DAY_NS})"""
CONTINUITY_SQL = f"""continuity AS (SELECT source_id, observed, CASE WHEN observed > 0 THEN greatest(1, (last_ns - first_beat) // {12 * HOUR_NS}) ELSE 0 END AS expected,
  coalesce(longest, 0) AS longest_gap_ns, observed > 0 AND coalesce(longest, 0) <= {DAY_NS} AS within_policy
  FROM (SELECT source_id, count(*) FILTER (event_type = 'system.heartbeat') AS observed, min(time_ns) FILTER (event_type = 'system.heartbeat') AS first_beat,
        max(time_ns) AS last_ns FROM {{log}} GROUP BY source_id)
  LEFT JOIN (SELECT source_id, max(end_ns - start_ns) AS longest FROM spans GROUP BY source_id) USING (source_id))"""
TRANSPORT_SQL = """kept AS (SELECT *, lag(event_type) OVER w AS ptype, lag(seq) OVER w AS pseq, lag(time_ns) OVER w AS ptime
  FROM {log} WHERE event_type IN ('system.network_outage', 'system.replay_completed') WINDOW w AS (PARTITION BY source_id ORDER BY ordinal)),
pairs AS (SELECT source_id, pseq AS outage_seq, seq AS replay_seq, greatest(seq - pseq - 1, 0) AS buffered, time_ns - ptime AS outage_ns
  FROM kept WHERE event_type = 'system.replay_completed' AND ptype = 'system.network_outage'),
transport AS (SELECT source_id, count(*) FILTER (event_type = 'system.network_outage') AS outages,
  coalesce(any_value(longest), 0) AS longest_outage_ns, CAST(coalesce(any_value(buffered), 0) AS BIGINT) AS buffered,
  any_value(n) IS NOT NULL AND max_by(event_type, ordinal) <> 'system.network_outage' AS replay_completed
  FROM kept LEFT JOIN (SELECT source_id, max(outage_ns) AS longest, sum(buffered) AS buffered, count(*) AS n FROM pairs GROUP BY source_id)
  USING (source_id) GROUP BY source_id)"""
COVERAGE_SQL = "CASE WHEN expected <= 0 THEN '—' ELSE printf('%.2f', least(100.0, observed / expected * 100)) || ' %' END"


@query("observation_windows", f"WITH {CAPTURED_SQL}, {WINDOWS_SQL.format(log='captured')} SELECT * FROM windows")
def observation_windows(t: Tables):
    return con.observation_windows(captured(t), DAY_NS)


@query("continuity_summary", f"""WITH {CAPTURED_SQL}, {WINDOWS_SQL.format(log='captured')}, {CONTINUITY_SQL.format(log='captured')}
SELECT *, {COVERAGE_SQL} AS coverage FROM continuity""")
def continuity_summary(t: Tables):
    return con.continuity_summary(captured(t), 12 * HOUR_NS, DAY_NS).withColumn("coverage", con.coverage_text())


@query("outage_pairs", f"WITH {CAPTURED_SQL}, {TRANSPORT_SQL.format(log='captured')} SELECT * FROM pairs")
def outage_pairs(t: Tables):
    return con.outage_pairs(captured(t))


@query("transport_summary", f"WITH {CAPTURED_SQL}, {TRANSPORT_SQL.format(log='captured')} SELECT * FROM transport")
def transport_summary(t: Tables):
    return con.transport_summary(captured(t))


@query("session_gaps", f"""WITH {CAPTURED_SQL}, s AS (SELECT source_id, lag(time_ns) OVER (PARTITION BY source_id ORDER BY time_ns) // 1000 AS start_us,
  time_ns // 1000 AS end_us FROM captured WHERE event_type = 'system.heartbeat')
SELECT source_id, start_us, end_us FROM s WHERE end_us - start_us > {DAY_US}""")
def session_gaps(t: Tables):
    return con.session_gaps(captured(t), "1 day")


@query("hb_tumbling", f"""WITH {CAPTURED_SQL} SELECT source_id, time_ns // 1000 // {DAY_US} * {DAY_US} AS start_us, count(*) AS beats
FROM captured WHERE event_type = 'system.heartbeat' GROUP BY ALL""")
def hb_tumbling(t: Tables):
    return con.heartbeat_cadence(captured(t), "1 day")


@query("event_counts_captured", f"""WITH {CAPTURED_SQL} SELECT source_id,
  CASE WHEN starts_with(event_type, 'system.') THEN 'system.* (heartbeats excluded)' ELSE event_type END AS type, count(*) AS n
FROM captured WHERE event_type <> 'system.heartbeat' GROUP BY ALL""")
def event_counts_captured(t: Tables):
    return cap.event_counts(captured(t))


@query("clock_drift", f"""WITH {CAPTURED_SQL} SELECT source_id, max(abs(k * 40 - 1500)) AS max_drift_ms, count(*) AS heartbeats, max(ordinal) AS uptime_seconds, max(k) AS queue_depth
FROM captured WHERE event_type = 'system.heartbeat' GROUP BY source_id""")
def clock_drift(t: Tables):
    records = captured(t)
    payloads = cap.heartbeat_payloads(records).groupBy("source_id").agg(
        F.count("*").alias("heartbeats"), F.max("agent.uptime_seconds").alias("uptime_seconds"),
        F.max("continuity.queue_depth").alias("queue_depth"))
    return cap.clock_drift(records).join(payloads, "source_id")


REVOKED_SQL = """revoked AS (SELECT source_id, ordinal, seq, coalesce(nullif(json_extract_string(payload_clear, '$.revoked_key_id'), ''),
  nullif(json_extract_string(payload_clear, '$.revoked_key_name'), ''), 'unknown') AS label,
  coalesce(nullif(json_extract_string(payload_clear, '$.reason'), ''), 'unstated') AS reason,
  coalesce(nullif(json_extract_string(payload_clear, '$.suspected_since'), ''), 'an unstated time') AS since, time_ns
  FROM {log} WHERE event_type = 'system.key_revoked')"""


@query("key_revocations", f"WITH {CAPTURED_SQL}, {REVOKED_SQL.format(log='captured')} SELECT * FROM revoked")
def key_revocations(t: Tables):
    return cap.key_revocations(captured(t))


# Checkpoints of the users' chains: one at every 16th record and at the end, taken before any damage. Some roots
# are wrong and some signatures are bad.
def _bad_root(source="source_id"):
    return (F.col(source).cast("bigint") % 11 == 0) & (F.col("size") == 32)


def user_checkpoints(t: Tables, chained=None):
    chained = stored_frames(t) if chained is None else chained
    last = chained.groupBy("source_id").agg(F.max("seq").alias("last"))
    sizes = (chained.join(last, "source_id").where((F.col("seq") % 16 == 0) | (F.col("seq") == F.col("last")))
             .select("source_id", F.col("seq").alias("size")))
    leaves = chained.select("source_id", (F.col("seq") - 1).alias("idx"), leaf_hash(F.col("record_bytes")).alias("leaf"))
    roots = prefix_roots(leaves, sizes)
    root = F.when(_bad_root(), F.unhex(F.reverse(F.hex("root")))).otherwise(F.col("root"))
    origin = F.concat(F.lit("log/"), F.col("source_id"))
    note = F.concat(origin, F.lit("\n"), F.col("size").cast("string"), F.lit("\n"), base64_text(root), F.lit("\n"))
    return roots.select(
        "source_id", F.col("size").alias("pos"), origin.alias("origin"), "size", root.alias("root"), note.alias("note"),
        (~((F.col("source_id").cast("bigint") % 13 == 0) & (F.col("size") == 16))).alias("sig_ok"))


def merged_prefixes(name: str, log: str, seq: str) -> str:
    return (f"{name}_leaves AS (SELECT f.source_id, s.size, {seq} - 1 AS i, sha256(unhex('00') || encode(record)) AS h "
            f"FROM {log} f JOIN cp_sizes s ON f.source_id = s.source_id AND {seq} <= s.size),\n"
            + merkle_sql(f"{name}_leaves", name, "source_id, size", 12))


CHECKPOINT_SQL = f"""cp_sizes AS (SELECT source_id, seq AS size FROM (SELECT source_id, seq, max(seq) OVER (PARTITION BY source_id) AS last FROM frames)
  WHERE seq % 16 = 0 OR seq = last),
{merged_prefixes('made', 'frames', 'seq')},
checkpoints AS (SELECT *, 'log/' || source_id || chr(10) || size || chr(10) || to_base64(unhex(root)) || chr(10) AS note FROM (
  SELECT source_id, size AS pos, 'log/' || source_id AS origin, size,
    CASE WHEN CAST(source_id AS BIGINT) % 11 = 0 AND size = 32 THEN reverse(h) ELSE h END AS root,
    NOT (CAST(source_id AS BIGINT) % 13 = 0 AND size = 16) AS sig_ok FROM {root_name('made', 12)}))"""
NUMBERED_SQL = "numbered AS (SELECT source_id, record, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS n FROM {log})"
ROOT_CHECK_SQL = f"""{merged_prefixes('seen', 'numbered', 'n')},
seen_sizes AS (SELECT source_id, count(*) AS n FROM numbered GROUP BY source_id),
root_checks AS (SELECT c.*, coalesce(c.root = s.h AND c.size <= z.n, false) AS root_ok FROM checkpoints c
  LEFT JOIN {root_name('seen', 12)} s ON s.source_id = c.source_id AND s.size = c.size LEFT JOIN seen_sizes z ON z.source_id = c.source_id)"""


def checked_checkpoints(t: Tables):
    chained = stored_frames(t)
    numbered = stitched_row_number(tampered(t, chained), ["source_id"], "ordinal", "_n")
    leaves = numbered.select("source_id", (F.col("_n") - 1).alias("idx"), leaf_hash(F.col("record_bytes")).alias("leaf"))
    checkpoints = materialise(user_checkpoints(t, chained), "checkpoints")
    return cps.compare_roots(checkpoints, prefix_roots(leaves, checkpoints.select("source_id", "size")))


@query("checkpoint_roots", f"""WITH RECURSIVE {TAMPER_SQL}, {CHECKPOINT_SQL}, {NUMBERED_SQL.format(log='tampered')}, {ROOT_CHECK_SQL}
SELECT source_id, size, root, root_ok FROM root_checks""")
def checkpoint_roots(t: Tables):
    return checked_checkpoints(t).select("source_id", "size", hex_lower(F.col("root")).alias("root"), "root_ok")


SUMMARY_SQL = """cp_counts AS (SELECT source_id, count(*) AS total, count(*) FILTER (sig_ok) AS signatures_valid,
  count(*) FILTER (sig_ok AND root_ok) AS roots_valid FROM root_checks GROUP BY source_id)"""


@query("checkpoint_summary", f"""WITH RECURSIVE {TAMPER_SQL}, {CHECKPOINT_SQL}, {NUMBERED_SQL.format(log='tampered')}, {ROOT_CHECK_SQL}, {SUMMARY_SQL}
SELECT *, signatures_valid = total AND roots_valid = signatures_valid AS consistent FROM cp_counts""")
def checkpoint_summary(t: Tables):
    return cps.checkpoint_summary(checked_checkpoints(t))


# Submissions in receipt order: orders as one origin per customer, sizes that mostly grow.
SUBMITTED_SQL = """submitted AS (SELECT 'log/' || (o_custkey % 40) AS origin, o_orderkey AS pos, o_orderkey // 8 + (o_orderkey * 7) % 5 AS size,
  sha256(CAST(o_orderkey // 8 + (o_orderkey * 7) % 5 AS VARCHAR) || CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE '' END) AS root FROM orders)"""
JUDGED_SQL = """headed AS (SELECT *, max(size) OVER (PARTITION BY origin ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head_size,
  first_value(root) OVER (PARTITION BY origin, size ORDER BY pos) AS first_root FROM submitted),
judged AS (SELECT origin, pos, size, root, head_size, CASE WHEN head_size IS NULL OR size > head_size THEN 'accepted'
  WHEN size < head_size THEN 'tree size decreased' WHEN root = first_root THEN 'repeated' ELSE 'different root at same tree size' END AS status FROM headed)"""


def submitted(t: Tables):
    key = F.col("o_orderkey")
    size = F.call_function("div", key, F.lit(8).cast("bigint")) + (key * 7) % 5
    mark = F.when(key % 29 == 0, F.lit("x")).otherwise(F.lit(""))
    root = F.unhex(F.sha2(F.encode(F.concat(size.cast("string"), mark), "UTF-8"), 256))
    return t.read("orders").select(
        F.concat(F.lit("log/"), (F.col("o_custkey") % 40).cast("string")).alias("origin"), key.alias("pos"),
        size.alias("size"), root.alias("root"))


@query("checkpoint_forks", f"WITH {SUBMITTED_SQL}, {JUDGED_SQL} SELECT * FROM judged")
def checkpoint_forks(t: Tables):
    return cps.judge_submissions(submitted(t)).withColumn("root", hex_lower(F.col("root")))


@query("checkpoint_heads", f"""WITH {SUBMITTED_SQL}, {JUDGED_SQL}
SELECT origin, max(size) AS size, max_by(root, (size, pos)) AS root, max_by(pos, (size, pos)) AS pos FROM judged WHERE status = 'accepted' GROUP BY origin""")
def checkpoint_heads(t: Tables):
    accepted = cps.judge_submissions(submitted(t)).where(F.col("status") == "accepted")
    return cps.heads(accepted).withColumn("root", hex_lower(F.col("root")))


# Receipts: one per checkpoint; some carry another size, some the imprint of another text.
def receipts_for(checkpoints):
    user = F.col("source_id").cast("bigint")
    text = F.when((user + F.col("size")) % 9 == 0, F.concat("note", F.lit("x"))).otherwise(F.col("note"))
    return checkpoints.select(
        "source_id", "pos", "origin", (F.col("size") + F.when((user + F.col("size")) % 10 == 0, 1).otherwise(0)).alias("size"),
        base64_text(F.col("root")).alias("root_b64"), F.concat(F.lit("tsa-"), (F.col("size") % 3).cast("string")).alias("tsa"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("imprint"), (F.col("size") * 1_000_000_000 + user).alias("gen_ns"),
        (F.col("size") % 3 != 1).alias("qualified"))


RECEIPT_SQL = """receipts AS (SELECT source_id, pos, origin, size + CASE WHEN (CAST(source_id AS BIGINT) + size) % 10 = 0 THEN 1 ELSE 0 END AS size,
  root, 'tsa-' || (size % 3) AS tsa, sha256(CASE WHEN (CAST(source_id AS BIGINT) + size) % 9 = 0 THEN note || 'x' ELSE note END) AS imprint,
  size * 1000000000 + CAST(source_id AS BIGINT) AS gen_ns, size % 3 <> 1 AS qualified FROM checkpoints),
matched AS (SELECT r.*, c.source_id IS NOT NULL AS matched FROM receipts r LEFT JOIN checkpoints c
  ON c.sig_ok AND c.source_id = r.source_id AND sha256(c.note) = r.imprint AND c.origin = r.origin AND c.size = r.size AND c.root = r.root),
anchor_sums AS (SELECT source_id, count(*) AS receipts, count(*) FILTER (matched) AS matching,
  coalesce(max_by(tsa, pos) FILTER (matched), '') AS tsa, coalesce(max_by(qualified, pos) FILTER (matched), false) AS qualified,
  max(gen_ns) FILTER (matched) AS latest_gen_ns FROM matched GROUP BY source_id)"""
ANCHOR_SQL = f"WITH RECURSIVE {TAMPER_SQL}, {CHECKPOINT_SQL}, {RECEIPT_SQL}"


def matched_receipts(t: Tables):
    checkpoints = materialise(user_checkpoints(t), "checkpoints")
    return cps.match_receipts(receipts_for(checkpoints), checkpoints.where("sig_ok"))


@query("anchor_match", f"{ANCHOR_SQL} SELECT source_id, pos, size, tsa, matched FROM matched")
def anchor_match(t: Tables):
    return matched_receipts(t).select("source_id", "pos", "size", "tsa", "matched")


@query("anchor_summary", f"{ANCHOR_SQL} SELECT * FROM anchor_sums")
def anchor_summary(t: Tables):
    return cps.anchor_summary(matched_receipts(t))


@query("anchor_rollup", f"""{ANCHOR_SQL} SELECT CAST(sum(receipts) AS BIGINT) AS receipts, max_by(tsa, source_id) FILTER (tsa <> '') AS tsa,
  max(latest_gen_ns) AS latest_gen_ns, bool_and(qualified) AS qualified FROM anchor_sums""")
def anchor_rollup(t: Tables):
    return cps.anchor_rollup(cps.anchor_summary(matched_receipts(t)))


@query("anchor_candidates", f"""{ANCHOR_SQL}, last AS (SELECT source_id, max_by(size, pos) AS size, max_by(note, pos) AS note FROM checkpoints GROUP BY source_id),
anchored AS (SELECT source_id, max(size) AS anchored FROM receipts WHERE size % 16 = 0 GROUP BY source_id)
SELECT source_id, size, note, coalesce(anchored, 0) AS anchored FROM last LEFT JOIN anchored USING (source_id) WHERE size > coalesce(anchored, 0)""")
def anchor_candidates(t: Tables):
    checkpoints = materialise(user_checkpoints(t), "checkpoints")
    return cps.anchor_candidates(checkpoints, receipts_for(checkpoints).where(F.col("size") % 16 == 0))


@query("input_attestation", f"""WITH RECURSIVE {TAMPER_SQL}, {CHECKPOINT_SQL}
SELECT source_id, pos, origin || '@' || size || ' root=' || substr(to_base64(unhex(root)), 1, 12) || '…' AS checkpoint_id FROM checkpoints WHERE sig_ok""")
def input_attestation(t: Tables):
    return cps.attested_checkpoints(user_checkpoints(t).where("sig_ok"))


# Whole verification. Users divisible by 17 or 19 lost their first 16 records to retention; for 19 the
# tombstone's root is none that was ever committed.
def _expired(user):
    return (user % 17 == 0) | (user % 19 == 0)


def evidence(t: Tables) -> plan.Evidence:
    chained = stored_frames(t)
    checkpoints = materialise(user_checkpoints(t, chained), "checkpoints")
    user = F.col("source_id").cast("bigint")
    kept = tampered(t, chained).where(~(_expired(user) & (F.col("ordinal") <= 16)))
    gone = checkpoints.where(_expired(user) & (F.col("size") == 16)).select(
        "source_id", F.lit(1).cast("bigint").alias("seq_first"), F.lit(16).cast("bigint").alias("seq_last"),
        F.when(user % 19 == 0, F.unhex(F.sha2(F.encode("source_id", "UTF-8"), 256))).otherwise(F.col("root")).alias("root"))
    silent = t.read("supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("source_id"))
    sources = t.read("events").select(F.col("user_id").cast("string").alias("source_id")).distinct().unionByName(silent)
    return plan.Evidence(kept, sources, checkpoints, receipts_for(checkpoints), gone)


EVIDENCE_SQL = f"""WITH RECURSIVE {TAMPER_SQL}, {CHECKPOINT_SQL}, {RECEIPT_SQL},
gone AS (SELECT source_id, 1 AS seq_first, 16 AS seq_last, CASE WHEN CAST(source_id AS BIGINT) % 19 = 0 THEN sha256(source_id) ELSE root END AS root
  FROM checkpoints WHERE size = 16 AND (CAST(source_id AS BIGINT) % 17 = 0 OR CAST(source_id AS BIGINT) % 19 = 0)),
kept_frames AS (SELECT * FROM tampered WHERE NOT ((CAST(source_id AS BIGINT) % 17 = 0 OR CAST(source_id AS BIGINT) % 19 = 0) AND ordinal <= 16)),
{NUMBERED_SQL.format(log='kept_frames')}, {ROOT_CHECK_SQL}, {SUMMARY_SQL},
{CHECK_SQL[len(TAMPER_SQL) + 2:].replace('FROM tampered)', 'FROM kept_frames)').replace(
    "WHEN phash IS NOT NULL AND seq <> coalesce(pseq, 0) + 1 THEN 'gap' WHEN prev_hash <> coalesce(phash, repeat('0', 64)) THEN 'link'",
    "WHEN g.source_id IS NULL AND phash IS NOT NULL AND seq <> coalesce(pseq, 0) + 1 THEN 'gap' "
    "WHEN g.source_id IS NOT NULL AND seq <> coalesce(pseq, 0) + 1 AND NOT (coalesce(pseq, 0) + 1 >= 1 AND seq - 1 <= 16) THEN 'gap' "
    "WHEN prev_hash <> coalesce(phash, repeat('0', 64)) AND NOT (g.source_id IS NOT NULL AND seq <> coalesce(pseq, 0) + 1) THEN 'link'").replace(
    "FROM linked) WHERE kind IS NOT NULL", "FROM linked LEFT JOIN (SELECT source_id FROM gone) g USING (source_id)) WHERE kind IS NOT NULL").replace(
    "(SELECT *, CASE WHEN record_hash", "(SELECT linked.*, CASE WHEN record_hash")},
unparsed AS (SELECT source_id, min(ordinal) AS unparsed_at FROM checked WHERE parse_error GROUP BY source_id),
facts AS (SELECT source_id, ordinal, seq, CAST(json_extract_string(record, '$.event_type') AS VARCHAR) AS event_type,
    epoch_us(CAST(substr(json_extract_string(record, '$.event_time'), 1, 26) AS TIMESTAMP)) * 1000 AS time_ns,
    json_extract(record, '$.payload_clear') AS payload_clear, record_hash, json_extract_string(record, '$.key_id') AS key_id
  FROM (SELECT * FROM kept_frames JOIN (SELECT source_id, ordinal, seq, record_hash, parse_error FROM checked) USING (source_id, ordinal))
  WHERE source_id NOT IN (SELECT source_id FROM unparsed)),
{WINDOWS_SQL.format(log='facts')}, {CONTINUITY_SQL.format(log='facts')}, {TRANSPORT_SQL.format(log='facts')}, {REVOKED_SQL.format(log='facts')},
fact_spans AS (SELECT source_id, count(*) AS records, min_by(seq, ordinal) AS seq_first, max_by(seq, ordinal) AS seq_last, max_by(record_hash, ordinal) AS chain_head,
  min(time_ns) AS first_ns, max(time_ns) AS last_ns FROM facts GROUP BY source_id),
drifts AS (SELECT source_id, max(abs(CAST(json_extract_string(payload_clear, '$.health.clock_drift_ms') AS BIGINT))) AS max_drift_ms
  FROM facts WHERE event_type = 'system.heartbeat' GROUP BY source_id),
window_counts AS (SELECT source_id, count(*) AS windows, count(*) FILTER (NOT bounded) AS unbounded FROM windows GROUP BY source_id),
retained AS (SELECT g.source_id, count(*) AS expired_segments, bool_and(c.source_id IS NOT NULL) AS roots_retained FROM gone g
  LEFT JOIN (SELECT DISTINCT source_id, root FROM checkpoints WHERE sig_ok) c USING (source_id, root) GROUP BY g.source_id),
sources AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS source_id FROM events UNION SELECT 'supplier-' || s_suppkey FROM supplier),
joined AS (SELECT source_id, u.unparsed_at IS NOT NULL AS unparsed, u.unparsed_at, v.chain_valid, v.message, f.records, f.seq_first, f.seq_last, f.chain_head,
  f.first_ns, f.last_ns, n.total, n.signatures_valid, CASE WHEN r.source_id IS NULL THEN n.roots_valid ELSE n.signatures_valid END AS roots_valid,
  c.observed, c.expected, c.longest_gap_ns, c.within_policy, t.outages, t.longest_outage_ns, t.buffered, t.replay_completed, d.max_drift_ms,
  w.windows, w.unbounded, a.receipts, a.matching, r.expired_segments, r.roots_retained
  FROM sources LEFT JOIN unparsed u USING (source_id) LEFT JOIN verdicts v USING (source_id) LEFT JOIN fact_spans f USING (source_id)
  LEFT JOIN cp_counts n USING (source_id) LEFT JOIN continuity c USING (source_id) LEFT JOIN transport t USING (source_id)
  LEFT JOIN drifts d USING (source_id) LEFT JOIN window_counts w USING (source_id) LEFT JOIN anchor_sums a USING (source_id)
  LEFT JOIN retained r USING (source_id)),
results AS (SELECT source_id, unparsed_at, coalesce(chain_valid, true) AND NOT unparsed AS chain_valid,
  CASE WHEN unparsed THEN 'verifier: entry ' || unparsed_at || ': record does not parse' ELSE message END AS chain_error,
  coalesce(records, 0) AS records, seq_first, seq_last, chain_head, first_ns, last_ns,
  CASE WHEN unparsed THEN 0 ELSE coalesce(total, 0) END AS total, CASE WHEN unparsed THEN 0 ELSE coalesce(signatures_valid, 0) END AS signatures_valid,
  CASE WHEN unparsed THEN 0 ELSE coalesce(roots_valid, 0) END AS roots_valid,
  unparsed OR coalesce(signatures_valid = total AND roots_valid = signatures_valid, true) AS consistent,
  coalesce(observed, 0) AS observed, coalesce(expected, 0) AS expected, coalesce(longest_gap_ns, 0) AS longest_gap_ns, coalesce(within_policy, false) AS within_policy,
  coalesce(outages, 0) AS outages, coalesce(longest_outage_ns, 0) AS longest_outage_ns, coalesce(buffered, 0) AS buffered,
  coalesce(replay_completed, false) AS replay_completed, coalesce(max_drift_ms, 0) AS max_drift_ms, coalesce(windows, 0) AS windows, coalesce(unbounded, 0) AS unbounded,
  CASE WHEN unparsed THEN 0 ELSE coalesce(receipts, 0) END AS receipts, CASE WHEN unparsed THEN 0 ELSE coalesce(matching, 0) END AS matching,
  CASE WHEN unparsed THEN 0 ELSE coalesce(expired_segments, 0) END AS expired_segments, unparsed OR coalesce(roots_retained, true) AS roots_retained
  FROM joined)"""
RESULT_COLUMNS = ["source_id", "chain_valid", "chain_error", "records", "seq_first", "seq_last", "chain_head", "first_ns", "last_ns", "total",
                  "signatures_valid", "roots_valid", "consistent", "observed", "expected", "longest_gap_ns", "within_policy", "outages",
                  "longest_outage_ns", "buffered", "replay_completed", "max_drift_ms", "windows", "unbounded", "receipts", "matching",
                  "expired_segments", "roots_retained"]


def _select(ident: str, ord_: int, rows: str, sub: str = "0", shown: str | None = None, **values: str) -> str:
    text = TEXTS[ident]
    return (f"SELECT source_id, {ord_} AS ord, {sub} AS sub, {shown or quoted(ident)} AS id, {quoted(text.severity)} AS severity, {filled_sql(text.title, **values)} AS title, "
            f"{filled_sql(text.detail, **values)} AS detail, {quoted(ADVICE.get(ident, ''))} AS recommendation FROM {rows}")


_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ns) AS n FROM windows)"
FINDINGS_SQL = " UNION ALL ".join([
    _select("F-CHAIN", 1, "results WHERE NOT chain_valid", kind=f"CASE WHEN unparsed_at IS NOT NULL THEN {quoted(CHAIN_KINDS[0])} ELSE {quoted(CHAIN_KINDS[1])} END", error="chain_error"),
    _select("F-FORK", 2, "results WHERE NOT consistent"),
    _select("F-SIG", 3, "results WHERE signatures_valid <> total", bad="(total - signatures_valid)", total="total"),
    _select("F-ANCHOR", 4, "results WHERE matching <> receipts", bad="(receipts - matching)", total="receipts"),
    _select("F-RETENTION", 5, "results WHERE expired_segments > 0 AND NOT roots_retained"),
    _select("F-KEYREV", 6, "revoked", "ordinal", source="source_id", label="label", seq="seq", reason="reason", since="since"),
    _select("F-GAP", 7, f"{_NUMBERED} WHERE NOT bounded", "n", "'F-GAP-' || n", source="source_id", gap=sql_duration("gap_ns"), start=sql_pinned("start_ns"), end=sql_pinned("end_ns")),
    _select("F-CLOCK", 8, "results WHERE max_drift_ms > 2400", source="source_id", drift="max_drift_ms", limit="2400"),
])


@query("source_results", f"{EVIDENCE_SQL} SELECT {', '.join(RESULT_COLUMNS)} FROM results")
def source_results(t: Tables):
    return plan.verify(evidence(t), POLICY).results.select(*RESULT_COLUMNS)


@query("findings_verify", f"{EVIDENCE_SQL} {FINDINGS_SQL}")
def findings_verify(t: Tables):
    return plan.findings(plan.verify(evidence(t), POLICY))


INTACT = "(chain_valid AND consistent AND roots_valid = signatures_valid AND signatures_valid = total)"


@query("verdict", f"""{EVIDENCE_SQL} SELECT source_id,
  CASE WHEN unbounded = 0 AND within_policy THEN 'Continuous' WHEN unbounded = 1 THEN '1 unobserved window' ELSE unbounded || ' unobserved windows' END AS observability,
  CASE WHEN chain_valid THEN 'None' ELSE 'Detected' END AS event_loss, CASE WHEN {INTACT} THEN 'Valid' ELSE 'INVALID' END AS integrity,
  CASE WHEN NOT {INTACT} THEN 'FAIL' WHEN unbounded = 0 AND within_policy THEN 'OK' ELSE 'ATTENTION' END AS status FROM results""")
def verdict(t: Tables):
    return report.verdicts(plan.verify(evidence(t), POLICY).results)


@query("report_tables", f"""{EVIDENCE_SQL} SELECT source_id, expected, observed, {COVERAGE_SQL} AS coverage, {sql_minutes('longest_gap_ns')} AS longest_gap,
  CASE WHEN within_policy THEN 'OK (within policy)' ELSE 'GAP — see findings' END AS continuity, outages, {sql_minutes('longest_outage_ns')} AS longest_outage, buffered,
  CASE WHEN outages = 0 THEN '—' WHEN replay_completed THEN 'complete' ELSE 'incomplete' END AS replay, CASE WHEN chain_valid THEN 'none' ELSE 'detected' END AS loss,
  coalesce(seq_first, 0) || ' → ' || coalesce(seq_last, 0) AS range_verified, coalesce(left(chain_head, 4) || '…' || right(chain_head, 4), '') AS head, total AS checkpoints,
  signatures_valid || ' / ' || total AS signatures, roots_valid || ' / ' || total AS roots, max_drift_ms || 'ms' AS drift FROM results""")
def report_tables(t: Tables):
    return report.report_tables(plan.verify(evidence(t), POLICY).results)
