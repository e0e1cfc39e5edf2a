"""Queries over JSON-lines inputs: scan, mapping profiles, caps and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.base import Tables, query
from tidemark.catalog.sqltext import finding_select, merkle_sql, root_name
from tidemark.operators import assess as a
from tidemark.operators.mapping import map_lines
from tidemark.session import scratch_path
from tidemark.sources import jsonl
from tidemark.sources.profiles import load_profile
from tidemark.sources.store import materialise

GENERIC = load_profile("generic")
LINES_PER_FILE = 1 << 16


def event_lines(t: Tables) -> DataFrame:
    """The events as exported lines, with the irregularities real exports have (by event_id % 20)."""
    m = F.col("event_id") % 20
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    number = F.col("event_id").cast("string")
    seq = (F.when(m == 1, F.concat(F.lit('"'), number, F.lit('"'))).when(m == 2, F.concat(F.lit("-"), number))
           .when(m == 3, F.lit("18446744073709551615")).when(m == 4, F.lit("null")).otherwise(number))
    kind = (F.when(m == 5, F.lit("7")).when(m == 6, F.lit('{"a":1}')).when(m == 7, F.lit('"heartbeat"'))
            .otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))))
    time = F.when(m == 8, F.lit("yesterday")).otherwise(F.concat(stamp, F.lit("Z")))
    source = F.when(m == 9, F.lit("")).otherwise(F.concat(F.lit('"source":"u'), F.col("user_id").cast("string"), F.lit('",')))
    line = F.concat(F.lit("{"), source, F.lit('"time":"'), time, F.lit('","seq":'), seq, F.lit(',"type":'), kind,
                    F.lit(',"actor":"a'), (F.col("user_id") % 7).cast("string"), F.lit('"}'))
    line = (F.when(m == 10, F.concat(F.lit("["), line, F.lit("]"))).when(m == 11, F.substring(line, 1, 20))
            .when(m == 12, F.concat(line, F.lit(" trailing"))).when(m == 13, F.concat(F.lit("  "), line, F.lit("\t")))
            .when(m == 14, F.lit("   ")).when(m == 15, F.lit("null")).otherwise(line))
    return t.read("events").select("event_id", line.alias("value"))


LINES_SQL = """parts AS (SELECT event_id, event_id % 20 AS m, ts, user_id, event_type FROM events),
lines AS (SELECT *, trim(CASE m WHEN 10 THEN '[' || body || ']' WHEN 11 THEN left(body, 20) WHEN 12 THEN body || ' trailing' WHEN 14 THEN '' WHEN 15 THEN 'null' ELSE body END) AS value FROM (
  SELECT *, '{' || CASE WHEN m = 9 THEN '' ELSE '"source":"u' || user_id || '",' END || '"time":"' || CASE WHEN m = 8 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END
  || '","seq":' || CASE m WHEN 1 THEN '"' || event_id || '"' WHEN 2 THEN '-' || event_id WHEN 3 THEN '18446744073709551615' WHEN 4 THEN 'null' ELSE CAST(event_id AS VARCHAR) END
  || ',"type":' || CASE m WHEN 5 THEN '7' WHEN 6 THEN '{"a":1}' WHEN 7 THEN '"heartbeat"' ELSE '"' || event_type || '"' END || ',"actor":"a' || (user_id % 7) || '"}' AS body FROM parts)),
mapped AS (SELECT event_id, value, m IN (10, 11) AS malformed,
  CASE WHEN m IN (9, 10, 11, 15) THEN 'assessed-source' ELSE 'u' || user_id END AS source_id,
  CASE WHEN m IN (2, 4, 10, 11, 15) THEN NULL WHEN m = 3 THEN '18446744073709551615' ELSE CAST(event_id AS VARCHAR) END AS seq,
  CASE WHEN m IN (8, 10, 11, 15) THEN NULL ELSE epoch_us(ts) END AS time_us,
  CASE WHEN m IN (6, 10, 11, 15) THEN '' WHEN m = 5 THEN '7' WHEN m = 7 THEN 'heartbeat' ELSE event_type END AS type,
  CASE WHEN m IN (10, 11, 15) THEN '' ELSE 'a' || (user_id % 7) END AS actor, m = 7 AS heartbeat FROM lines WHERE m <> 14)"""


def written_lines(t: Tables) -> list[str]:
    """The lines written as two inputs, so that scans read real files. Files grow in number: a gzip file is read by one task."""
    root = scratch_path(t.spark, "lines")
    lines = event_lines(t)
    files = max(4, t.read("events").count() // 2 // LINES_PER_FILE)
    for part in (0, 1):
        chosen = lines.where(F.col("event_id") % 2 == part)
        chosen.repartitionByRange(files, "event_id").sortWithinPartitions("event_id").select("value").write.text(
            f"{root}/{part}", compression="gzip" if part else "none")
    return [f"{root}/0", f"{root}/1"]


def scanned(t: Tables) -> DataFrame:
    """Mapped lines of both inputs with their dense position, written once as the normalised log."""
    return materialise(jsonl.with_ordinals(map_lines(jsonl.scan_jsonl(t.spark, written_lines(t)), GENERIC)), "mapped")


SCANNED_SQL = f"""{LINES_SQL}, scanned AS (SELECT *, row_number() OVER (ORDER BY event_id % 2, event_id) AS ordinal FROM mapped)"""
COLUMNS = ["malformed", "source_id", "seq", "time_us", "type", "actor", "heartbeat"]


@query("map_generic", f"WITH {LINES_SQL} SELECT event_id, {', '.join(COLUMNS)} FROM mapped")
def map_generic(t: Tables):
    return map_lines(event_lines(t), GENERIC).drop("value").withColumn("seq", F.col("seq").cast("string"))


@query("scan_jsonl", f"WITH {SCANNED_SQL} SELECT ordinal, CAST(event_id % 2 AS INTEGER) AS input_pos, {', '.join(COLUMNS)} FROM scanned")
def scan_jsonl(t: Tables):
    return scanned(t).select("ordinal", "input_pos", *COLUMNS).withColumn("seq", F.col("seq").cast("string"))


@query("scan_malformed", f"""WITH {LINES_SQL}, capped AS (SELECT *, octet_length(encode(value)) > 95 AS too_long FROM mapped)
SELECT malformed OR too_long AS malformed, count(*) AS n, CAST(sum(octet_length(encode(value)) + 1) AS BIGINT) AS bytes FROM capped GROUP BY 1""")
def scan_malformed(t: Tables):
    # A low line cap, so that over-long lines occur: they count as malformed and are not fatal.
    mapped = map_lines(jsonl.scan_jsonl(t.spark, written_lines(t)), GENERIC, max_line_bytes=95)
    return mapped.groupBy("malformed").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).cast("bigint").alias("bytes"))


CAP = 4321


@query("limit_truncate", f"""WITH {SCANNED_SQL}, counted AS (SELECT *, sum(CASE WHEN malformed THEN 0 ELSE 1 END) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM scanned),
capped AS (SELECT * FROM counted WHERE coalesce(kept, 0) < {CAP})
SELECT count(*) AS lines, count(*) FILTER (malformed) AS malformed, CAST(sum(octet_length(encode(value)) + 1) AS BIGINT) AS bytes_read,
  CASE WHEN count(*) FILTER (NOT malformed) >= {CAP} THEN 'max-records {CAP} reached; remaining input not read' ELSE '' END AS reason,
  count(*) FILTER (NOT malformed) >= {CAP} AS truncated FROM capped""")
def limit_truncate(t: Tables):
    capped = jsonl.apply_caps(map_lines(jsonl.scan_jsonl(t.spark, written_lines(t)), GENERIC), CAP, 0)
    return jsonl.truncation(capped, CAP, 0)


@query("line_digest", f"""WITH {SCANNED_SQL},
items AS (SELECT source_id, ordinal, value FROM scanned WHERE NOT malformed UNION ALL SELECT '*', ordinal, value FROM scanned),
leaves AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) - 1 AS i, sha256(unhex('00') || encode(value || chr(10))) AS h FROM items),
{merkle_sql('leaves', 'd')}
SELECT nullif(source_id, '*') AS source_id, records, h AS digest FROM {root_name('d')} JOIN (SELECT source_id, count(*) AS records FROM leaves GROUP BY source_id) USING (source_id)""")
def line_digest(t: Tables):
    return jsonl.line_digests(scanned(t))


INPUT_FINDING_SQL = finding_select(
    "A-INPUT", 1, "per, bad", malformed="malformed", total="(records + malformed)",
    percent="printf('%.2f', malformed / (records + malformed) * 100)") + " WHERE malformed > 0 AND malformed / (records + malformed) >= 0.001"


@query("a_input", f"""WITH {LINES_SQL}, bad AS (SELECT count(*) AS malformed FROM mapped WHERE malformed), per AS (SELECT source_id, count(*) AS records FROM mapped WHERE NOT malformed GROUP BY 1)
{INPUT_FINDING_SQL}""")
def a_input(t: Tables):
    mapped = map_lines(event_lines(t), GENERIC)
    facts = a.source_facts(mapped.where(~F.col("malformed")))
    return a.raised(a.with_malformed(facts, a.count_malformed(mapped)), [a.input_finding()])


@query("profile_cloudtrail", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'cloudtrail' ELSE lower(o_orderpriority) || '.example' END AS source_id, epoch_us(o_orderdate) AS time_us,
  'Order' || o_orderstatus AS type, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'arn:user/' || o_custkey END AS actor, CAST(NULL AS VARCHAR) AS seq, false AS heartbeat FROM orders""")
def profile_cloudtrail(t: Tables):
    key = F.col("o_orderkey")
    line = F.concat(
        F.lit("{"), F.when(key % 6 == 0, F.lit("")).otherwise(F.concat(F.lit('"eventSource":"'), F.lower("o_orderpriority"), F.lit('.example",'))),
        F.lit('"eventTime":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","eventName":"Order'), "o_orderstatus",
        F.lit('","userIdentity":{'), F.when(key % 4 == 0, F.lit('"type":"root"')).otherwise(
            F.concat(F.lit('"arn":"arn:user/'), F.col("o_custkey").cast("string"), F.lit('"'))), F.lit("}}"))
    mapped = map_lines(t.read("orders").select("o_orderkey", line.alias("value")), load_profile("cloudtrail"))
    return mapped.select("o_orderkey", "source_id", "time_us", "type", "actor", F.col("seq").cast("string").alias("seq"), "heartbeat")


@query("profile_immudb", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'immudb' ELSE 'db-' || (user_id % 5) END AS source_id, CAST(event_id + 1024 AS VARCHAR) AS seq,
  epoch_us(ts) // 1000000 * 1000000 AS time_us, event_type AS type, 'u' || user_id AS actor FROM events""")
def profile_immudb(t: Tables):
    line = F.concat(
        F.lit("{"), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"source":"db-'), (F.col("user_id") % 5).cast("string"), F.lit('",'))),
        F.lit('"tx":'), (F.col("event_id") + 1024).cast("string"), F.lit(',"ts":'), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"),
        F.lit(',"type":"'), "event_type", F.lit('","actor":"u'), F.col("user_id").cast("string"), F.lit('"}'))
    mapped = map_lines(t.read("events").select("event_id", line.alias("value")), load_profile("immudb-export"))
    return mapped.select("event_id", "source_id", F.col("seq").cast("string").alias("seq"), "time_us", "type", "actor")


@query("profile_idp", """SELECT conv_id, turn, 'idp/tenant-primary' AS source_id, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn)) AS time_us,
  CASE WHEN role = 'system' THEN 'idp.signin' ELSE role END AS type, 'user' || conv_id || '@example.com' AS actor FROM conversations""")
def profile_idp(t: Tables):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    line = F.concat(
        F.lit('{"createdDateTime":"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","userPrincipalName":"user'), F.col("conv_id").cast("string"),
        F.lit('@example.com"'), F.when(F.col("role") == "system", F.lit("")).otherwise(F.concat(F.lit(',"activityDisplayName":"'), F.col("role"), F.lit('"'))), F.lit("}"))
    mapped = map_lines(t.read("conversations").select("conv_id", "turn", line.alias("value")), load_profile("idp-signin"))
    return mapped.select("conv_id", "turn", "source_id", "time_us", "type", "actor")
