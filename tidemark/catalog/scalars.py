"""Queries over scalar functions: parsing, formats, digests, identifiers and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import Tables, query
from tidemark.catalog.logs import micros, sql_duration, sql_minutes, sql_span
from tidemark.functions import hashing as h
from tidemark.functions import ids, notes, times
from tidemark.operators.mapping import parse_uint64, with_fields
from tidemark.plans.report import assurance_tier


def _case(number, default, **texts):
    """Picks a text by number; the keys are m0, m1, ..."""
    out = default
    for key, text in texts.items():
        out = F.when(number == int(key[1:]), text).otherwise(out)
    return out


@query("parse_pinned_time", """WITH x AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '000Z'
  WHEN 2 THEN strftime(ts, '%Y-02-30T%H:%M:%S.%f') || '000Z' WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '123Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' END AS text, ts FROM events)
SELECT event_id, text, CASE WHEN event_id % 8 IN (0, 1, 2) THEN NULL ELSE epoch_us(ts) * 1000 + CASE WHEN event_id % 8 = 3 THEN 123 ELSE 0 END END AS time_ns,
  CASE WHEN event_id % 8 NOT IN (0, 1, 2) THEN text END AS formatted FROM x""")
def parse_pinned_time(t: Tables):
    m = F.col("event_id") % 8
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = _case(
        m, F.concat(stamp, F.lit("000Z")), m0=F.concat(stamp, F.lit("Z")),
        m1=F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("000Z")),
        m2=F.concat(F.date_format("ts", "yyyy-'02-30T'HH:mm:ss.SSSSSS"), F.lit("000Z")), m3=F.concat(stamp, F.lit("123Z")))
    rows = t.read("events").select("event_id", text.alias("text"))
    rows = rows.withColumn("time_ns", times.parse_pinned_ns(F.col("text")))
    return rows.withColumn("formatted", times.format_pinned(F.col("time_ns")))


@query("parse_layouts", """SELECT event_id,
  epoch_us(date_trunc('second', ts)) - 7200000000 AS rfc3339, epoch_us(ts) AS rfc3339nano, epoch_us(date_trunc('day', ts)) AS date_only,
  epoch_us(date_trunc('second', ts)) AS datetime, epoch_us(ts) AS datetime_utc, epoch_us(ts) // 1000000 * 1000000 AS unix_seconds, epoch_us(ts) // 1000 * 1000 AS unix_millis,
  CAST(NULL AS BIGINT) AS wrong_layout, CAST(NULL AS BIGINT) AS not_numeric FROM events""")
def parse_layouts(t: Tables):
    us = micros("ts")
    iso, plain = "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"
    whole = F.date_format("ts", iso)
    parse = times.parse_layout_us
    return t.read("events").select(
        "event_id", parse(F.concat(whole, F.lit("+02:00")), "rfc3339").alias("rfc3339"),
        parse(F.concat(F.date_format("ts", iso + ".SSSSSS"), F.lit("Z")), "rfc3339nano").alias("rfc3339nano"),
        parse(F.date_format("ts", "yyyy-MM-dd"), "2006-01-02").alias("date_only"),
        parse(F.date_format("ts", plain), "datetime").alias("datetime"),
        parse(F.concat(F.date_format("ts", plain + ".SSSSSS"), F.lit(" UTC")), "datetime-utc").alias("datetime_utc"),
        parse(F.format_string("%.6f", us / 1_000_000), "unix").alias("unix_seconds"),
        parse(F.call_function("div", us, F.lit(1000).cast("bigint")).cast("string"), "unixms").alias("unix_millis"),
        parse(F.date_format("ts", plain), "rfc3339").alias("wrong_layout"), parse(whole, "unix").alias("not_numeric"))


@query("json_paths", """SELECT event_id, CAST(event_id AS VARCHAR) AS plain, 'u' || user_id AS nested, 'second' AS in_array, CAST(user_id AS VARCHAR) AS numeric_key,
  '' AS container, CAST(NULL AS VARCHAR) AS null_leaf, 'true' AS flag, '18446744073709551615' AS wide, CAST(NULL AS VARCHAR) AS absent, 'last' AS repeated FROM events""")
def json_paths(t: Tables):
    line = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"user":{"arn":"u'), F.col("user_id").cast("string"),
        F.lit('","list":["first",{"name":"second"}],"7":'), F.col("user_id").cast("string"),
        F.lit(',"none":null},"ok":true,"wide":18446744073709551615,"twice":"first","twice":"last"}'))
    # Dealt out first: numbers of many lines fit into one split of a file, and reading their paths is what takes the time.
    dealt = t.read("events").select("event_id", "user_id").repartition("event_id")
    rows = dealt.select("event_id", line.alias("raw")).withColumn("v", F.try_parse_json("raw"))
    paths = {"plain": "id", "nested": "user.arn", "in_array": "user.list.1.name", "numeric_key": "user.7", "container": "user.list",
             "null_leaf": "user.none", "flag": "ok", "wide": "wide", "absent": "user.missing.deep", "repeated": "twice"}
    return with_fields(rows, paths, "v", "raw").select("event_id", *[F.col(f"{name}_text").alias(name) for name in paths])


@query("parse_uint64", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 5 THEN CAST(9007199254740992 + event_id AS VARCHAR)
  WHEN 6 THEN '18446744073709551615' END AS seq FROM events""")
def parse_uint64_values(t: Tables):
    number = F.col("event_id").cast("string")
    value = _case(
        F.col("event_id") % 8, F.lit("18446744073709551616"), m0=number, m1=F.concat(F.lit('"'), number, F.lit('"')),
        m2=F.concat(F.lit("-"), number), m3=F.concat(number, F.lit(".0")), m4=F.lit("true"),
        m5=(F.col("event_id") + 9007199254740992).cast("string"), m6=F.lit("18446744073709551615"))
    rows = t.read("events").select("event_id", F.concat(F.lit('{"n":'), value, F.lit("}")).alias("raw")).withColumn("v", F.try_parse_json("raw"))
    fields = with_fields(rows, {"n": "n"}, "v", "raw")
    return fields.select("event_id", parse_uint64(F.col("n_kind"), F.col("n_text")).cast("string").alias("seq"))


@query("digest_valid", """SELECT o_orderkey, o_orderkey % 3 = 0 AS hex_ok, CASE WHEN o_orderkey % 3 <> 2 THEN octet_length(unhex(CASE o_orderkey % 3 WHEN 0 THEN sha256(o_orderpriority) ELSE left(sha256(o_orderpriority), 62) END)) END AS bytes,
  to_base64(unhex(sha256(o_orderpriority))) AS encoded, sha256(o_orderpriority) AS decoded FROM orders""")
def digest_valid(t: Tables):
    full = F.sha2(F.encode("o_orderpriority", "UTF-8"), 256)
    text = _case(F.col("o_orderkey") % 3, F.concat(F.lit("xy"), F.substring(full, 3, 62)), m0=full, m1=F.substring(full, 1, 62))
    raw = F.when(text.rlike("^[0-9a-f]*$"), F.unhex(text))
    return t.read("orders").select(
        "o_orderkey", h.is_digest(raw).alias("hex_ok"), F.octet_length(raw).cast("bigint").alias("bytes"),
        h.base64_text(F.unhex(full)).alias("encoded"), h.hex_lower(notes.strict_base64(h.base64_text(F.unhex(full)))).alias("decoded"))


def _shown_uuid(millis: str, seed: str) -> str:
    return (f"(substr(printf('%012x', {millis}), 1, 8) || '-' || substr(printf('%012x', {millis}), 9, 4) || '-7' || substr(sha256({seed}), 1, 3) || '-' "
            f"|| substr('89ab', (instr('0123456789abcdef', substr(sha256({seed}), 4, 1)) - 1) % 4 + 1, 1) || substr(sha256({seed}), 5, 3) || '-' || substr(sha256({seed}), 8, 12))")


@query("uuid7_mint", f"SELECT event_id, {_shown_uuid('(epoch_us(ts) // 1000)', 'CAST(event_id AS VARCHAR)')} AS id FROM events")
def uuid7_mint(t: Tables):
    millis = F.call_function("div", micros("ts"), F.lit(1000).cast("bigint"))
    return t.read("events").select("event_id", ids.mint_uuid7(millis, F.col("event_id").cast("string")).alias("id"))


@query("uuid7_valid", "SELECT event_id, event_id % 5 IN (0, 4) AS valid FROM events")
def uuid7_valid(t: Tables):
    good = ids.mint_uuid7(F.col("event_id"), F.col("event_id").cast("string"))
    text = _case(F.col("event_id") % 5, F.upper(good), m0=good, m1=F.overlay(good, F.lit("4"), F.lit(15)),
                 m2=F.overlay(good, F.lit("c"), F.lit(20)), m3=F.replace(good, F.lit("-"), F.lit("")))
    return t.read("events").select("event_id", ids.is_uuid7(text).alias("valid"))


NOTE_SQL = """'log/' || o_custkey || chr(10) || CASE o_orderkey % 6 WHEN 1 THEN 'x' WHEN 2 THEN '18446744073709551616' ELSE CAST(o_orderkey AS VARCHAR) END || chr(10)
  || CASE o_orderkey % 6 WHEN 3 THEN 'AAAA' ELSE to_base64(unhex(sha256(o_orderpriority))) END || chr(10) || CASE WHEN o_orderkey % 6 = 4 THEN 'ext one' || chr(10) || 'ext two' || chr(10) ELSE '' END"""


@query("checkpoint_parse", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 4) THEN 'log/' || o_custkey END AS origin, CASE WHEN o_orderkey % 6 IN (0, 4) THEN o_orderkey END AS size,
  CASE WHEN o_orderkey % 6 IN (0, 4) THEN sha256(o_orderpriority) END AS root, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 4 THEN 'ext one|ext two' END AS extensions FROM orders""")
def checkpoint_parse(t: Tables):
    key = F.col("o_orderkey")
    root = F.unhex(F.sha2(F.encode("o_orderpriority", "UTF-8"), 256))
    size = _case(key % 6, key.cast("string"), m1=F.lit("x"), m2=F.lit("18446744073709551616"))
    body = F.concat(F.lit("log/"), F.col("o_custkey").cast("string"), F.lit("\n"), size, F.lit("\n"),
                    F.when(key % 6 == 3, F.lit("AAAA")).otherwise(h.base64_text(root)), F.lit("\n"),
                    F.when(key % 6 == 4, F.lit("ext one\next two\n")).otherwise(F.lit("")))
    # Every sixth note has no blank line before its signature.
    note = F.concat(body, F.when(key % 6 == 5, F.lit("")).otherwise(F.lit("\n")), F.lit("— signer AAAA\n"))
    parsed = t.read("orders").select("o_orderkey", notes.parse_checkpoint(note).alias("c"))
    return parsed.select("o_orderkey", F.col("c.origin").alias("origin"), F.col("c.size").cast("bigint").alias("size"),
                         h.hex_lower(F.col("c.root")).alias("root"), F.array_join("c.extensions", "|").alias("extensions"))


@query("key_id", "SELECT c_custkey, substr(sha256(encode(c_name) || unhex('0A01') || unhex(sha256(c_mktsegment))), 1, 8) AS key_id FROM customer")
def key_ids(t: Tables):
    public = F.unhex(F.sha2(F.encode("c_mktsegment", "UTF-8"), 256))
    return t.read("customer").select("c_custkey", h.key_id(F.col("c_name"), public).alias("key_id"))


@query("next_key_name", """WITH x AS (SELECT s_suppkey, 'signer' || CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-g2' WHEN 2 THEN '-g' || s_suppkey WHEN 3 THEN '-g0' ELSE '-gold' END AS name FROM supplier)
SELECT s_suppkey, name, CASE s_suppkey % 5 WHEN 0 THEN 'signer-g2' WHEN 1 THEN 'signer-g3' WHEN 2 THEN 'signer-g' || (s_suppkey + 1) WHEN 3 THEN 'signer-g0-g2' ELSE 'signer-gold-g2' END AS next FROM x""")
def next_key_name(t: Tables):
    key = F.col("s_suppkey")
    name = F.concat(F.lit("signer"), _case(key % 5, F.lit("-gold"), m0=F.lit(""), m1=F.lit("-g2"),
                                           m2=F.concat(F.lit("-g"), key.cast("string")), m3=F.lit("-g0")))
    return t.read("supplier").select("s_suppkey", name.alias("name"), notes.next_key_name(name).alias("next"))


@query("format_spans", f"""WITH x AS (SELECT event_id, CAST(event_id AS BIGINT) * event_id * 40000 - 1000000 AS us, greatest(0, CAST(event_id AS BIGINT) * event_id * 40000000 - 1000000000) AS ns FROM events)
SELECT event_id, {sql_span('us')} AS span, {sql_duration('ns')} AS duration, {sql_minutes('ns')} AS minutes, strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM x""")
def format_spans(t: Tables):
    # Decimals: the nanoseconds of later events pass 64 bits.
    number = F.col("event_id").cast("decimal(20,0)")
    us = (number * number).cast("decimal(38,0)") * 40_000 - 1_000_000
    ns = F.greatest(F.lit(0).cast("decimal(38,0)"), us * 1000)
    return t.read("events").select(
        "event_id", times.format_span(us).alias("span"), times.format_duration(ns).alias("duration"),
        times.format_minutes(ns).alias("minutes"), times.format_date(us.try_cast("bigint")).alias("day"))


@query("sanitize_source", "SELECT page_id, translate(url, '/ .' || chr(92), '____') AS name FROM pages")
def sanitize_source(t: Tables):
    return t.read("pages").select("page_id", notes.sanitize_source(F.col("url")).alias("name"))


@query("payload_roundtrip", "SELECT event_id, props AS opened, true AS sealed_differs FROM events")
def payload_roundtrip(t: Tables):
    from tidemark.operators.sealing import open_payload, seal_payload

    key = F.lit(b"0123456789abcdef0123456789abcdef")
    bound = F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    sealed = t.read("events").select("event_id", "props", bound.alias("bound"), seal_payload(F.col("props"), key, bound).alias("ct"))
    return sealed.select("event_id", open_payload(F.col("ct"), key, F.col("bound")).alias("opened"), (F.col("ct") != F.col("props")).alias("sealed_differs"))


@query("assurance_tier", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 OR n_name = 'NATION_' || (s_suppkey % 25) THEN 1 ELSE 2 END AS tier,
  CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 OR n_name = 'NATION_' || (s_suppkey % 25) THEN 'Tier 1 — captured (single administrative domain; not independently verified)'
  ELSE 'Tier 2 — independently verified' END AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def assurance_tiers(t: Tables):
    joined = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    operator = F.when(key % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("NATION_"), (key % 25).cast("string")))
    tier, label = assurance_tier(key % 4 == 0, operator, F.col("n_name"))
    return joined.select("s_suppkey", tier.cast("int").alias("tier"), label.alias("label"))
