"""Queries over foreign logs: sequence, duplicate, silence, time and coverage analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import Tables, query
from tidemark.catalog.logs import DAY_US, LINE_ORDER, LINE_SQL, USER_SQL, line_log, sql_span, user_log
from tidemark.catalog.mapping import GENERIC, INPUT_FINDING_SQL, SCANNED_SQL, written_lines
from tidemark.catalog.sqltext import finding_select
from tidemark.functions.texts import COVERAGE_PARTS, CUT, TIME_PARTS, filled_sql, quoted
from tidemark.functions.times import span_text
from tidemark.operators import assess as a
from tidemark.plans import assess as plan
from tidemark.sources.profiles import Capabilities

LINE_CAPS = Capabilities(sequenced=True, heartbeats=False, typed=True, actors=False)
USER_CAPS = Capabilities(sequenced=True, heartbeats=True, typed=True, actors=False)
LINE_POLICY = plan.AssessPolicy(period=plan.parse_period("1996-01-01:1999-06-30"))
USER_POLICY = plan.AssessPolicy(max_silence_us=DAY_US, period=plan.parse_period("2024-01-01:2024-01-29"))
FINDING_COLUMNS = ["source_id", "ord", "id", "severity", "title", "detail", "recommendation"]

GAPS_SQL = """distinct_seqs AS (SELECT source_id, seq, count(*) AS copies FROM {log} GROUP BY ALL),
lagged AS (SELECT source_id, seq, lag(seq) OVER (PARTITION BY source_id ORDER BY seq) AS p FROM distinct_seqs),
ranges AS (SELECT source_id, p + 1 AS lo, seq - 1 AS hi, seq - p - 1 AS missing FROM lagged WHERE seq > p + 1)"""
RANGE_TEXT = "CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END"
GAP_LISTS_SQL = f"""range_lists AS (SELECT source_id, string_agg({RANGE_TEXT}, ', ' ORDER BY lo) AS ranges, count(*) AS listed
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY lo) AS r FROM ranges) WHERE r <= 20 GROUP BY source_id),
gap_totals AS (SELECT source_id, CAST(sum(missing) AS BIGINT) AS missing, count(*) AS gaps FROM ranges GROUP BY source_id),
seq_spread AS (SELECT source_id, min(seq) AS seq_first, max(seq) AS seq_last FROM distinct_seqs GROUP BY source_id),
dup_lists AS (SELECT source_id, string_agg(copies || '×' || seq, ', ' ORDER BY seq) AS vals, max(total) AS repeated
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY source_id) AS total
        FROM distinct_seqs WHERE copies > 1) WHERE r <= 20 GROUP BY source_id)"""


GAP_FINDING_SQL = finding_select(
    "A-SEQGAP", 2, "gap_totals JOIN seq_spread USING (source_id) JOIN range_lists USING (source_id)", missing="missing", seq_first="seq_first",
    seq_last="seq_last", ranges="ranges", cut=f"CASE WHEN listed < missing AND listed = 20 THEN {quoted(CUT)} ELSE '' END")
DUP_FINDING_SQL = finding_select("A-DUP", 3, "dup_lists", values="vals")
SILENCE_SQL = f"""silence AS (SELECT * FROM (
  SELECT source_id, lag(time_us) OVER (PARTITION BY source_id ORDER BY time_us) AS start_us, time_us AS end_us
  FROM user_log WHERE heartbeat) WHERE end_us - start_us > {DAY_US}),
silence_totals AS (SELECT source_id, count(*) AS n, max(end_us - start_us) AS longest FROM silence GROUP BY source_id)"""
SILENCE_FINDING_SQL = finding_select("A-HBGAP", 4, "silence_totals", silences="n", limit=quoted(span_text(DAY_US)), longest=sql_span("longest"))


def time_sql(log: str, order: str, period) -> str:
    start, end = period
    return f"""steps AS (SELECT source_id, count(*) AS step_backs FROM (
  SELECT source_id, time_us, lag(time_us) OVER (PARTITION BY source_id ORDER BY {order}) AS p FROM {log}) WHERE time_us < p - 1000000 GROUP BY source_id),
time_counts AS (SELECT source_id, CAST(sum(CASE WHEN time_us IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS untimed,
  CAST(sum(CASE WHEN time_us < {start} OR time_us > {end} THEN 1 ELSE 0 END) AS BIGINT) AS outside,
  coalesce(any_value(step_backs), 0) AS step_backs FROM {log} LEFT JOIN steps USING (source_id) GROUP BY source_id),
spans AS (SELECT source_id, count(*) AS records, min(time_us) AS first_us, max(time_us) AS last_us FROM {log} GROUP BY source_id)"""


TIME_PARTS_SQL = ", ".join(f"CASE WHEN {name} > 0 THEN {name} || {quoted(' ' + text)} END" for name, text in TIME_PARTS.items())
TIME_FINDING_SQL = finding_select("A-TIME", 5, "time_counts WHERE untimed + outside + step_backs > 0", parts=f"concat_ws('; ', {TIME_PARTS_SQL})")


def coverage_sql(period) -> str:
    start, end = period
    slack = a.COVERAGE_SLACK_US
    date = lambda us: f"strftime(make_timestamp({us}), '%Y-%m-%d')"
    head = filled_sql(COVERAGE_PARTS[0], gap=sql_span(f"(first_us - {start})"), seen=date("first_us"), edge=date(f"CAST({start} AS BIGINT)"))
    tail = filled_sql(COVERAGE_PARTS[1], gap=sql_span(f"({end} - last_us)"), seen=date("last_us"), edge=date(f"CAST({end} AS BIGINT)"))
    parts = f"concat_ws('; ', CASE WHEN first_us > {start} + {slack} THEN {head} END, CASE WHEN last_us < {end} - {slack} THEN {tail} END)"
    return finding_select("A-COVERAGE", 6, f"(SELECT source_id, {parts} AS parts FROM spans) WHERE parts <> ''", parts="parts")


LINE_ORDER_SQL = "seq, " + ", ".join(LINE_ORDER)
LINE_FINDINGS_SQL = f"""WITH {LINE_SQL}, {GAPS_SQL.format(log='line_log')}, {GAP_LISTS_SQL},
{time_sql('line_log', LINE_ORDER_SQL, LINE_POLICY.period)},
found AS ({GAP_FINDING_SQL} UNION ALL {DUP_FINDING_SQL} UNION ALL {TIME_FINDING_SQL} UNION ALL {coverage_sql(LINE_POLICY.period)})"""
USER_FINDINGS_SQL = f"""WITH {USER_SQL}, {GAPS_SQL.format(log='user_log')}, {GAP_LISTS_SQL}, {SILENCE_SQL},
{time_sql('user_log', 'seq, ordinal', USER_POLICY.period)},
found AS ({GAP_FINDING_SQL} UNION ALL {DUP_FINDING_SQL} UNION ALL {SILENCE_FINDING_SQL} UNION ALL {TIME_FINDING_SQL}
  UNION ALL {coverage_sql(USER_POLICY.period)})"""


def line_findings(t: Tables):
    return plan.assess_findings(line_log(t), LINE_CAPS, LINE_POLICY, LINE_ORDER)


def user_findings(t: Tables):
    return plan.assess_findings(user_log(t), USER_CAPS, USER_POLICY, ["ordinal"])


@query("findings_assess", f"{LINE_FINDINGS_SQL} SELECT * FROM found")
def findings_assess(t: Tables):
    return line_findings(t)


@query("findings_table", f"{USER_FINDINGS_SQL} SELECT * FROM found")
def findings_table(t: Tables):
    return user_findings(t)


@query("seq_gap_ranges", f"""WITH {LINE_SQL}, {GAPS_SQL.format(log='line_log')}
SELECT source_id, lo, hi, missing FROM ranges""")
def seq_gap_ranges(t: Tables):
    return a.gap_ranges(a.gap_steps(a.distinct_sequences(line_log(t))))


@query("duplicate_numbers", f"""WITH {LINE_SQL}, {GAPS_SQL.format(log='line_log')} SELECT source_id, seq, copies FROM distinct_seqs WHERE copies > 1""")
def duplicate_numbers(t: Tables):
    return a.duplicate_numbers(a.gap_steps(a.distinct_sequences(line_log(t))))


@query("a_seqgap", f"""WITH {USER_SQL}, {GAPS_SQL.format(log='user_log')}, {GAP_LISTS_SQL}
SELECT source_id, missing, gaps, seq_first, seq_last, ranges, listed
FROM gap_totals JOIN seq_spread USING (source_id) JOIN range_lists USING (source_id)""")
def a_seqgap(t: Tables):
    facts = a.sequence_facts(a.block_steps(a.distinct_sequences(user_log(t))), stitched=False).where(F.col("gaps") > 0)
    return facts.select("source_id", "missing", "gaps", "seq_first", "seq_last", "ranges", F.col("listed").cast("bigint").alias("listed"))


@query("a_dup", f"""WITH {LINE_SQL}, {GAPS_SQL.format(log='line_log')}, {GAP_LISTS_SQL}
SELECT source_id, repeated, vals FROM dup_lists""")
def a_dup(t: Tables):
    facts = a.sequence_facts(a.block_steps(a.distinct_sequences(line_log(t))), stitched=False)
    return facts.where(F.col("repeated") > 0).select("source_id", "repeated", F.col("values").alias("vals"))


@query("hb_gaps_foreign", f"""WITH {USER_SQL}, {SILENCE_SQL}
SELECT source_id, start_us, end_us, end_us - start_us AS gap_us FROM silence""")
def hb_gaps_foreign(t: Tables):
    return a.silences(user_log(t), DAY_US)


@query("a_time", f"""WITH {LINE_SQL}, {time_sql('line_log', LINE_ORDER_SQL, LINE_POLICY.period)}
SELECT source_id, untimed, outside, step_backs FROM time_counts""")
def a_time(t: Tables):
    log = line_log(t)
    counts = a.source_facts(log, LINE_POLICY.period).select("source_id", "untimed", "outside")
    return counts.join(a.step_backs(log, LINE_ORDER), "source_id", "left").fillna(0, ["step_backs"])


@query("a_coverage", f"""WITH {USER_SQL}, {time_sql('user_log', 'seq, ordinal', USER_POLICY.period)}
{coverage_sql(USER_POLICY.period)}""")
def a_coverage(t: Tables):
    return a.raised(a.source_facts(user_log(t)), [a.coverage_finding(USER_POLICY.period)])


@query("source_span", f"""WITH {LINE_SQL} SELECT source_id, count(*) AS records, min(time_us) AS first_us, max(time_us) AS last_us
FROM line_log GROUP BY source_id""")
def source_span(t: Tables):
    return a.source_span(line_log(t))


@query("event_counts_foreign", f"""WITH {USER_SQL} SELECT source_id, CASE WHEN type = 'click' THEN '(untyped)' ELSE type END AS type, count(*) AS n
FROM user_log WHERE NOT heartbeat GROUP BY ALL""")
def event_counts_foreign(t: Tables):
    # Clicks stand for records whose type mapping gave nothing.
    untyped = F.when(F.col("type") == "click", F.lit("")).otherwise(F.col("type"))
    return a.event_counts(user_log(t).withColumn("type", untyped))


@query("event_totals", f"""WITH {LINE_SQL}, counts AS (SELECT source_id, type, count(*) AS n FROM line_log GROUP BY ALL)
SELECT type, source_id, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY GROUPING SETS ((type, source_id), (type))""")
def event_totals(t: Tables):
    return a.event_totals(a.event_counts(line_log(t)))


@query("finding_counts", f"""{USER_FINDINGS_SQL}
SELECT source_id, count(id) AS findings, count(id) > 0 AS failed FROM spans LEFT JOIN found USING (source_id) GROUP BY source_id""")
def finding_counts(t: Tables):
    return plan.finding_counts(a.source_span(user_log(t)), user_findings(t))


@query("assess_tables", f"""{USER_FINDINGS_SQL}, n AS (SELECT source_id, count(id) AS c FROM spans LEFT JOIN found USING (source_id) GROUP BY source_id)
SELECT source_id, records, strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M UTC') AS observed_from,
  strftime(make_timestamp(last_us), '%Y-%m-%d %H:%M UTC') AS observed_to,
  CASE WHEN c = 0 THEN 'no anomalies (Tier 0 — indicative)' WHEN c = 1 THEN '1 finding (Tier 0 — indicative)'
       ELSE c || ' findings (Tier 0 — indicative)' END AS verdict,
  'sequence-gap/duplicate, observation-gap, timestamp, coverage' AS assessed, '' AS not_assessable
FROM spans JOIN n USING (source_id)""")
def assess_tables(t: Tables):
    return plan.assess_tables(user_log(t), user_findings(t), USER_CAPS)


@query("source_list", """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source_id FROM lineitem""")
def source_list(t: Tables):
    return line_log(t).select("source_id").distinct()


@query("capabilities", f"""WITH {LINE_SQL}, sources AS (SELECT DISTINCT source_id FROM line_log)
SELECT source_id, true AS sequenced, false AS heartbeats, true AS typed, false AS actors,
  'observation-gap detection (no heartbeat marker mapped)' AS not_assessable FROM sources""")
def capabilities(t: Tables):
    caps = LINE_CAPS
    return line_log(t).select("source_id").distinct().select(
        "source_id", F.lit(caps.sequenced).alias("sequenced"), F.lit(caps.heartbeats).alias("heartbeats"),
        F.lit(caps.typed).alias("typed"), F.lit(caps.actors).alias("actors"),
        F.lit("; ".join(caps.missing())).alias("not_assessable"))


FILE_POLICY = plan.AssessPolicy(max_silence_us=DAY_US, period=plan.parse_period("2024-01-02:2024-01-29"))
FILE_SQL = f"""{SCANNED_SQL}, file_log AS (SELECT source_id, CAST(seq AS HUGEINT) AS seq, time_us, heartbeat, ordinal FROM scanned WHERE NOT malformed)"""
FILE_TIME_SQL = time_sql("file_log", "seq, ordinal", FILE_POLICY.period)
FILE_FINDINGS_SQL = f"""WITH {FILE_SQL}, {GAPS_SQL.format(log='(SELECT * FROM file_log WHERE seq IS NOT NULL)')}, {GAP_LISTS_SQL.replace('AS BIGINT', 'AS HUGEINT')},
{SILENCE_SQL.replace('user_log WHERE heartbeat', 'file_log WHERE heartbeat AND time_us IS NOT NULL')},
steps AS (SELECT source_id, count(*) AS step_backs FROM (SELECT source_id, time_us, lag(time_us) OVER (PARTITION BY source_id ORDER BY seq, ordinal) AS p
  FROM file_log WHERE seq IS NOT NULL AND time_us IS NOT NULL) WHERE time_us < p - 1000000 GROUP BY source_id),
{FILE_TIME_SQL[FILE_TIME_SQL.index('time_counts AS'):]},
bad AS (SELECT count(*) AS malformed FROM scanned WHERE malformed), per AS (SELECT source_id, count(*) AS records FROM file_log GROUP BY source_id),
found AS ({INPUT_FINDING_SQL} UNION ALL {GAP_FINDING_SQL} UNION ALL {DUP_FINDING_SQL} UNION ALL {SILENCE_FINDING_SQL} UNION ALL {TIME_FINDING_SQL}
  UNION ALL {coverage_sql(FILE_POLICY.period)})"""


@query("assess_jsonl", f"{FILE_FINDINGS_SQL} SELECT * FROM found")
def assess_jsonl(t: Tables):
    return plan.assess_files(t.spark, written_lines(t), GENERIC, FILE_POLICY).findings
