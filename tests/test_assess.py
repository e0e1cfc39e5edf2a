"""Foreign-log scenarios as small tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assess as a
from tidemark.operators.mapping import map_lines
from tidemark.plans.assess import AssessPolicy, assess_findings, parse_period
from tidemark.sources.profiles import FieldMap, Profile, ProfileError, load_profile, parse_profile

GENERIC = load_profile("generic")
MINUTE = 60_000_000


def found(spark, lines, profile=GENERIC, policy=AssessPolicy(), malformed=False):
    rows = [(i, line) for i, line in enumerate(lines)]
    mapped = map_lines(spark.createDataFrame(rows, "ordinal bigint, value string"), profile)
    bad = a.count_malformed(mapped) if malformed else None
    out = assess_findings(mapped.where(~F.col("malformed")), profile.capabilities(), policy, ["ordinal"], bad)
    return {r["id"]: r for r in out.collect()}


def line(seq=None, time="2026-03-01T00:00:00Z", kind="x", source="s"):
    number = "" if seq is None else f'"seq":{seq},'
    return f'{{"source":"{source}",{number}"time":"{time}","type":"{kind}"}}'


def test_gap_and_duplicate(spark):
    f = found(spark, [line(1), line(2), line(5), line(5)])
    assert set(f) == {"A-SEQGAP", "A-DUP"}
    assert "2 sequence number(s) missing between 1 and 5: 3-4." in f["A-SEQGAP"]["detail"]
    assert "2×5" in f["A-DUP"]["detail"]


def test_clean(spark):
    assert found(spark, [line(1), line(2), line(3)]) == {}


def test_numbers_beyond_double_precision(spark):
    assert found(spark, [line(9007199254740993), line(9007199254740994), line(18446744073709551615)])["A-SEQGAP"]["detail"].startswith(
        "18437736874454810620 sequence number(s) missing between 9007199254740993 and 18446744073709551615")
    assert found(spark, [line(9007199254740993), line(9007199254740994)]) == {}


def test_exactly_twenty_ranges_are_called_truncated(spark):
    f = found(spark, [line(3 * i) for i in range(1, 22)])
    assert f["A-SEQGAP"]["detail"].count("-") == 20 and "(ranges truncated)" in f["A-SEQGAP"]["detail"]


def test_heartbeat_silence(spark):
    beats = [line(i, f"2026-03-01T00:{m:02d}:00Z", "heartbeat") for i, m in ((1, 0), (2, 1), (3, 20))]
    assert "1 silence(s) exceeded the max-silence policy (3m00s); longest 19m00s" in found(spark, beats)["A-HBGAP"]["detail"]
    equal = [line(1, "2026-03-01T00:00:00Z", "heartbeat"), line(2, "2026-03-01T00:03:00Z", "heartbeat")]
    assert found(spark, equal) == {}


def test_time_step_back_has_a_second_of_tolerance(spark):
    assert "A-TIME" in found(spark, [line(1, "2026-03-01T00:10:00Z"), line(2, "2026-03-01T00:00:00Z")])
    assert found(spark, [line(1, "2026-03-01T00:00:01Z"), line(2, "2026-03-01T00:00:00Z")]) == {}


def test_coverage(spark):
    policy = AssessPolicy(period=parse_period("2026-01-01:2026-06-30"))
    f = found(spark, [line(1, "2026-03-01T00:00:00Z"), line(2, "2026-03-02T00:00:00Z")], policy=policy)
    assert "no data for the first 59d00h" in f["A-COVERAGE"]["detail"]
    assert "period closes 2026-06-30" in f["A-COVERAGE"]["detail"]


def test_events_of_the_last_day_are_outside(spark):
    policy = AssessPolicy(period=parse_period("2026-03-01:2026-03-02"))
    assert "1 record(s) outside" in found(spark, [line(1), line(2, "2026-03-02T08:00:00Z")], policy=policy)["A-TIME"]["detail"]


def test_malformed_share(spark):
    f = found(spark, [line(1), "{broken", "[1]"], malformed=True)
    assert f["A-INPUT"]["detail"].startswith("2 of 3 input lines (66.67%)")


def test_missing_capabilities_leave_analyses_out(spark):
    profile = load_profile("idp-signin")
    f = found(spark, ['{"createdDateTime":"2026-03-01T00:00:00Z"}'] * 2, profile)
    assert f == {} and len(profile.capabilities().missing()) == 2


def test_long_line_is_malformed_not_fatal(spark):
    rows = spark.createDataFrame([(line(1),), ('{"pad":"' + "x" * 400 + '"}',), (line(2),)], "value string")
    flags = [r["malformed"] for r in map_lines(rows, GENERIC, max_line_bytes=128).collect()]
    assert sorted(flags) == [False, False, True]


def test_profile_rules():
    for text in ('{"name":"x"}', '{"name":" ","timestamp":{"field":"t"}}', '{"name":"x","timestamp":{"field":"t","layout":"odd"}}',
                 '{"name":"x","timestamp":{"field":"t"},"source_id":{}}', '{"name":"x","timestamp":{"feild":"t"}}'):
        with pytest.raises(ProfileError):
            parse_profile(text)
    with pytest.raises(ProfileError):
        load_profile("nothing")


def test_constant_timestamp_is_accepted_but_never_applied(spark):
    profile = Profile(name="x", timestamp=FieldMap(const="2026-01-01T00:00:00Z")).validate()
    row = map_lines(spark.createDataFrame([("{}",)], "value string"), profile).first()
    assert row["time_us"] is None and row["source_id"] == "assessed-source"


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
def test_block_width_changes_nothing(spark, width):
    rows = [("a", s) for s in (1, 2, 5, 9, 9, 30, 31, 64)] + [("b", s) for s in (7, 8)]
    log = spark.createDataFrame(rows, "source_id string, seq bigint")
    steps = a.gap_steps(a.distinct_sequences(log), width)
    got = sorted((r["source_id"], r["lo"], r["hi"]) for r in a.gap_ranges(steps).collect())
    assert got == [("a", 3, 4), ("a", 6, 8), ("a", 10, 29), ("a", 32, 63)]
    facts = {r["source_id"]: r for r in a.sequence_facts(steps).collect()}
    assert facts["a"]["ranges"] == "3-4, 6-8, 10-29, 32-63" and facts["a"]["values"] == "2×9" and facts["b"]["gaps"] == 0


def test_one_hot_source_and_many_copies(spark):
    hot = spark.range(0, 20000).select(F.lit("hot").alias("source_id"), (F.col("id") % 5000).alias("seq"), F.col("id").alias("ordinal"),
                                       (F.col("id") * MINUTE).alias("time_us"), F.lit(False).alias("heartbeat"))
    facts = a.sequence_facts(a.gap_steps(a.distinct_sequences(hot), 64)).first()
    assert facts["gaps"] == 0 and facts["repeated"] == 5000 and facts["values"].count(",") == 19
    rows = sorted(((i % 5000, i) for i in range(20000)))
    steps = sum(1 for (_, p), (_, q) in zip(rows, rows[1:]) if q * MINUTE < p * MINUTE - 1_000_000)
    assert a.step_backs(hot, ["ordinal"]).first()["step_backs"] == steps
