"""Captured-log scenarios: chains, trees, continuity, retention, checkpoints."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import ZERO_HASH
from tidemark.operators import captured as cap
from tidemark.operators import chain, checkpoints as cps, continuity as con, intake, intervals, proofs, retention as ret
from tidemark.operators.digests import ordered_digests
from tidemark.operators.merkle import MAX_LEVEL, merkle_roots, prefix_roots, range_parts
from tidemark.operators.ordered import spans_between, stitched_lag, stitched_row_number, stitched_running
from tidemark.operators.segments import segments_by_age

SECOND = 1_000_000_000
START = 1_767_225_600 * SECOND


def stamp(ns):
    from tidemark.operators.export import _pinned

    return _pinned(ns)


def records(kinds, source="s", first=1):
    """Chained frames of (event_type, seconds, payload) rows."""
    out, previous = [], ZERO_HASH
    for i, (kind, seconds, payload) in enumerate(kinds):
        body = {"v": 2, "source_id": source, "seq": first + i, "event_type": kind, "event_time": stamp(START + int(seconds * SECOND)),
                "ingest_time": stamp(START), "actor": "", "outcome": "", "payload_clear": payload, "prev_hash": previous}
        data = json.dumps(body, separators=(",", ":")).encode()
        previous = hashlib.sha256(data).hexdigest()
        out.append([source, i, bytearray(data), previous])
    return out


def frames(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], "source_id string, ordinal bigint, record_bytes binary, claimed_hash string")


def checked(df):
    p = chain.parsed_frames(df)
    return p.select("source_id", "ordinal", "claimed_hash", "record_hash", "parse_error", F.col("record.seq").alias("seq"),
                    F.col("record.prev_hash").alias("prev_hash"))


def verdict(spark, rows, covered=None):
    return chain.chain_verdicts(checked(frames(spark, rows)), covered, width=2).first()


BEATS = [(cap.HEARTBEAT, 60 * i, {"health": {"clock_drift_ms": 5}}) for i in range(5)]


def root_of(leaves):
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + root_of(leaves[:k]) + root_of(leaves[k:])).digest()


def test_chain_kinds(spark):
    assert verdict(spark, records(BEATS))["chain_valid"]
    tampered = records(BEATS)
    tampered[1][2][5] ^= 1
    assert verdict(spark, tampered)["kind"] == "hash"
    dropped = [r for r in records(BEATS) if r[1] != 2]
    assert verdict(spark, dropped)["message"] == "chain: sequence gap: expected seq 3, got 4"
    rewritten = records(BEATS)
    data = bytes(rewritten[2][2]).replace(rewritten[1][3].encode(), b"a" * 64)
    rewritten[2][2], rewritten[2][3] = bytearray(data), hashlib.sha256(data).hexdigest()
    assert verdict(spark, rewritten)["kind"] == "link"
    late = records(BEATS)[1:]
    assert verdict(spark, late)["kind"] == "link"
    assert verdict(spark, records(BEATS, first=7))["chain_valid"]


def test_chain_across_tombstones(spark):
    kept = records(BEATS + BEATS)[3:]
    cover = lambda hi: intervals.merge_ranges(spark.createDataFrame([("s", 1, 2), ("s", 3, hi)], "source_id string, lo bigint, hi bigint"))
    assert verdict(spark, kept, cover(3))["chain_valid"]
    assert verdict(spark, records(BEATS + BEATS)[4:], cover(3))["kind"] == "gap"


def test_split_runs_bound_a_chain(spark):
    events = spark.range(10).select(F.lit("s").alias("source_id"), (F.col("id") + 1).alias("seq"), F.lit('{"prev_hash":"').alias("body"))
    built = chain.build_chain(chain.split_runs(events, 4))
    assert {r["source_id"]: r["n"] for r in built.groupBy("source_id").agg(F.count("*").alias("n")).collect()} == {"s": 4, "s~1": 4, "s~2": 2}
    assert built.where(F.col("seq") == 1).count() == 3


def test_building_goes_on_from_stored_heads(spark):
    events = spark.range(6).select(F.lit("s").alias("source_id"), (F.col("id") + 1).alias("seq"), F.lit('{"prev_hash":"').alias("body"))
    whole = {r["seq"]: r["claimed_hash"] for r in chain.build_chain(events).collect()}
    heads = spark.createDataFrame([("s", whole[4])], "source_id string, last_hash string")
    rest = {r["seq"]: r["claimed_hash"] for r in chain.build_chain(events.where("seq > 4"), heads).collect()}
    assert rest == {5: whole[5], 6: whole[6]}


def test_roots_equal_the_recursive_definition(spark):
    sizes = [1, 2, 3, 5, 8, 37, 256, 300]
    leaf = lambda n, i: hashlib.sha256(f"{n}/{i}".encode()).digest()
    rows = [(str(n), i, bytearray(leaf(n, i))) for n in sizes for i in range(n)]
    got = {int(r["source_id"]): bytes(r["root"]) for r in merkle_roots(spark.createDataFrame(rows, "source_id string, idx bigint, leaf binary")).collect()}
    assert got == {n: root_of([leaf(n, i) for i in range(n)]) for n in sizes}


def test_prefixes_across_rounds(spark):
    leaves = spark.range(20000).select(F.lit("s").alias("source_id"), F.col("id").alias("idx"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    asked = [0, 1, 8191, 8192, 8193, 16384, 19999, 20000, 20001]
    got = {r["size"]: bytes(r["root"]) for r in prefix_roots(leaves, spark.createDataFrame([("s", n) for n in asked], "source_id string, size bigint")).collect()}
    hashes = [hashlib.sha256(str(i).encode()).digest() for i in range(20000)]
    assert got == {n: root_of(hashes[:n]) for n in asked if n <= 20000}


def test_proofs_verify_for_all_small_trees(spark):
    hashes = [hashlib.sha256(bytes([i])).digest() for i in range(16)]
    leaves = spark.createDataFrame([("s", i, bytearray(h)) for i, h in enumerate(hashes)], "source_id string, idx bigint, leaf binary")
    roots = spark.createDataFrame([("s", n, bytearray(root_of(hashes[:n]))) for n in range(1, 17)], "source_id string, size bigint, root binary")
    pairs = [("s", i, n) for n in range(1, 17) for i in range(n)]
    asked = spark.createDataFrame(pairs, "source_id string, idx bigint, size bigint")
    done = proofs.verify_inclusion(proofs.inclusion_proofs(leaves, asked).join(leaves, ["source_id", "idx"]).join(roots, ["source_id", "size"]))
    assert done.where("included").count() == len(pairs)
    grown = spark.createDataFrame([("s", m, n) for n in range(1, 17) for m in range(1, n + 1)], "source_id string, old bigint, size bigint")
    both = (proofs.consistency_proofs(leaves, grown).join(roots, ["source_id", "size"])
            .join(roots.selectExpr("source_id", "size AS old", "root AS old_root"), ["source_id", "old"]))
    assert proofs.verify_consistency(both).where("consistent").count() == grown.count()
    swapped = both.where("old < size").withColumn("old_root", F.reverse("old_root"))
    assert proofs.verify_consistency(swapped).where("consistent").count() == 0


def test_paths_across_tiles(spark):
    hashes = [hashlib.sha256(str(i).encode()).digest() for i in range(20000)]

    def path(i, low, high):
        if high - low == 1:
            return []
        half = 1 << (high - low - 1).bit_length() - 1
        return path(i, low, low + half) + [root_of(hashes[low + half:high])] if i - low < half else path(i, low + half, high) + [root_of(hashes[low:low + half])]

    leaves = spark.createDataFrame([("s", i, bytearray(h)) for i, h in enumerate(hashes)] + [("t", 0, bytearray(hashes[0]))], "source_id string, idx bigint, leaf binary")
    asked = [(i, n) for n in (1, 2, 8191, 8192, 8193, 12345, 16384, 16385, 19999, 20000) for i in (0, 1, 4095, 8190, 8191, 8192, 12344, 16384, 19999) if i < n]
    odd = [("t", 0, 1, 7), ("t", 1, 1, 8), ("none", 0, 1, 9), (None, 0, 1, 10)]
    rows = proofs.inclusion_proofs(leaves, spark.createDataFrame([("s", i, n, 0) for i, n in asked] + odd, "source_id string, idx bigint, size bigint, more int")).collect()
    assert {(r.idx, r["size"]): [bytes(h) for h in r.path] for r in rows if r.more == 0} == {(i, n): path(i, 0, n) for i, n in asked}
    assert sorted(r.more for r in rows if r.more) == [7, 8, 9, 10] and not any(r.path for r in rows if r.more)


def test_asks_that_are_alike_stay_in_one_table():
    import pyarrow as pa

    rows = [("s", 0, 0, None, 9), *[("s", 0, 2, i, 9) for i in (1, 2, 2, 2, 2, 2, 3)], ("s", 1, 0, None, 9), ("s", 1, 2, 5, 9), ("s", 1, 2, 5, 9)]
    names = ["source_id", "_tile", "_kind", "_idx", "_size"]
    whole = pa.table(dict(zip(names, zip(*rows), strict=True)))
    for most in range(1, len(rows) + 1):
        parts = [t.to_pylist() for t in proofs._whole_runs(iter(whole.to_batches(max_chunksize=most)))]
        assert [tuple(r.values()) for part in parts for r in part] == rows
        assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))


def log(spark, rows):
    return cap.records_of(frames(spark, rows))


def test_continuity(spark):
    r = log(spark, records(BEATS))
    s = con.continuity_summary(r).first()
    assert (s["observed"], s["expected"], s["longest_gap_ns"], s["within_policy"]) == (5, 4, 60 * SECOND, True)
    gap = [(cap.HEARTBEAT, 0, {}), (cap.HEARTBEAT, 47 * 60, {})]
    w = con.observation_windows(log(spark, records(gap))).first()
    assert w["gap_ns"] == 47 * 60 * SECOND and not w["bounded"]
    stopped = [gap[0], (cap.STOPPED, 10, {}), gap[1]]
    assert con.observation_windows(log(spark, records(stopped))).first()["bounded"]
    none = con.continuity_summary(log(spark, records([("app.x", 0, {})]))).first()
    assert (none["observed"], none["expected"], none["within_policy"]) == (0, 0, False)


def test_transport_and_drift(spark):
    rows = [("app.x", 0, {}), (cap.OUTAGE, 60, {}), ("app.x", 70, {}), ("app.x", 80, {}), (cap.REPLAY, 540, {}), (cap.REPLAY, 550, {})]
    t = con.transport_summary(log(spark, records(rows)), width=2).first()
    assert (t["outages"], t["longest_outage_ns"], t["buffered"], t["replay_completed"]) == (1, 480 * SECOND, 2, True)
    still = con.transport_summary(log(spark, records(rows + [(cap.OUTAGE, 600, {})]))).first()
    assert still["outages"] == 2 and not still["replay_completed"]
    drift = [(cap.HEARTBEAT, 0, {"health": {"clock_drift_ms": -2000}})]
    assert cap.clock_drift(log(spark, records(drift))).first()["max_drift_ms"] == 2000


@pytest.mark.parametrize("width", [2, 1 << 20])
def test_spans_find_the_longest_and_all_over_the_limit(spark, width):
    rng = random.Random(7)
    for limit in (3, 40, 5000):
        times = sorted(rng.sample(range(100_000), 300)) + [100_000] * 3
        points = spark.createDataFrame([("s", t) for t in times] + [("one", 5)], "source_id string, t bigint")
        got = [r for r in spans_between(points, ["source_id"], "t", limit, width).collect() if r["source_id"] == "s" and r["start"] is not None]
        gaps = [(p, q) for p, q in zip(times, times[1:])]
        assert max(r["gap"] for r in got) == max(q - p for p, q in gaps)
        assert sorted((r["start"], r["stop"]) for r in got if r["gap"] > limit) == [g for g in gaps if g[1] - g[0] > limit]
        assert all(r["before"] == times.index(r["stop"]) for r in got if r["gap"] > limit)


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_stitching_equals_plain_windows(spark, width):
    from pyspark.sql import Window

    rng = random.Random(1)
    rows = [(s, o, rng.randrange(100)) for s in "ab" for o in rng.sample(range(300), 60)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    w = Window.partitionBy("k").orderBy("o")
    plain = df.select("k", "o", F.lag("v").over(w).alias("lag"), F.row_number().over(w).cast("bigint").alias("n"),
                      F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    got = stitched_lag(df, ["k"], "o", ["v"], width)
    got = stitched_row_number(got, ["k"], "o", "n", width)
    got = stitched_running(got, ["k"], "o", "m", F.col("v"), "max", False, width).selectExpr("k", "o", "prev_v AS lag", "n", "m")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_segments_by_age_equal_greedy_cutting(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for source in "abc":
        t, first, count, segment = 0, 0, 0, -1
        for seq in range(1, 200):
            t += rng.choice([1, 1, 1, 2, 9, 30])
            if segment < 0 or count == 8 or t - first >= 40:
                segment, first, count = segment + 1, t, 0
            count += 1
            rows.append((source, seq, t))
            expected[source, seq] = segment
    df = spark.createDataFrame(rows, "source_id string, seq bigint, time_ns bigint")
    for block in (8, 11, 1000):
        got = {(r["source_id"], r["seq"]): r["segment"] for r in segments_by_age(df, 8, 40, block).collect()}
        assert got == expected


def test_segment_seal_rule(spark):
    df = spark.createDataFrame([("s", 1, 0), ("s", 2, 59), ("s", 3, 60)], "source_id string, seq bigint, time_ns bigint")
    assert [r["segment"] for r in segments_by_age(df, 256, 60, 256).orderBy("seq").collect()] == [0, 0, 1]


def test_one_digest_at_every_size(spark):
    rows = [(f"k{n}", 7 * i, bytearray(b"x%d" % i)) for n in (1, 3, 50, 64) for i in range(n)]
    got = {r["k"]: r for r in ordered_digests(spark.createDataFrame(rows, "k string, o bigint, d binary"), "k", "o", "d").collect()}
    for n in (1, 3, 50, 64):
        leaves = [hashlib.sha256(b"\x00x%d" % i).digest() for i in range(n)]
        assert (got[f"k{n}"]["digest"], got[f"k{n}"]["records"]) == (root_of(leaves).hex(), n)


def test_sizes_of_any_bigint(spark):
    sizes = [1, 2**40 + 1, 2**39 - 1, 2**62 - 1, 2**61 + 2**20 + 5]
    parts = spark.createDataFrame([(n,) for n in sizes], "size bigint").select("size", F.expr(f"inline({range_parts(str(MAX_LEVEL + 1), 'size')})"))
    covered = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.sum(F.expr("shiftleft(1L, level)")).alias("n")).collect()}
    assert covered == {n: n for n in sizes}


def test_first_release_wins(spark):
    held = spark.createDataFrame([("a", None), ("b", "done")], "hold_id string, released_at string")
    asked = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 4), ("c", 5)], "hold_id string, pos bigint")
    assert {r["pos"]: r["status"] for r in ret.release_requests(asked, held, "pos").collect()} == {
        1: "released", 2: "already_released", 3: "already_released", 4: "already_released", 5: "not_found"}


def test_second_delivery_is_a_duplicate(spark):
    schema = "source_id string, seq_first bigint, seq_last bigint, root binary, pos bigint"
    delivered = spark.createDataFrame([("s", 1, 2, bytearray(b"r"), 1), ("s", 1, 2, bytearray(b"r"), 2), ("s", 3, 4, bytearray(b"q"), 3)], schema)
    stored = spark.createDataFrame([("s", 3, 4, bytearray(b"q"), 0)], schema)
    assert {r["pos"]: r["duplicate"] for r in intake.flag_duplicates(delivered, stored, "pos").collect()} == {1: False, 2: True, 3: True}


def test_forks(spark):
    rows = [("o", 1, 4, b"a"), ("o", 2, 4, b"b"), ("o", 3, 3, b"c"), ("o", 4, 4, b"a"), ("o", 5, 9, b"d")]
    df = spark.createDataFrame([(o, p, s, bytearray(r)) for o, p, s, r in rows], "origin string, pos bigint, size bigint, root binary")
    judged = {r["pos"]: r["status"] for r in cps.judge_submissions(df, width=2).collect()}
    assert judged == {1: "accepted", 2: "different root at same tree size", 3: "tree size decreased", 4: "repeated", 5: "accepted"}


def segments(spark):
    rows = [("a", "s", 1, 10, "2025-11-20T00:00:00.000000000Z", None), ("b", "s", 11, 20, "2025-11-21T00:00:00.000000000Z", None),
            ("c", "s", 21, 30, "2026-01-01T00:00:00.000000000Z", None)]
    return spark.createDataFrame(rows, "segment_id string, source_id string, seq_first bigint, seq_last bigint, created_at string, deleted_at string")


def holds(spark, *ranges):
    return spark.createDataFrame([(str(i), "s", lo, hi, None) for i, (lo, hi) in enumerate(ranges)],
                                 "hold_id string, source_id string, seq_first bigint, seq_last bigint, released_at string")


@pytest.mark.parametrize("held, gone", [([], ["a", "b"]), ([(None, None)], []), ([(5, 8)], ["b"]), ([(10, 11)], []), ([(21, 30)], ["a", "b"])])
def test_retention(spark, held, gone):
    out = ret.expire(segments(spark), holds(spark, *held), 30, "2025-12-31T00:00:00.000000000Z")
    assert sorted(r["segment_id"] for r in out.where("expired").collect()) == gone
    assert out.count() == 3
    off = ret.expire(segments(spark), holds(spark, *held), 0, "2026-12-01T00:00:00.000000000Z")
    assert off.where("expired").count() == 0


def test_pages(spark):
    df = spark.range(7).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("hold_id"), F.lit("s").alias("source_id"))
    sizes, token = [], ""
    while True:
        page = ret.list_page(df, "hold_id", 3, token).collect()
        sizes.append(len(page))
        token = page[0]["next_token"]
        if not token:
            break
    assert sizes == [3, 3, 1] and ret.page_size(0) == ret.page_size(5000) == 1000


def test_overlap_and_cover_equal_pairwise_tests(spark):
    rng = random.Random(11)
    ranges = [(s, lo, lo + rng.randrange(6)) for s in "ab" for lo in rng.sample(range(200), 25)]
    probes = [(s, i, lo, lo + rng.randrange(5)) for s in "abc" for i, lo in enumerate(rng.sample(range(200), 60))]
    r = spark.createDataFrame(ranges, "source_id string, lo bigint, hi bigint")
    p = spark.createDataFrame(probes, "source_id string, n bigint, first bigint, last bigint")
    merged = intervals.merge_ranges(r, width=16)
    flat = {s: sorted((m["lo"], m["hi"]) for m in merged.collect() if m["source_id"] == s) for s in "abc"}
    numbers = {s: {x for q, lo, hi in ranges if q == s for x in range(lo, hi + 1)} for s in "abc"}
    assert all({x for lo, hi in flat[s] for x in range(lo, hi + 1)} == numbers[s] for s in "abc")
    assert all(b[0] > a[1] + 1 for s in "abc" for a, b in zip(flat[s], flat[s][1:]))
    got = {(x["source_id"], x["n"]): x["overlaps"] for x in intervals.overlapping(p, "first", "last", r).collect()}
    assert got == {(s, i): any(q == s and lo <= last and hi >= first for q, lo, hi in ranges) for s, i, first, last in probes}
    inside = {(x["source_id"], x["n"]): x["covered"] for x in intervals.covered(p, "first", "last", merged).collect()}
    assert inside == {(s, i): any(lo <= first and last <= hi for lo, hi in flat[s]) for s, i, first, last in probes}
