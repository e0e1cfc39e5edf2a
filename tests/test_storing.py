"""Tables that grow and merge: ledger, segment intake, Merkle tiles, bundles, heads and salts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import export, passes
from tidemark.operators import chain
from tidemark.operators.merkle import TILE, build_tiles, prefix_roots
from tidemark.operators.ordered import spans_between
from tidemark.plans import bundles, ingest
from tidemark.plans.states import Heads, Salts
from tidemark.plans.tiles import TileLog
from tidemark.session import scratch_path
from tidemark.sources.ledger import Conflict, Ledger, Snapshots


def root_of(leaves):
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return hashlib.sha256(b"\x01" + root_of(leaves[:k]) + root_of(leaves[k:])).digest()


def rows(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def held(ledger):
    return sorted(r["v"] for r in ledger.read("rows", "v int").collect())


def test_ledger_repeats_and_crashes(spark, monkeypatch):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    assert held(ledger) == [] and ledger.append({"rows": rows(spark, [1, 2])}, "w", 1)
    assert not ledger.append({"rows": rows(spark, [3])}, "w", 1)
    publish = Ledger.publish
    monkeypatch.setattr(Ledger, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        ledger.append({"rows": rows(spark, [4])}, "w", 2)
    monkeypatch.setattr(Ledger, "publish", publish)
    assert held(ledger) == [1, 2]
    assert ledger.append({"rows": rows(spark, [4])}, "w", 2) and held(ledger) == [1, 2, 4]
    with pytest.raises(Conflict):
        ledger.append({"rows": rows(spark, [5])}, "x", 1, made_for=1)
    assert held(Ledger(spark, ledger.root)) == [1, 2, 4]


def test_ledger_loses_no_race(spark, monkeypatch):
    # Another job takes the version between looking and publishing.
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    publish, raced = Ledger.publish, []

    def late(self, commit):
        if not raced:
            raced.append(1)
            Ledger(spark, self.root).append({"rows": rows(spark, [7])}, "other", 1)
        return publish(self, commit)

    monkeypatch.setattr(Ledger, "publish", late)
    assert ledger.append({"rows": rows(spark, [8])}, "w", 1)
    assert held(ledger) == [7, 8] and ledger.version() == 2


def test_snapshots_apply_one_after_the_other(spark, monkeypatch):
    table = Snapshots(spark, scratch_path(spark, "table"), "k int, n int", keep=2)

    def add(k):
        return lambda now: {"rows": now.unionByName(spark.createDataFrame([(k, 1)], "k int, n int")).groupBy("k").agg(F.sum("n").cast("int").alias("n"))}

    publish, raced = Snapshots.publish, []

    def late(self, commit):
        if not raced:
            raced.append(1)
            Snapshots(spark, self.root, "k int, n int").merge(add(1), "other", 1)
        return publish(self, commit)

    monkeypatch.setattr(Snapshots, "publish", late)
    table.merge(add(1), "w", 1)
    table.merge(add(2), "w", 2)
    table.merge(add(2), "w", 2)
    assert {r["k"]: r["n"] for r in table.current().collect()} == {1: 2, 2: 1}
    for batch in range(3, 7):
        table.merge(add(3), "w", batch)
    assert {r["k"]: r["n"] for r in table.current().collect()} == {1: 2, 2: 1, 3: 4}


def uuid7(n):
    return f"018d0000-0000-7000-8000-{n:012d}"


def delivery(number, source="s", first=1, last=2, ident=None, root=b"r" * 32, size=None, frames=None, claimed=None):
    import base64

    note = f"log/{source}\n{last if size is None else size}\n{base64.b64encode(root).decode()}\n\n— signer AAAA\n"
    seqs = range(first, last + 1) if frames is None else frames
    made = [(number, i, bytearray(f if isinstance(f, bytes) else f'{{"v":2,"source_id":"{source}","seq":{f}}}'.encode())) for i, f in enumerate(seqs)]
    made = [(*m, hashlib.sha256(bytes(m[2])).hexdigest() if claimed is None else claimed) for m in made]
    return (number, uuid7(number) if ident is None else ident, source, first, last, bytearray(root), note), made


def batch_of(spark, *deliveries):
    segments = spark.createDataFrame([d for d, _ in deliveries], "delivery bigint, " + ingest.SEGMENT_ROWS)
    frames = spark.createDataFrame([f for _, fs in deliveries for f in fs], "delivery bigint, position bigint, record_bytes binary, claimed_hash string")
    return segments, frames


def statuses(receipts):
    return {r["delivery"]: r["status"] for r in receipts.collect()}


def test_every_delivery_gets_its_status(spark):
    ledger = Ledger(spark, scratch_path(spark, "intake"))
    given = batch_of(
        spark, delivery(1), delivery(2, ident="../x"), delivery(3, source=""), delivery(4, first=5, last=2), delivery(5, root=b"short"), delivery(6, size=9),
        delivery(7, first=3, last=4, claimed="00"), delivery(8, first=3, last=4, claimed="0" * 64), delivery(9, first=3, last=4, frames=[b"", 4]),
        delivery(10, first=3, last=4, frames=[b"{not json", 4]), delivery(11, first=3, last=4, frames=[b'{"v":2,"source_id":"t","seq":3}', 4]),
        delivery(12, first=3, last=4, frames=[4, 3]), delivery(13, first=3, last=4, frames=[3]), delivery(14, first=3, last=4, frames=[]),
        delivery(15, first=3, last=4, frames=[3, 4, 5, 6, 7]), delivery(16), delivery(17, source="q", first=1, last=2, ident=uuid7(1)), delivery(18, source="q", frames=[b"no", 2], first=1, last=2),
        delivery(19, source="q", first=1, last=2), delivery(20, source="q", first=1, last=2, frames=[]))
    expected = {1: "accepted", 2: "bad_segment_id", 3: "missing_source_id", 4: "bad_range", 5: "bad_root_length", 6: "size_mismatch", 7: "digest_length", 8: "hash_mismatch",
                9: "frame_length", 10: "bad_record", 11: "other_source", 12: "out_of_order", 13: "short_range", 14: "short_range", 15: "too_many_frames", 16: "duplicate",
                17: "id_taken", 18: "bad_record", 19: "accepted", 20: "duplicate"}
    assert statuses(ingest.ingest(ledger, *given, "w", 1, max_frames=4)) == expected
    # Once more: the receipts are read back, nothing is judged or stored again.
    assert statuses(ingest.ingest(ledger, *given, "w", 1, max_frames=4)) == expected
    # The same deliveries as a new batch: what was accepted is there already.
    again = expected | {1: "duplicate", 19: "duplicate", 17: "duplicate", 18: "duplicate"}
    assert statuses(ingest.ingest(ledger, *given, "w", 2, max_frames=4)) == again
    stored = ledger.read("segments", ingest.SEGMENT_ROWS).collect()
    assert sorted(r["segment_id"] for r in stored) == [uuid7(1), uuid7(19)]
    assert sorted((r["source_id"], r["seq"]) for r in ledger.read("frames", ingest.FRAME_ROWS).collect()) == [("q", 1), ("q", 2), ("s", 1), ("s", 2)]


def test_bytes_are_capped_with_their_segment(spark):
    given = batch_of(spark, delivery(1, last=3), delivery(2, last=1, source="t"))
    one = len('{"v":2,"source_id":"s","seq":1}')
    assert statuses(ingest.judge_deliveries(*given, spark.createDataFrame([], ingest.SEGMENT_ROWS), max_bytes=2 * one)) == {1: "too_many_bytes", 2: "accepted"}


def test_winners_follow_the_order_of_arrival(spark):
    # Keys and ids that cross: 1 takes key a and id x, so 2 (a, y) is a duplicate, 3 (b, x) finds its id taken, and 4 (b, y) is accepted.
    given = batch_of(spark, delivery(1, ident=uuid7(1)), delivery(2, ident=uuid7(2)), delivery(3, source="b", ident=uuid7(1)), delivery(4, source="b", ident=uuid7(2)))
    assert statuses(ingest.judge_deliveries(*given, spark.createDataFrame([], ingest.SEGMENT_ROWS))) == {1: "accepted", 2: "duplicate", 3: "id_taken", 4: "accepted"}


def test_killed_intake_stores_once(spark, monkeypatch):
    ledger = Ledger(spark, scratch_path(spark, "intake"))
    given = batch_of(spark, delivery(1), delivery(2, first=3, last=4))
    publish = Ledger.publish
    monkeypatch.setattr(Ledger, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        ingest.ingest(ledger, *given, "w", 1)
    monkeypatch.setattr(Ledger, "publish", publish)
    for _ in range(2):
        ingest.ingest(ledger, *given, "w", 1)
    assert ledger.read("segments", ingest.SEGMENT_ROWS).count() == 2 and ledger.read("frames", ingest.FRAME_ROWS).count() == 4


def test_intake_by_stream(spark):
    path, home = scratch_path(spark, "inbox"), scratch_path(spark, "intake")
    schema = "delivery bigint, " + ingest.SEGMENT_ROWS + ", frames array<struct<record_bytes: binary, claimed_hash: string>>"
    ledger = Ledger(spark, f"{home}/ledger")
    for some in ([delivery(1), delivery(2, first=3, last=4)], [delivery(3), delivery(4, first=5, last=6)]):
        spark.createDataFrame([(*d, [(r, h) for _, _, r, h in fs]) for d, fs in some], schema).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        for _ in range(2):
            ingest.ingest_stream(stream, ledger, "live").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert statuses(ledger.read("receipts", ingest.RECEIPT_ROWS)) == {1: "accepted", 2: "accepted", 3: "duplicate", 4: "accepted"}


def leaf(i):
    return hashlib.sha256(str(i).encode()).digest()


def leaves(spark, source, lo, hi):
    return spark.range(lo, hi).select(F.lit(source).alias("source_id"), F.col("id").alias("idx"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))


def test_tiles_grow_and_full_ones_stay(spark):
    log = TileLog(spark, scratch_path(spark, "tiles"))
    cuts = [0, 5, TILE - 1, TILE + 3, 2 * TILE, 2 * TILE + 9]
    for batch, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        assert log.grow(leaves(spark, "s", lo, hi), "w", batch)
    assert not log.grow(leaves(spark, "s", 0, 5), "w", 0)
    asked = spark.createDataFrame([("s", n) for n in (0, 1, 5, TILE - 1, TILE, TILE + 3, 2 * TILE, 2 * TILE + 9, 2 * TILE + 10)], "source_id string, size bigint")
    hashes = [leaf(i) for i in range(cuts[-1])]
    got = {r["size"]: bytes(r["root"]) for r in prefix_roots(log.tiles(), asked).collect()}
    assert got == {r["size"]: root_of(hashes[:r["size"]]) for r in asked.collect() if r["size"] <= len(hashes)}
    # The last batch writes the last tile only, not those that were full.
    last = log.ledger.read("tiles", "round int, tile bigint, n int", log.ledger.commits()[-1])
    assert {(r["round"], r["tile"], r["n"]) for r in last.collect()} == {(0, 2, 9)}
    for bad in (leaves(spark, "s", cuts[-1] + 1, cuts[-1] + 2), leaves(spark, "s", 0, 3), leaves(spark, "new", 1, 2)):
        with pytest.raises(ValueError):
            log.grow(bad, "w", 99)
    assert build_tiles(leaves(spark, "s", 0, 0)).count() == 0


def test_bundles_of_many_sources(spark):
    texts = {s: [f'{{"source_id":"{s}","seq":{i},"prev_hash":"x","pad":"{"p" * (i % 50)}"}}' for i in range(1, n + 1)] for s, n in (("a/b c+%", 40), ("007", 3), ("é", 1))}
    table = [(s, i, "", None, hashlib.sha256(x.encode()).hexdigest(), bytearray(x.encode())) for s, xs in texts.items() for i, x in enumerate(xs, 1)]
    records = spark.createDataFrame(table, "source_id string, seq bigint, actor string, time_ns bigint, record_hash string, record_bytes binary").repartition(3)
    path = scratch_path(spark, "bundles")
    export.write_bundles(records, export.RecordFilter(), path, file_bytes=300)
    found = export.digests(spark, path).collect()
    assert {r["source_id"] for r in found} == set(texts) and sum(r["source_id"] == "a/b c+%" for r in found) > 5
    # Hashes of files as they are, and streamed line by line, are those of their bytes.
    for whole in (1 << 30, 0):
        got = {r["file"]: r["sha256"] for r in export.digests(spark, path, whole).collect()}
        for name, digest in got.items():
            with open(f"{path.removeprefix('file:')}/{name}".replace("//", "/"), "rb") as f:
                assert hashlib.sha256(f.read()).hexdigest() == digest, name
        assert len(got) == len(found)
    lines = export.source_lines(spark, f"{path}/records", True).collect()
    assert {s: [r["value"] for r in sorted((r for r in lines if r["source_id"] == s), key=lambda r: r["ordinal"])] for s in texts} == texts
    checks = {(r["source_id"], r["label"]): r["status"] for r in bundles.verify_bundles(spark, path).collect()}
    assert all(checks[s, "file integrity"] == checks[s, "record integrity"] == "pass" for s in texts)
    # A byte changed in one file is seen in its own source alone.
    name = next(r["file"] for r in found if r["source_id"] == "007" and r["file"].startswith("records/"))
    with open(f"{path}/{name}", "r+b") as f:
        f.write(b"[")
    (lambda crc: __import__("os").path.exists(crc) and __import__("os").unlink(crc))(f"{path}/{name.rsplit('/', 1)[0]}/.{name.rsplit('/', 1)[1]}.crc")
    checks = {(r["source_id"], r["label"]): r["status"] for r in bundles.verify_bundles(spark, path).collect()}
    assert checks["007", "file integrity"] == "fail" and checks["é", "file integrity"] == checks["a/b c+%", "file integrity"] == "pass"


def test_heads_over_runs(spark):
    heads = Heads(spark, scratch_path(spark, "heads"))

    def run(batch, *submitted):
        df = spark.createDataFrame([("o", p, s, bytearray(r)) for p, s, r in submitted], "origin string, pos bigint, size bigint, root binary")
        return {r["pos"]: r["status"] for r in heads.accept(df, "w", batch).collect()}

    assert run(1, (1, 5, b"a"), (2, 9, b"b")) == {1: "accepted", 2: "accepted"}
    second = {3: "repeated", 4: "different root at same tree size", 5: "tree size decreased", 6: "accepted", 7: "tree size decreased"}
    assert run(2, (3, 9, b"b"), (4, 9, b"x"), (5, 5, b"a"), (6, 10, b"c"), (7, 9, b"b")) == second
    assert run(2, (9, 99, b"never looked at")) == second
    assert [(r["size"], bytes(r["root"]), r["pos"]) for r in heads.current().collect()] == [(10, b"c", 6)]


def test_salts_are_minted_once_and_erased_for_good(spark, monkeypatch):
    salts = Salts(spark, scratch_path(spark, "salts"))
    events = spark.createDataFrame([("x",), ("y",), ("x",), ("",), (None,)], "actor string")
    publish = Snapshots.publish
    monkeypatch.setattr(Snapshots, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        salts.mint(events, "now", "w", 1)
    monkeypatch.setattr(Snapshots, "publish", publish)
    first = {r["actor"]: bytes(r["salt"]) for r in salts.mint(events, "now", "w", 1).collect()}
    assert set(first) == {"x", "y"} and len(set(first.values())) == 2
    more = {r["actor"]: bytes(r["salt"]) for r in salts.mint(events.union(spark.createDataFrame([("z",)], "actor string")), "later", "w", 2).collect()}
    assert {k: more[k] for k in first} == first and set(more) == {"x", "y", "z"}
    assert {r["actor"] for r in salts.erase(spark.createDataFrame([("x",)], "actor string"), "w", 3).collect()} == {"y", "z"}


def test_one_pass_equals_the_checks_by_themselves(spark, tables):
    from tidemark.catalog.verifying import evidence
    from tidemark.operators import captured as cap, continuity as con, retention as ret
    from tidemark.sources.store import materialise

    e = evidence(tables)
    frames = materialise(e.frames, "frames")
    covered = ret.tombstone_ranges(e.tombstones)
    done = passes.one_pass(frames, width=3)
    parsed = chain.parsed_frames(frames).select("source_id", "ordinal", "claimed_hash", "record_hash", "parse_error", F.col("record.seq").alias("seq"), F.col("record.prev_hash").alias("prev_hash"))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(passes.link_errors(done, covered)) == key(chain.link_errors(parsed, covered))
    records = cap.records_of(frames)
    assert key(passes.transport(done)) == key(con.transport_summary(records))
    assert key(passes.clean_stops(done)) == key(con.clean_stops(records))
    names = ["source_id", "records", "seq_first", "seq_last", "first_ns", "last_ns", "encrypted", "key_id"]
    whole = frames.join(done.sources.where("unparsed_at is null").select("source_id"), "source_id", "left_semi")
    assert key(done.sources.where("unparsed_at is null").select(*names)) == key(cap.captured_spans(cap.records_of(whole)).select(*names))


def test_spans_of_a_hot_key(spark):
    import random

    rng = random.Random(3)
    times = {"hot": sorted(rng.sample(range(10**6), 3000)), "one": [5], "flat": list(range(0, 1000, 10))}
    points = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "source_id string, t bigint").repartition(7)
    found = spans_between(points, ["source_id"], "t", 900).collect()
    for k, ts in times.items():
        gaps = [(a, b, b - a, i + 1) for i, (a, b) in enumerate(zip(ts, ts[1:]))]
        got = {(r["start"], r["stop"], r["gap"], r["before"]) for r in found if r["source_id"] == k and r["start"] is not None}
        assert {g for g in gaps if g[2] > 900} <= got <= set(gaps)
        assert not gaps or max(g[2] for g in got) == max(g[2] for g in gaps)
