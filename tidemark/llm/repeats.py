"""Substring deduplication: repeated passages found by Aho-Corasick automata over words.

A window is ``width`` consecutive words of one document; it is removable where the same words also start in a document of
a smaller id. The work is done in passes over all documents, none of which holds more than a slice of them:

1. Documents with the same words are one document: of such copies all but the first lose every word.
2. Every window has an anchor, the least hash of its ``gram``-word grams, so equal windows have equal anchors. Anchors that
   occur in two documents or more are kept as a bitmap filter.
3. Windows whose anchor passes the filter are counted exactly: hash, first and last document. Those with two documents are
   the confirmed recurring windows, and the first document owns them.
4. Owned windows are cut out of their owners as passages, maximal runs of words.
5. Documents that have something to lose are dealt into blocks. Each block gets the passages of the owners its documents
   share windows with, compiles them into automata over word numbers (one for every ``shard`` phrases), and streams its
   documents through them. Every occurrence in a document of a larger id than the owner's covers its words.

Filters are bitmaps of at most ``max_blocks`` x 4 KiB; a filter that fills up lets more rows through to the exact counts or
more passages to the automata, which decide by words. Hot windows are counted with partial aggregates and joined on
shuffles that can be split.

Cases: null and empty texts have no words; texts below ``width`` words lose nothing; a null id is never compared and loses
nothing; rows that repeat an id are one document and never cover each other; an empty table gives an empty result. Ids are
integers; further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, stored_small, text_of, text_slices, without_ids
from tidemark.llm.exact import BLOCK_BITS
from tidemark.sources.store import materialise

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    width: int = 13
    gram: int = 4
    shard: int = 60_000  # tiles of one automaton
    block_words: int = 250_000
    bits_per_entry: int = 16
    max_blocks: int = 16384


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _MIX + h[i:len(h) - size + 1 + i]
    return _mixed(out)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _anchors(h: np.ndarray, rules: Rules) -> np.ndarray:
    """The anchor of each window."""
    grams = _grams(h, rules.gram)
    n = len(h) - rules.width + 1
    low = grams[:n]
    for i in range(1, rules.width - rules.gram + 1):
        low = np.minimum(low, grams[i:n + i])
    return low


class Bitmap:
    """A filter over 64-bit hashes, built by Spark and read by numpy."""

    def __init__(self, rows: list, blocks: int):
        self.blocks = blocks
        self.bits = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
        for r in rows:
            self.bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)

    def test(self, h: np.ndarray) -> np.ndarray:
        block = ((h >> np.uint64(33)) % np.uint64(self.blocks)).astype(np.int64)
        out = np.ones(len(h), bool)
        for shift in (0, 15):
            pos = ((h >> np.uint64(shift)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
            out &= (self.bits[block, pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1
        return out


def bitmap_of(hashes: DataFrame, rules: Rules) -> Bitmap:
    """At most max_blocks rows of 4 KiB come to the driver."""
    blocks = max(1, min(rules.max_blocks, -(-hashes.count() * rules.bits_per_entry // BLOCK_BITS)))
    h = F.col("hash")
    spots = hashes.select(F.pmod(F.shiftrightunsigned(h, 33), F.lit(blocks)).cast("int").alias("block"), F.explode(F.array(
        h.bitwiseAND(F.lit(BLOCK_BITS - 1)), F.shiftright(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)))).alias("pos"))
    return Bitmap(spots.groupBy("block").agg(F.bitmap_construct_agg(F.col("pos").cast("bigint")).alias("bits")).collect(), blocks)


def _over_words(docs: DataFrame, schema: str, rules: Rules, work) -> DataFrame:
    """work(id, words, hashes) of every document of at least a window; it gives a tuple of columns for that document."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, 1):
                made = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = text.encode().split() if text else []
                    if len(words) >= rules.width:
                        made.append(work(doc, words, _hashes(words)))
                if made:
                    columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else [v for part in c for v in part] for c in zip(*made, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c if isinstance(c, list) else c.astype(np.int64, copy=False)) for c in columns], names=names)

    return docs.mapInArrow(run, schema)


def anchor_table(docs: DataFrame, rules: Rules) -> DataFrame:
    def work(doc, words, h):
        found = np.unique(_anchors(h, rules)).view(np.int64)
        return found, np.full(len(found), doc)

    return _over_words(docs, "hash bigint, id bigint", rules, work)


def window_table(docs: DataFrame, anchors: Bitmap, rules: Rules) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(anchors)

    def work(doc, words, h):
        found = np.unique(_grams(h, rules.width)[shared.value.test(_anchors(h, rules))]).view(np.int64)
        return found, np.full(len(found), doc)

    return _over_words(docs, "hash bigint, id bigint", rules, work)


def _owned(window: np.ndarray, doc: int) -> np.ndarray:
    return _mixed(window ^ _mixed(np.full(1, doc, np.int64).view(np.uint64)))


def passage_table(docs: DataFrame, owned: Bitmap, rules: Rules) -> DataFrame:
    """owner, words: maximal runs of words that owned windows cover."""
    shared = docs.sparkSession.sparkContext.broadcast(owned)

    def work(doc, words, h):
        window = _grams(h, rules.width)
        first = np.unique(window, return_index=True)[1]  # a window that a document repeats is needed once
        at = np.sort(first[shared.value.test(_owned(window[first], doc))])
        runs = [b" ".join(words[lo:hi]) for lo, hi in _runs(at, rules.width)]
        return np.full(len(runs), doc), runs

    return _over_words(docs, "owner bigint, words binary", rules, work)


def owner_hashes(windows: DataFrame) -> DataFrame:
    """hash of (window, owner), as _owned gives it."""

    def run(batches):
        for batch in batches:
            window = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mixed(window ^ _mixed(batch.column(1).to_numpy().view(np.uint64))).view(np.int64))], names=["hash"])

    return windows.select("hash", "first").mapInArrow(run, "hash bigint")


def _runs(at: np.ndarray, width: int):
    """(start, end) in words of the maximal runs that windows at these positions cover."""
    if not len(at):
        return
    breaks = np.flatnonzero(np.diff(at) > width) + 1
    for part in np.split(at, breaks):
        yield int(part[0]), int(part[-1]) + width


class Automata:
    """The windows of passages, as automata over word numbers that locate and a table that confirms.

    A passage is cut into tiles of (width + 1) / 2 words. Every window of the passage holds a whole tile, so the automata
    need the tiles alone, ``shard`` of them in each; places around a tile are confirmed word by word in the table of windows.
    """

    def __init__(self, passages: list[tuple[int, bytes]], rules: Rules):
        self.width, self.tile = rules.width, (rules.width + 1) // 2
        self.number: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], int] = {}
        tiles: dict[tuple[int, ...], None] = {}
        for owner, text in passages:
            ids = tuple([self.number.setdefault(w, len(self.number) + 1) for w in text.split(b" ")])
            for i in range(len(ids) - self.width + 1):
                key = ids[i:i + self.width]
                if self.owners.get(key, owner) >= owner:
                    self.owners[key] = owner
            for i in range(0, len(ids) - self.tile + 1, self.tile):
                tiles[ids[i:i + self.tile]] = None
        self.shards = []
        keys = list(tiles)
        for start in range(0, len(keys), rules.shard):
            shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
            for key in keys[start:start + rules.shard]:
                shard.add_word(key)
            shard.make_automaton()
            self.shards.append(shard)

    def covered(self, doc: int, words: list[bytes]) -> np.ndarray:
        """Which words a window of a smaller owner covers."""
        n = len(words)
        ids = tuple(map(self.number.get, words, repeat(0)))
        near = np.zeros(n + 1, np.int64)
        for shard in self.shards:
            ends = np.array([end for end, _ in shard.iter(ids)], np.int64)
            np.add.at(near, np.maximum(ends + 1 - self.width, 0), 1)  # the first window that holds the tile
            np.add.at(near, ends + 2 - self.tile, -1)
        step = np.zeros(n + 1, np.int64)
        for i in np.flatnonzero(np.cumsum(near[:n])[:max(0, n - self.width + 1)] > 0).tolist():
            if self.owners.get(ids[i:i + self.width], doc) < doc:
                step[i] += 1
                step[i + self.width] -= 1
        return np.cumsum(step[:n]) > 0


def locate(docs: DataFrame, routed: DataFrame, rules: Rules) -> DataFrame:
    """id, n_words, spans (start, end in words), kept of documents (block, id, text); ``routed``: block, owner, words."""

    def run(batches):
        block, passages, automata = None, [], None
        for whole in batches:
            for batch in text_slices(whole, 2, 2 << 20):
                out = []
                for here, of, text, is_doc in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if here != block:
                        block, passages, automata = here, [], None
                    if not is_doc:
                        passages.append((of, text))
                        continue
                    if automata is None:
                        automata, passages = Automata(passages, rules), []
                    words = text.split()
                    gone = automata.covered(of, words)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    out.append((of, len(words), [{"start": s, "end": e} for s, e in edges], kept.decode()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                         pa.array([o[2] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([o[3] for o in out])],
                        names=["id", "n_words", "spans", "kept"])

    rows = routed.select("block", F.col("owner").alias("of"), "words", F.lit(False).alias("is_doc")).unionByName(
        docs.select("block", F.col("id").alias("of"), F.col("text").cast("binary").alias("words"), F.lit(True).alias("is_doc")))
    dealt = rows.repartition("block").sortWithinPartitions("block", "is_doc")
    return dealt.mapInArrow(run, "id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """id, n_words, n_removed, spans (removed, in words), kept (the words that stay, joined by spaces): one row per row."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.trim(F.regexp_replace(text_of(text_col), SPACE, " ")).alias("words"))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " "))).cast("bigint")
    base = materialise(plain.select("id", n_words.alias("n_words"), F.sha2("words", 256).alias("words_sha")), "repeat-base")
    firsts = base.where("id is not null").groupBy("words_sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    firsts = materialise(firsts.select("words_sha", "first"), "repeat-firsts")
    base = materialise(base.join(firsts, "words_sha", "left").select("id", "n_words", "words_sha", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy")), "repeat-copies")
    copies = materialise(base.where("id is not null").groupBy("id").agg(F.min("copy").alias("copy")).where("copy").select("id"), "repeat-copy-ids")
    texts = without_ids(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null"),
                        copies, "id", "repeat-copies")

    anchors = anchor_table(texts, rules).groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    anchors = bitmap_of(materialise(anchors.select("hash"), "repeat-anchors"), rules)
    windows = materialise(window_table(texts, anchors, rules), "repeat-windows")
    recurring = windows.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    recurring = materialise(recurring.select("hash", "first"), "repeat-recurring")
    passages = materialise(passage_table(texts, bitmap_of(owner_hashes(recurring), rules), rules), "repeat-passages")

    blocks = max(1, -(-int(base.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]) // rules.block_words))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = materialise(windows.join(recurring, "hash").where("id > first").select("id", "first").distinct(), "repeat-met")
    routed = met.select(block.alias("block"), F.col("first").alias("owner")).distinct().join(passages, "owner")
    losing = met.select("id").distinct()
    kinds = stored_small(losing.select("id", F.lit(False).alias("copy")).unionByName(copies.select("id", F.lit(True).alias("copy"))), "repeat-kinds", 1_000_000)
    chosen = texts.join(kinds.where("not copy").select(F.col("id").alias("losing")), F.col("id") == F.col("losing"), "left_semi")
    found = locate(chosen.withColumn("block", block), routed, rules)

    # Everything else keeps its words, or as a copy loses them all, without a shuffle of texts while the ids are few.
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    lost_all = F.col("copy").isNotNull() & (F.col("n_words") >= rules.width)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))
    others = plain.withColumn("n_words", n_words).join(kinds, "id", "left").where("copy is null or copy").select(
        "id", "n_words", F.when(lost_all, whole).otherwise(nothing).alias("spans"), F.when(lost_all, F.lit("")).otherwise(F.col("words")).alias("kept"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    return found.unionByName(others).select(F.col("id").alias(id_col), "n_words", removed.alias("n_removed"), "spans", "kept")
