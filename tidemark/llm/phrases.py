"""Phrase collocations: multikey three-way quicksort of suffix pointers, cut at ``LONGEST`` words.

1. Words are counted per language. A task counts the words of a chunk, counts meet by ranges of word numbers, and words
   below ``least`` occurrences are abandoned: no phrase that holds one can be frequent.
2. Every position whose first two words are left is a suffix pointer: its next words up to the end of the piece or the
   first abandoned word. Pointers with equal words become one with a weight inside a chunk, and are routed globally by
   their two leading words. Where both are hot (over ``hot`` occurrences) the third word routes too, so that no bucket
   holds all of a hot pair; the counts of such pairs are summed afterwards.
3. A bucket is sorted by a multikey three-way quicksort: pointers less than, equal to and greater than a pivot word; the
   equal part goes on with the next word. The weight of an equal part is the count of its phrase, and parts below
   ``least`` are abandoned. Parts of at most ``small`` pointers are finished by one sort over the words that remain.
4. Scores are joins of the counts of a phrase and its parts, in exact decimals; the first rows of a language are taken in
   two steps, so that no task ranks all phrases of a hot language.

A word's number is a 64-bit hash seeded by its language. The dictionary step sees every word that is left with its number:
if two words or languages ever share one, the whole count is done again with other seeds, so the result is exact.
Broadcast are the words left, if they are at most ``most_known`` (16 MB; else nothing is abandoned before the routing),
and hot words, which are at most as many by the choice of ``hot``.

Cases: null and empty texts have no words; a null language is ``und``; repeated rows and ids count as often as they come;
very long texts are cut into chunks that overlap by ``LONGEST`` - 1 words; an empty table has no phrases; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.sources.store import materialise

LONGEST = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = bytes(ord("\n") if c in b".,;:!?\n\x0b\x0c\r" else ord(" ") if c == 9 else c for c in range(256))
_COUNT = np.dtype([("id", "<u8"), ("n", "<i8")])
_WORDS = ("w0", "w1", "w2")


def _pointer(ranked: bool) -> np.dtype:
    """Words as ranks among the known ones (from 1) or as their numbers; 0 is no word."""
    return np.dtype([(w, "<u4" if ranked else "<u8") for w in _WORDS] + [("n", "<i4" if ranked else "<i8")])


@dataclass(frozen=True)
class Rules:
    least: int = 10
    cover: int = 50  # percent of a phrase's occurrences inside one longer phrase that drop it
    first: int = 2000
    chunk_words: int = 1_000_000
    bucket_bytes: int = 8 << 20  # of text, for one bucket
    most_known: int = 2_000_000
    hot: int = 1_000_000
    small: int = 65_536


def _numbers(text: str, seed: int) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words of a text with 0 between pieces, and the words."""
    parts = text.encode().lower().translate(_SPLIT).replace(b"\n", b" \n ").split(b" ")
    words = [w for w in parts if w]
    ids = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) or 1 for w in words), np.uint64, len(words))
    ids[np.fromiter((w == b"\n" for w in words), bool, len(words))] = 0
    return ids, words


def _chunks(batches, salt: int, most: int):
    """(lang of each word, numbers, words) over the rows of all batches, of at most about ``most`` words.

    Rows are set apart by a 0. Where a text goes on in the next chunk, its last words are given again before the new ones,
    in front of which stands the number of words already seen.
    """
    langs: list[tuple[str, int]] = []
    ids, words, held = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seed = xxhash.xxh3_64_intdigest(lang.encode(), salt)
            numbers, own = _numbers(text.as_py(), seed)
            for start in range(0, len(own), most):
                lo, hi = max(0, start - LONGEST + 1), start + most
                ids += [numbers[lo:hi], np.zeros(1, np.uint64)]
                words += [*own[lo:hi], b"\n"]
                seen = start - lo
                langs.append((lang, len(own[lo:hi]) + 1, seen))
                held += langs[-1][1]
                if held >= most:
                    yield langs, np.concatenate(ids), words
                    langs, ids, words, held = [], [], [], 0
    if held:
        yield langs, np.concatenate(ids), words


def _fresh(langs, n: int) -> np.ndarray:
    """Positions that no earlier chunk has had."""
    new, at = np.ones(n, bool), 0
    for _, size, seen in langs:
        new[at:at + seen] = False
        at += size
    return new


def _dealt(rows: np.ndarray, bucket: np.ndarray):
    """(bucket, bytes of its rows)."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part, b in zip(np.split(rows, cuts), bucket[np.concatenate([[0], cuts])] if len(bucket) else [], strict=False):
        yield int(b), b"".join(np.ascontiguousarray(part[f]).tobytes() for f in rows.dtype.names)  # by columns: they compress


def _rows(blob, kind: np.dtype) -> np.ndarray:
    out, at = np.zeros(len(blob) // kind.itemsize, kind), 0
    for f in kind.names:
        out[f] = np.frombuffer(blob, kind[f], len(out), at)
        at += out[f].nbytes
    return out


def _by_bucket(batches, kind: np.dtype):
    """All rows of a bucket, over batches sorted by bucket."""
    at, parts = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not blob.is_valid:
                continue
            if b != at and parts:
                yield np.concatenate(parts)
                parts = []
            at = b
            parts.append(_rows(blob.as_buffer(), kind))
    if parts:
        yield np.concatenate(parts)


def _gathered(dealt: DataFrame, buckets: int) -> DataFrame:
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def count_words(texts: DataFrame, salt: int, buckets: int, rules: Rules) -> DataFrame:
    """id, n of the words with ``least`` occurrences in their language."""

    def local(batches):
        for langs, ids, _ in _chunks(batches, salt, rules.chunk_words):
            ids = ids[_fresh(langs, len(ids)) & (ids > 0)]
            found = np.zeros(len(np.unique(ids)), _COUNT)
            found["id"], found["n"] = np.unique(ids, return_counts=True)
            out = list(_dealt(found, (found["id"] >> np.uint64(32)) % np.uint64(buckets)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "rows"])

    def whole(batches):
        for rows in _by_bucket(batches, _COUNT):
            ids, at = np.unique(rows["id"], return_inverse=True)
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, at, rows["n"])
            keep = n >= rules.least
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep].view(np.int64)), pa.array(n[keep])], names=["id", "n"])

    return _gathered(texts.mapInArrow(local, "bucket bigint, rows binary"), buckets).mapInArrow(whole, "id bigint, n bigint")


def _sorted_ids(ids: DataFrame) -> np.ndarray:
    return np.sort(ids.toPandas()["id"].to_numpy(np.int64).view(np.uint64))


def _among(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(ids), bool)
    return known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids


def pointers(texts: DataFrame, salt: int, buckets: int, known, hot, rules: Rules) -> DataFrame:
    """Two kinds of rows: suffix pointers (bucket, rows), and words (bucket, id, lang, word) of the numbers left."""
    names = ["bucket", "rows", "id", "lang", "word"]
    kind = _pointer(known is not None)

    def run(batches):
        for langs, ids, words in _chunks(batches, salt, rules.chunk_words):
            left = ids > 0
            if known is not None:
                left &= _among(ids, known.value)
            ids = np.where(left, ids, np.uint64(0))
            kept = np.flatnonzero(left)
            one, first = np.unique(ids[kept], return_index=True)
            places = kept[first]
            ends = np.cumsum([size for _, size, _ in langs])
            spoken = np.searchsorted(ends, places, side="right").tolist()
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(((one >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)), pa.nulls(len(one), pa.binary()), pa.array(one.view(np.int64)), pa.array([langs[i][0] for i in spoken], pa.string()),
                                                  pa.array([words[i].decode() for i in places.tolist()], pa.string())], names=names)
            at = np.flatnonzero(left[:-1] & left[1:])
            # A pair whose second word was the last one seen has been counted before; the same for three words.
            new = _fresh(langs, len(ids))
            if known is not None:
                ids = np.where(left, np.searchsorted(known.value, ids).astype(np.uint32) + np.uint32(1), np.uint32(0)).astype(np.uint32)
            ids = np.append(ids, ids.dtype.type(0))
            new = np.append(new, True)
            at = at[new[at + 1] | new[at + 2] & (ids[at + 2] > 0)]
            rows = np.zeros(len(at), kind)
            for i, w in enumerate(_WORDS):
                rows[w] = ids[at + i]
            # Known pairs in front of a new third word count for the three words only: minus one for the pair.
            again = ~new[at + 1]
            rows = _weighed(rows, np.ones(len(at), np.int64))
            if again.any():
                less = np.zeros(int(again.sum()), kind)
                less["w0"], less["w1"] = ids[at[again]], ids[at[again] + 1]
                less["n"] = -1
                rows = np.concatenate([rows, less])
            mixed = (rows["w0"].astype(np.uint64) * _MIX + rows["w1"]) * _MIX
            both = _hot_pairs(rows, known, hot)
            mixed = np.where(both, (mixed + rows["w2"]) * _MIX, mixed)
            out = list(_dealt(rows, (mixed >> np.uint64(32)) % np.uint64(buckets)))
            if out:
                none = pa.nulls(len(out))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary()), none.cast(pa.int64()), none.cast(pa.string()),
                                                  none.cast(pa.string())], names=names)

    return texts.mapInArrow(run, "bucket bigint, rows binary, id bigint, lang string, word string")


def _numbers_of(words: np.ndarray, known) -> np.ndarray:
    """Ranks back to numbers."""
    if known is None:
        return words
    return np.where(words > 0, known.value[np.maximum(words, 1) - 1], np.uint64(0)) if len(known.value) else words.astype(np.uint64)


def _hot_pairs(rows: np.ndarray, known, hot) -> np.ndarray:
    if not len(hot.value):
        return np.zeros(len(rows), bool)
    return _among(_numbers_of(rows["w0"], known), hot.value) & _among(_numbers_of(rows["w1"], known), hot.value)


def _weighed(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Equal pointers as one, with the sum of their weights."""
    order = np.lexsort([rows[w] for w in reversed(_WORDS)])
    rows, weight = rows[order], weight[order]
    starts = np.flatnonzero(np.concatenate([[True], np.any([rows[w][1:] != rows[w][:-1] for w in _WORDS], axis=0)])) if len(rows) else np.zeros(0, int)
    out = rows[starts].copy()
    if len(starts):
        out["n"] = np.add.reduceat(weight, starts)
    return out


def equal_parts(rows: np.ndarray, least: int, small: int):
    """Phrases of two words or more as pointers with their counts: rows of arrays whose unused words are 0.

    A stack holds parts (pointers, depth): pointers that agree in their first ``depth`` words.
    """
    stack = [(np.arange(len(rows)), 0)]
    while stack:
        part, depth = stack.pop()
        if rows["n"][part].sum() < least:
            continue  # abandoned: nothing in it can be frequent
        if len(part) <= small:
            yield from _finish(rows[part], depth, least)
            continue
        word = rows[_WORDS[depth]][part]
        some = word[:: max(1, len(word) // 99)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        stack += [(part[word < pivot], depth), (part[word > pivot], depth)]
        equal = part[word == pivot]
        if depth + 1 < LONGEST:
            if depth and rows["n"][equal].sum() >= least:
                yield _phrase(rows[equal[:1]], depth + 1, rows["n"][equal].sum())
            stack.append((equal, depth + 1))
        elif pivot:
            yield _phrase(rows[equal[:1]], depth + 1, rows["n"][equal].sum())


def _phrase(rows: np.ndarray, words: int, n) -> np.ndarray:
    out = rows.copy()
    for w in _WORDS[words:]:
        out[w] = 0
    out["n"] = n
    return out


def _finish(rows: np.ndarray, depth: int, least: int):
    """All phrases of a part whose pointers agree in ``depth`` words, by one sort over the others."""
    rows = rows[np.lexsort([rows[w] for w in reversed(_WORDS[depth:])])]
    differ = np.zeros(max(0, len(rows) - 1), bool)
    for words in range(depth + 1, LONGEST + 1):
        last = rows[_WORDS[words - 1]]
        differ |= last[1:] != last[:-1]
        starts = np.flatnonzero(np.concatenate([[True], differ]))
        n = np.add.reduceat(rows["n"], starts)
        good = (n >= least) & (last[starts] > 0)
        if words > 1 and good.any():
            yield _phrase(rows[starts[good]], words, n[good])


def phrases(dealt: DataFrame, buckets: int, known, hot, rules: Rules) -> DataFrame:
    """w0, w1, w2 (0 for two words), a: phrases and their counts, to be summed; and the words (id, lang, word) as they came."""
    names = [*_WORDS, "a", "id", "lang", "word"]
    kind = _pointer(known is not None)

    def run(batches):
        spoken = []

        def passing():
            for batch in batches:
                words = batch.filter(pc.is_valid(batch.column("id")))
                if words.num_rows:
                    none = pa.nulls(words.num_rows, pa.int64())
                    spoken.append(pa.RecordBatch.from_arrays([none] * 4 + [words.column(c) for c in ("id", "lang", "word")], names=names))
                yield batch

        for rows in _by_bucket(passing(), kind):
            rows = rows.astype([(w, kind[w]) for w in _WORDS] + [("n", "<i8")])  # sums may pass 32 bits
            rows = _weighed(rows, rows["n"])
            both = _hot_pairs(rows, known, hot)
            # Of a hot pair a bucket has a part of the occurrences: all such parts go on, and are summed.
            for some, least in ((rows[~both], rules.least), (rows[both], 1)):
                for out in equal_parts(some, least, rules.small) if len(some) else ():
                    none = pa.nulls(len(out))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(_numbers_of(out[w], known)).view(np.int64)) for w in _WORDS]
                                                     + [pa.array(np.ascontiguousarray(out["n"])), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.string())], names=names)
            yield from spoken
            spoken.clear()
        yield from spoken

    return _gathered(dealt, buckets).mapInArrow(run, "w0 bigint, w1 bigint, w2 bigint, a bigint, id bigint, lang string, word string")


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = [x.cast("decimal(19,0)") for x in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole[0] * whole[0]).cast("decimal(31,0)"), (whole[1] * whole[2]).cast("decimal(38,0)")).cast("bigint")


def _ranked(rows: DataFrame, first: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", F.row_number().over(some)).where(F.col("place") <= first)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``first`` phrases of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(1, -(-size // rules.bucket_bytes))
    salt = 0
    while True:
        left = materialise(count_words(texts, salt, buckets, rules), "phrase-counts")
        known = spark.sparkContext.broadcast(_sorted_ids(left)) if left.count() <= rules.most_known else None
        hot_from = max(rules.hot, -(-size // rules.most_known))
        hot = spark.sparkContext.broadcast(_sorted_ids(left.where(F.col("n") > hot_from)))
        found = materialise(phrases(pointers(texts, salt, buckets, known, hot, rules), buckets, known, hot, rules), "phrase-parts")
        spoken = found.where("id is not null").groupBy("id").agg(F.min(F.struct("lang", "word")).alias("one"), F.max(F.struct("lang", "word")).alias("other"))
        words = materialise(left.join(spoken, "id").select("id", F.col("n").alias("f"), "one.lang", "one.word", (F.col("one") != F.col("other")).alias("shared")), "phrase-words")
        if words.where("shared").isEmpty():
            break
        salt += 1
    found = materialise(found.where("id is null").groupBy(*_WORDS).agg(F.sum("a").alias("a")).where(F.col("a") >= rules.least), "phrase-found")
    # All occurrences of words per language, rare words too.
    totals = texts.mapInArrow(_totals, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))

    def word(name: str) -> DataFrame:
        return words.select(F.col("id").alias(name), F.col("f").alias(f"f_{name}"), F.col("word").alias(f"s_{name}"), *([F.col("lang")] if name == "w0" else []))

    pairs, triples = found.where("w2 = 0").drop("w2"), found.where("w2 <> 0")
    longer = triples.select(F.explode(F.array(F.struct("w0", "w1"), F.struct(F.col("w1").alias("w0"), F.col("w2").alias("w1")))).alias("p"), "a")
    longer = longer.groupBy("p.w0", "p.w1").agg(F.max("a").alias("longest"))
    lone = pairs.join(longer, ["w0", "w1"], "left").where(f"longest is null or 100 * longest < {rules.cover} * a")
    lone = lone.join(word("w0"), "w0").join(word("w1"), "w1").select(
        "lang", F.concat_ws(" ", "s_w0", "s_w1").alias("phrase"), "a", F.col("f_w0").alias("l"), F.col("f_w1").alias("r"))
    lone = lone.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    head = pairs.select("w0", "w1", F.col("a").alias("f_head"))
    tail = pairs.select(F.col("w0").alias("w1"), F.col("w1").alias("w2"), F.col("a").alias("f_tail"))
    cut = triples.join(head, ["w0", "w1"]).join(tail, ["w1", "w2"]).join(word("w0"), "w0").join(word("w1"), "w1").join(word("w2"), "w2")
    cut = cut.withColumns({"after_one": _score(F.col("a"), F.col("f_w0"), F.col("f_tail")), "after_two": _score(F.col("a"), F.col("f_head"), F.col("f_w2"))})
    one = F.col("after_one") <= F.col("after_two")
    three = cut.select("lang", F.concat_ws(" ", "s_w0", "s_w1", "s_w2").alias("phrase"), "a", F.when(one, F.col("f_w0")).otherwise(F.col("f_head")).alias("l"),
                       F.when(one, F.col("f_tail")).otherwise(F.col("f_w2")).alias("r"), F.least("after_one", "after_two").alias("score"))
    top = _ranked(lone.unionByName(three), rules.first).join(totals, "lang")
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _totals(batches):
    for batch in batches:
        rows = [(lang, len(text.as_py().encode().translate(_SPLIT).split())) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "n"])


QUERY_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
f1 AS (SELECT lang, w[i] AS x, count(*) AS f FROM i GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM i WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM i WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
c AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, p.f AS l, q.f AS r FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND (f3.x = f2.x AND f3.y = f2.y OR f3.y = f2.x AND f3.z = f2.y) AND 100 * f3.f >= 50 * f2.f)
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, p.f, q.f FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, p.f, q.f FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM c),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
