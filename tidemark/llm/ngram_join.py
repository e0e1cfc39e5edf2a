"""Jaccard join of word n-gram sets: prefix filters under several global token orders, intersected before verification.

A document is its set of distinct five-word shingles (tokens). Two sets of a similarity of ``percent`` share a token in
their prefixes, the first n - ceil(percent * n / 100) + 1 tokens, under every global order of tokens. Three orders are used,
all with rare tokens first: by exact frequency, by frequency classes, and by cold before hot. Nothing here is approximate.

1. Tokens of one document only fill prefixes and never match, so a document in which they take the whole prefix links with
   nothing. To find those, tokens are met by ranges of hashes: slices of documents send a token once (and only say "again"
   for one that occurs twice in the slice), and get back per document how many of its tokens occur elsewhere. Most
   documents end here, after six bytes of shuffle a token.
2. Equal sets of the documents left are one class. Frequencies are counted over classes, and classes whose prefix holds no
   shared token under these counts are dropped as well.
3. Cold prefix tokens, of at most ``cold`` classes, give pairs. A pair goes on if it was met under all orders and its sizes
   allow the similarity; it is confirmed on the full sets.
4. Classes whose prefix reaches hot tokens are nearly made of them: large groups of near copies. Pairs are never emitted
   there. Under each order, classes that share prefix tokens directly or through others form a cluster; classes in the same
   cluster under all orders are compared. They are dealt into size classes (only neighbouring ones can be similar) and
   shards, two shards meet in a task, overlaps are counted exactly for all pairs by token, and only a spanning forest of the
   links leaves the task. Where a size class needs several shards, all its members are compared with a few pivots first,
   and only those outside the largest component that this gives are compared with all shards: a group of copies however
   large takes linear work. The largest components of neighbouring size classes are compared as a whole where no link of
   their pivots has joined them.

Broadcast is nothing that grows with the data unless Spark has measured it. A task holds one slice, one range of hashes
(their number follows the size of the texts) or two shards.

Cases: null and empty texts have an empty set and no links; fewer than five words are one shingle; a null id has no
component and links with nothing; rows that repeat an id are one document; very long texts are one slice and, among hot
classes, one shard of their own; ties of an order are broken by token; an empty table gives an empty result. Ids are
integers; further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored_small, text_of, text_slices, trimmed
from tidemark.llm.components import components
from tidemark.llm.sets import compared, shingles
from tidemark.sources.store import materialise

ORDERS = 3
BATCH_BYTES = 8 << 20
_AGAIN = 0xFFFF  # in place of a document: the slice has this token twice or more
_SEEN = np.dtype([("t", "<u4"), ("i", "<u2")])
_DOC = np.dtype([("id", "<i8"), ("n", "<u4"), ("shared", "<u4"), ("known", "?")])
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    percent: int = 80
    cold: int = 16  # classes of a token whose pairs are emitted; a power of 4, so that all orders have cold tokens first
    slice_tokens: int = 500_000
    bucket_bytes: int = 8 << 20  # of text, for one range of hashes
    shard_docs: int = 512
    shard_tokens: int = 500_000
    pivots: int = 16


def _needed(n, percent: int):
    """Tokens that a set of n shares with any similar one."""
    return -(-n * percent // 100)


def _slices(batches, most: int):
    """(id or None, tokens) of documents in lists of about ``most`` tokens and fewer than 2^16 documents."""
    held, size = [], 0
    for whole in batches:
        for batch in text_slices(whole, 1):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((i, shingles(text)))
                size += len(held[-1][1])
                if size >= most or len(held) == _AGAIN - 1:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def shared_counts(texts: DataFrame, rules: Rules) -> DataFrame:
    """id, n, shared: per row its set size and at least how many of its tokens occur in other rows (more where hashes meet)."""
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(1, -(-size // rules.bucket_bytes))

    def send(batches):
        part = TaskContext.get().partitionId()
        for number, docs in enumerate(_slices(batches, rules.slice_tokens)):
            at = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(s) for _, s in docs])
            tokens = np.concatenate([s for _, s in docs])
            order = np.argsort(tokens)
            tokens, at = tokens[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
            times = np.diff(np.append(starts, len(tokens)))
            facts = np.zeros(len(docs), _DOC)
            facts["id"], facts["known"] = [i or 0 for i, _ in docs], [i is not None for i, _ in docs]
            facts["n"] = [len(s) for _, s in docs]
            facts["shared"] = np.bincount(at[np.repeat(times > 1, times)], minlength=len(docs))
            seen = np.zeros(len(starts), _SEEN)
            seen["t"], seen["i"] = tokens[starts].astype(np.uint32), np.where(times > 1, _AGAIN, at[starts])
            bucket = ((tokens[starts] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            seen, bucket = seen[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            which = bucket[np.concatenate([[0], cuts])].tolist() if len(bucket) else []
            blobs = [x.tobytes() for x in np.split(seen, cuts)] if len(bucket) else []
            here = (part << 32) + number
            yield pa.RecordBatch.from_arrays([pa.array([here % buckets, *which], pa.int64()), pa.array([here] * (1 + len(which)), pa.int64()),
                                              pa.array([True] + [False] * len(which)), pa.array([facts.tobytes(), *blobs], pa.binary())], names=["bucket", "slice", "facts", "rows"])

    def meet(batches):
        at, slices, blobs = None, [], []

        def answers():
            t = np.concatenate(blobs)
            lengths = [len(b) for b in blobs]
            order = np.argsort(t["t"], kind="stable")
            word = t["t"][order]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            times = np.diff(np.append(starts, len(word)))
            hit = np.zeros(len(t), bool)
            hit[order] = np.repeat(times > 1, times)
            hit &= t["i"] != _AGAIN
            lo, out = 0, []
            for here, length in zip(slices, lengths, strict=True):
                found = t["i"][lo:lo + length][hit[lo:lo + length]]
                if len(found):
                    out.append((here, found.tobytes()))
                lo += length
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([False] * len(out), pa.bool_()), pa.array([x for _, x in out], pa.binary())], names=["slice", "facts", "rows"])

        for batch in batches:
            facts = batch.column("facts").to_pylist()
            own = [i for i, f in enumerate(facts) if f]
            if own:
                yield batch.take(pa.array(own)).select(["slice", "facts", "rows"])
            for b, here, fact, blob in zip(batch.column("bucket").to_pylist(), batch.column("slice").to_pylist(), facts, batch.column("rows"), strict=True):
                if fact:
                    continue
                if b != at and blobs:
                    yield answers()
                    slices, blobs = [], []
                at = b
                slices.append(here)
                blobs.append(np.frombuffer(blob.as_buffer(), _SEEN))
        if blobs:
            yield answers()

    def add(batches):
        at, facts, shared = None, None, None

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(facts["id"], mask=~facts["known"]), pa.array(facts["n"].astype(np.int64)), pa.array(shared)], names=["id", "n", "shared"])

        for batch in batches:
            for here, fact, blob in zip(batch.column("slice").to_pylist(), batch.column("facts").to_pylist(), batch.column("rows"), strict=True):
                if fact:
                    if facts is not None:
                        yield rows()
                    at, facts = here, np.frombuffer(blob.as_buffer(), _DOC)
                    shared = facts["shared"].astype(np.int64)
                else:
                    assert here == at
                    shared += np.bincount(np.frombuffer(blob.as_buffer(), "<u2"), minlength=len(shared))
        if facts is not None:
            yield rows()

    sent = texts.mapInArrow(trimmed(send), "bucket bigint, slice bigint, facts boolean, rows binary")
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(meet), "slice bigint, facts boolean, rows binary")
    back = materialise(met, "ngram-met").repartition("slice").sortWithinPartitions("slice", F.desc("facts"))
    return back.mapInArrow(trimmed(add), "id bigint, n bigint, shared bigint")


def _sets(texts: DataFrame) -> DataFrame:
    """id, n, digest, tokens (sorted 64-bit hashes)."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, 1):
                sets = [shingles(t) for t in batch.column(1).to_pylist()]
                blobs = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(xxhash.xxh3_128_digest, blobs), pa.binary()),
                                                  pa.array(blobs, pa.binary())], names=["id", "n", "digest", "tokens"])

    return texts.mapInArrow(trimmed(run), "id bigint, n bigint, digest binary, tokens binary")


def _flat(classes: DataFrame) -> DataFrame:
    """k, token."""

    def run(batches):
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(blob.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), k, np.int64)), pa.array(tokens)], names=["k", "token"])

    return classes.select("k", "tokens").mapInArrow(trimmed(run), "k bigint, token bigint")


def prefixes(classes: DataFrame, rules: Rules) -> DataFrame:
    """o, token, k, n, hot, few: the shared tokens of each class's prefix per order, none where it has none.

    hot: the class has hot tokens in its prefix; few: how many cold tokens it has, the unshared ones included.
    """
    counts = _flat(classes).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = _flat(classes).join(counts, "token").groupBy("k").agg(F.collect_list(F.struct("token", "df")).alias("all"))
    held = shared.join(classes.select("k", "n"), "k").where(F.size("all") >= F.ceil(F.col("n") * rules.percent / 100)).select("k", "n", "all")

    def run(batches):
        salts = np.arange(ORDERS, dtype=np.uint64) * _MIX
        for batch in batches:
            for k, n, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                token, df = pairs.values.field(0).to_numpy(), pairs.values.field(1).to_numpy()
                room = n - _needed(n, rules.percent) + 1 - (n - len(token))  # of the prefix, after the unshared tokens
                if room <= 0:
                    continue
                few = n - int((df > rules.cold).sum())
                step = np.where(df > rules.cold, 1, 0)
                classed = np.ceil(np.log2(df) / 2)
                out_o, out_t = [], []
                for o, first in enumerate((df, classed, step)):
                    mixed = (token.view(np.uint64) ^ salts[o]) * _MIX
                    chosen = np.lexsort((mixed, first, step))[:room]
                    out_o.append(np.full(len(chosen), o, np.int32)), out_t.append(token[chosen])
                size = sum(map(len, out_t))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_o)), pa.array(np.concatenate(out_t)), pa.array(np.full(size, k)), pa.array(np.full(size, n)),
                                                  pa.array(np.full(size, few < n - _needed(n, rules.percent) + 1)), pa.array(np.full(size, few, np.int64))], names=["o", "token", "k", "n", "hot", "few"])

    return held.mapInArrow(trimmed(run), "o int, token bigint, k bigint, n bigint, hot boolean, few bigint")


def _possible(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def cold_links(prefix: DataFrame, classes: DataFrame, rules: Rules) -> DataFrame:
    """a, b (representatives): confirmed links of pairs that met in cold tokens under all orders."""
    # Hot tokens of the classes are left to hot_links; a cold token has at most ``cold`` classes, which bounds the list.
    frequent = prefix.groupBy("o", "token").agg(F.count("*").alias("many")).where(f"many > {rules.cold}").select("o", "token")
    cold = prefix.join(frequent, ["o", "token"], "left_anti")
    lists = cold.groupBy("o", "token").agg(F.collect_list(F.struct("k", "n", "hot")).alias("m")).where(F.size("m") > 1)
    pairs = lists.select("o", F.explode("m").alias("x"), "m").select("o", "x", F.explode("m").alias("y"))
    pairs = pairs.where((F.col("x.k") < F.col("y.k")) & ~(F.col("x.hot") & F.col("y.hot")) & _possible(F.col("x.n"), F.col("y.n"), rules.percent))
    met = pairs.groupBy(F.col("x.k").alias("ka"), F.col("y.k").alias("kb")).agg(F.bit_or(F.expr("shiftleft(1, o)")).alias("orders")).where(f"orders = {(1 << ORDERS) - 1}")
    percent = rules.percent

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    first = classes.select(F.col("k").alias("ka"), F.col("rep").alias("a"), F.col("tokens").alias("x"))
    second = classes.select(F.col("k").alias("kb"), F.col("rep").alias("b"), F.col("tokens").alias("y"))
    return materialise(met, "ngram-pairs").join(second, "kb").join(first, "ka").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a bigint, b bigint")


def _clusters(prefix: DataFrame) -> DataFrame:
    """k, g: hot classes with one cluster key for all orders."""
    at = prefix.select("token", "o", (F.col("k") * 4 + F.col("o")).alias("v"))
    least = materialise(at.groupBy("token", "o").agg(F.min("v").alias("low")), "ngram-lists")
    links = at.join(least, ["token", "o"]).where("v <> low").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
    comps = components(materialise(links, "ngram-shared"))
    member = at.select("v").distinct().join(comps.withColumnRenamed("id", "v"), "v", "left").select(
        F.expr("v div 4").alias("k"), (F.col("v") % 4).alias("o"), F.coalesce("comp", "v").alias("comp"))
    own = [F.max(F.when(F.col("o") == o, F.col("comp"))).alias(f"c{o}") for o in range(ORDERS)]
    return member.groupBy("k").agg(*own).select("k", F.struct(*[f"c{o}" for o in range(ORDERS)]).alias("g"))


def _shards(docs: Column, tokens: Column, rules: Rules) -> Column:
    return F.greatest(F.ceil(docs / rules.shard_docs), F.ceil(tokens / rules.shard_tokens)).cast("int")


def _shard(count: Column) -> Column:
    return F.pmod(F.xxhash64("k"), F.greatest(count, F.lit(1))).cast("int")


def hot_links(prefix: DataFrame, classes: DataFrame, rules: Rules) -> DataFrame:
    """a, b (representatives): a spanning forest of the links among classes with hot prefixes."""
    hot = materialise(prefix.where("hot"), "ngram-hot")
    # A size class spans a ratio a little above 100 / percent, so that similar sets are in the same or in neighbouring ones.
    sized = F.floor(F.log(F.col("n")) / F.log(F.lit(100.001 / rules.percent))).cast("int")
    rows = _clusters(hot).join(hot.select("k", "few").distinct(), "k").join(classes, "k").select("k", "g", "rep", "n", "tokens", "few", sized.alias("s"))
    rows = materialise(rows, "ngram-members")
    keys = ["g", "s"]
    sums = materialise(rows.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("n").alias("all")).withColumn("blocks", _shards(F.col("docs"), F.col("all"), rules)), "ngram-sizes")
    large, links = sums.where("blocks > 1").select(*keys, "blocks"), None
    lead = rows.select("k").withColumn("lead", F.lit(True)).limit(0)
    apart = sums.select(*keys).limit(0)
    if not large.isEmpty():
        members = rows.join(large, keys)
        pivots = members.groupBy(*keys, "blocks", F.pmod(F.xxhash64("k"), F.lit(rules.pivots)).alias("draw")).agg(F.min(F.struct("few", "k")).alias("p"))
        pivots = pivots.select(*keys, "blocks", F.col("p.k").alias("k")).join(rows.select("k", "rep", "n", "tokens"), "k")
        shipped = members.select(*keys, _shard(F.col("blocks")).alias("i"), "rep", "n", "tokens").unionByName(
            pivots.select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "rep", "n", "tokens"))
        # They also go to the shards of the next size class, which joins most pairs of neighbours that belong together.
        above = large.select("g", (F.col("s") - 1).alias("s"), F.col("blocks").alias("next"))
        shipped = shipped.unionByName(pivots.join(above, keys).select(
            "g", (F.col("s") + 1).alias("s"), F.explode(F.sequence(F.lit(0), F.col("next") - 1)).alias("i"), "rep", "n", "tokens"))
        links = materialise(_to_pivots(shipped, rules).distinct(), "ngram-pivoted")
        comps = components(links).withColumnRenamed("id", "rep")
        labelled = materialise(members.select(*keys, "k", "rep").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "ngram-labelled")
        shares = labelled.groupBy(*keys, "comp").agg(F.count("*").alias("many"))
        main = materialise(shares.groupBy(*keys).agg(F.max_by("comp", F.struct("many", "comp")).alias("main")), "ngram-main")
        lead = materialise(labelled.join(main, keys).where("comp = main").select("k").distinct(), "ngram-joined").withColumn("lead", F.lit(False))
        # Neighbours whose largest components have not met: what may tie them is a link of two members that lead nowhere else.
        above = main.select("g", (F.col("s") - 1).alias("s"), F.col("main").alias("next"))
        apart = materialise(main.join(above, keys).where("main <> next").select(*keys), "ngram-apart")
    rows = rows.join(lead, "k", "left").withColumn("lead", F.coalesce("lead", F.lit(True)))
    weight = lambda where: (F.sum(F.when(where, 1).otherwise(0)), F.sum(F.when(where, F.col("n")).otherwise(0)))
    sums = rows.groupBy(*keys).agg(*[_shards(*weight(w), rules).alias(x) for x, w in (("whole", F.lit(True)), ("leads", F.col("lead")), ("others", ~F.col("lead")))])
    sums = materialise(sums, "ngram-shards")
    near = [sums.select("g", (F.col("s") - d).alias("s"), *[F.col(x).alias(f"{x}_{name}") for x in ("whole", "leads", "others")]) for d, name in ((1, "up"), (-1, "down"))]
    near += [apart.select("g", (F.col("s") + d).alias("s"), F.lit(1).alias(name)) for d, name in ((0, "apart_up"), (1, "apart_down"))]
    rows = rows.join(reduce(lambda a, b: a.join(b, keys, "left"), near, sums).fillna(0), keys)

    def each(s: Column, i: Column, t: Column, j: Column) -> Column:
        return F.struct(s.cast("int").alias("s"), i.cast("int").alias("i"), t.cast("int").alias("t"), j.cast("int").alias("j"))

    def many(count: str, made) -> Column:
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), made)

    s, own, part, other = F.col("s"), _shard(F.col("leads")), _shard(F.col("whole")), _shard(F.col("others"))
    as_lead = F.concat(many("whole", lambda j: each(s, own, s, j)), many("whole_up", lambda j: each(s, own, s + 1, j)), many("others_down", lambda j: each(s, own, s - 1, j)))
    as_any = F.concat(many("leads", lambda i: each(s, i, s, part)), many("leads_down", lambda i: each(s - 1, i, s, part)))
    none = F.array().cast("array<struct<s:int,i:int,t:int,j:int>>")
    # Largest components that are apart meet as a whole, in groups of their own (i below 0).
    up = F.when(F.col("apart_up") == 1, many("others_up", lambda j: each(s, -1 - other, s + 1, j))).otherwise(none)
    down = F.when(F.col("apart_down") == 1, many("others_down", lambda i: each(s - 1, -1 - i, s, other))).otherwise(none)
    as_other = F.concat(many("leads_up", lambda i: each(s + 1, i, s, other)), up, down)
    places = F.array_distinct(F.concat(F.when(F.col("lead"), as_lead).otherwise(none), as_any, F.when(~F.col("lead"), as_other).otherwise(none)))
    dealt = rows.select("g", F.explode(places).alias("at"), "rep", "n", "tokens")
    found = compared(dealt, ["g", "at"], rules.percent)
    return found if links is None else found.unionByName(links)


def _to_pivots(shipped: DataFrame, rules: Rules) -> DataFrame:
    # A shard with its pivots, and those of the size class below, is less than two shards; its own links come with it, which does no harm.
    return compared(shipped, ["g", "s", "i"], rules.percent)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """id, n_shingles, component_id: one row per input row."""
    # Rows with sets are large: their batches are bounded by bytes.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    counted = materialise(shared_counts(texts, rules), "ngram-counted")
    alive = counted.where(f"id is not null and n > 0 and 100 * shared >= {rules.percent} * n").select(F.col("id").alias("alive")).distinct()
    alive = stored_small(alive, "ngram-alive", 1_000_000)
    sets = materialise(_sets(texts.join(alive, texts["id"] == alive["alive"], "left_semi")).where("n > 0"), "ngram-sets")
    firsts = materialise(sets.groupBy("digest").agg(F.min("id").alias("rep")), "ngram-firsts")
    classes = sets.join(firsts, "digest").where("id = rep").select("digest", "rep", "n", "tokens").dropDuplicates(["digest"])
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("k"), "rep", "n", "tokens"), "ngram-classes")
    prefix = materialise(prefixes(classes, rules), "ngram-prefixes")
    owned = materialise(sets.select("id", "digest").join(firsts, "digest").select("id", "rep").distinct(), "ngram-owned")
    links = cold_links(prefix, classes, rules).unionByName(hot_links(prefix, classes, rules)).unionByName(owned.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comps = components(materialise(links, "ngram-links"))
    out = counted.join(comps, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))
