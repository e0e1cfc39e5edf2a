"""Near-duplicate documents: a chosen-path set similarity join over MinHash signatures.

A document is its set of distinct five-word shingles. Equal sets are one class with the smallest id as its representative;
only representatives are compared. Each of ``trees`` independent trees puts a representative into the node named by one
full minimum of its own. A node of at most ``small`` members is compared exhaustively, in one task and on the full sets. A
larger one branches: two coordinates are drawn from the tree's own share of the signature by the node's hash, and members
go to the children named by their minima there. A pair at the threshold t is kept by a level with 1 - (1 - t)^2 of the
chance below it, which never falls under 0.96 at 0.85 and 0.93 at 0.80 however deep a node is, so that one tree finds it
with 0.82 and 0.75, and 8 trees miss it with 1e-6 and 2e-5.

Nodes above ``small`` are not branched before the work in them is known. All members are compared with ``pivots`` members
drawn from the node, components are taken, and the members outside the node's largest component are what is left to do:
none - the node is done; at most ``rest`` - they are compared with all members, shard by shard; more - the node branches.
Where that comparison would copy a member into more than ``copies`` groups on average, the node branches too if its children
hold at most half of its pairs: members that have little in common part at once, while a dense group would only be copied.
Members of a node that was compared like that are known to each other: where a later node holds more of them than of its
largest component, only its other members are left, so that a dense group is not compared again in every tree.
From ``deepest`` on they are compared with all members whatever their number, so no link depends on a cap. Dense groups
cost linear work, and nodes whose members are in one component are never looked at again: the first ``first_trees`` trees
are done before the others start, which mostly find nothing left.

No pair ever leaves a task. A group of rows (a small node, a shard with pivots, two shards) is first compared on signatures:
members with a possible partner, which agrees in ``cutoff`` of 128 coordinates (a pair at the threshold falls below with a
chance under 1e-4) and whose size allows the similarity, go on. Their full sets are brought to the group and compared
exactly there, and only a spanning forest of the links comes out. Shards are bounded by members and by set sizes.

Cases: null and empty texts have an empty set and no links; fewer than five words are one shingle; a null id gets no
component and is kept; rows that repeat an id are one document, and all of them share its component; very long texts make
shards of few members; equal draws fall to the smaller id; an empty table gives an empty result. Ids are integers; further
columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored_small, text_slices, trimmed, without_ids
from tidemark.llm.components import components
from tidemark.llm.sets import MIX, compared, mixed, shingles
from tidemark.sources.store import materialise

COORDINATES = 128
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Rules:
    percent: int = 85  # link if 100 * intersection >= percent * union
    trees: int = 8
    first_trees: int = 2
    small: int = 512
    rest: int = 4096
    copies: int = 3  # of a member, where what is left of a node is compared with all its members
    pivots: int = 16
    cutoff: float = 0.72
    deepest: int = 8
    salt_rows: int = 512  # members of a shard
    shard_tokens: int = 500_000  # and their shingles


_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * MIX) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    low = None
    for start in range(0, len(hashes), 4096):
        part = (hashes[start:start + 4096, None] * _FACTORS).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def sketches(docs: DataFrame, id_col: str, text_col: str, rules: Rules) -> DataFrame:
    """id, n (set size), digest (of the set), nodes (one per tree), sig (128 16-bit coordinates)."""
    trees = rules.trees

    def run(batches):
        salts = mixed(np.arange(trees, dtype=np.uint64) + np.uint64(77))
        for whole in batches:
            for batch in text_slices(whole, 1):
                n, digest, nodes, sig = [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text)
                    n.append(len(s))
                    if not len(s):
                        digest.append(None), nodes.append(None), sig.append(None)
                        continue
                    low = minima(s)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    nodes.append(mixed(low[:trees] ^ salts).view(np.int64).tolist())
                    sig.append((mixed(low) >> np.uint64(48)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(nodes, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["id", "n", "digest", "nodes", "sig"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(trimmed(run), "id bigint, n bigint, digest binary, nodes array<bigint>, sig binary")


_GROUP = ["node", "i", "j"]


def _hits(groups: DataFrame, rules: Rules) -> DataFrame:
    """node, i, j, rep: the members of each group that may be similar to another one outside their component, by signatures."""
    names = [*_GROUP, "rep"]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            where = np.stack([table.column(c).to_numpy().astype(np.int64) for c in _GROUP], 1)
            # The last group may go on in the next batch.
            cut = int(np.flatnonzero((where == where[-1]).all(1))[0])
            held = table.slice(cut)
            yield possible(table.slice(0, cut), where[:cut])
        if held is not None:
            yield possible(held, np.stack([held.column(c).to_numpy().astype(np.int64) for c in _GROUP], 1))

    def possible(table: pa.Table, where: np.ndarray) -> pa.RecordBatch:
        n, comp = table.column("n").to_numpy(), table.column("comp").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
        hit = np.zeros(table.num_rows, bool)
        for apart in range(1, table.num_rows):
            a = np.flatnonzero((where[:-apart] == where[apart:]).all(1))
            if not len(a):
                break
            b = a + apart
            fit = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= rules.percent * np.maximum(n[a], n[b])) & ~(hit[a] & hit[b])
            a, b = a[fit], b[fit]
            near = (sig[a] == sig[b]).mean(axis=1) >= rules.cutoff
            hit[a[near]] = hit[b[near]] = True
        found = table.select(names).filter(pa.array(hit)).combine_chunks()
        return pa.RecordBatch.from_arrays([found.column(c).combine_chunks() for c in names], names=names)

    dealt = groups.select(*names, "n", "comp", "sig").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(trimmed(run), "node bigint, i int, j int, rep bigint")


class Comparer:
    """Links inside groups, on full sets. The sets of documents are written once, when they are first needed."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, rules: Rules):
        self.texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
        self.rules = rules
        self.sets: DataFrame | None = None

    def _gather(self, hits: DataFrame) -> None:
        wanted = hits.select(F.col("rep").alias("want")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select(F.col("rep").alias("want")).distinct(), "want", "left_anti")
        wanted = stored_small(wanted, "near-wanted", 1_000_000)

        def run(batches):
            for whole in batches:
                for batch in text_slices(whole, 1):
                    sets = [shingles(t) for t in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "tokens"])

        texts = self.texts.join(wanted, self.texts["id"] == wanted["want"], "left_semi")
        more = materialise(texts.mapInArrow(trimmed(run), "rep bigint, n bigint, tokens binary"), "near-sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)

    def links(self, groups: DataFrame) -> DataFrame:
        """a, b; groups: node, i, j, rep, n, comp, sig."""
        hits = materialise(_hits(groups, self.rules), "near-hits")
        self._gather(hits)
        return materialise(compared(hits.join(self.sets, "rep"), _GROUP, self.rules.percent), "near-links")


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _shards(rows: Column, tokens: Column, rules: Rules) -> Column:
    return F.greatest(F.ceil(rows / rules.salt_rows), F.ceil(tokens / rules.shard_tokens)).cast("int")


def _live(rows: DataFrame, comps: DataFrame | None, rules: Rules) -> DataFrame:
    """Rows (node, tree, rep, n) of nodes that hold two components or more: with comp, size and shards."""
    rows = _labelled(rows, comps)
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), F.min("comp").alias("one"), F.max("comp").alias("other"))
    nodes = nodes.where("size > 1 and one < other").select("node", "size", _shards(F.col("size"), F.col("tokens"), rules).alias("shards"))
    return materialise(rows.join(materialise(nodes, "near-nodes"), "node").select("node", "tree", "rep", "n", "comp", "size", "shards"), "near-members")


def _shard(count: Column) -> Column:
    return F.pmod(F.xxhash64("node", "rep"), F.greatest(count, F.lit(1))).cast("int")


def _with_pivots(large: DataFrame, count: int) -> DataFrame:
    """Groups of a shard and the node's pivots."""
    drawn = [F.min(F.struct(F.xxhash64("node", "rep", F.lit(i)).alias("draw"), "rep")).alias(f"p{i}") for i in range(count)]
    picked = large.groupBy("node", "shards").agg(*drawn)
    picked = picked.select("node", "shards", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.rep") for i in range(count)]))).alias("rep"))
    copies = picked.select("node", "rep", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("i"))
    own = large.select("node", "rep", _shard(F.col("shards")).alias("i"))
    return own.unionByName(copies).distinct().withColumn("j", F.lit(-1))


def _children(nodes: DataFrame, trees: int) -> DataFrame:
    """parent, node, tree, rep, n: the members of nodes under their two children, by coordinates of the tree's own."""
    own = COORDINATES // trees

    def child(k: int):
        place = 1 + 2 * (F.col("tree") * own + F.pmod(F.xxhash64("node", F.lit(k)), F.lit(own))).cast("int")
        return F.xxhash64("node", F.lit(k), F.substring(F.col("sig"), place, F.lit(2)))

    placed = nodes.select(F.col("node").alias("parent"), "tree", "rep", "n", F.explode(F.array(child(1), child(2))).alias("node"))
    return placed.select("parent", "node", "tree", "rep", "n").distinct()


def _scattered(children: DataFrame) -> DataFrame:
    """node, pairs: twice the pairs that a node's children hold."""
    sizes = children.groupBy("parent", "node").agg(F.count("*").alias("size"))
    return sizes.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("size") * (F.col("size") - 1)).alias("pairs"))


def _known_part(large: DataFrame, seen: DataFrame | None, rules: Rules) -> DataFrame:
    """large with known (the member's pairs with other known ones need no comparison), left_over and leads; nodes that have others.

    The known members are those of the node's largest component, or those that one earlier node compared if they are more.
    """
    shares = large.select("node", "rep", "n", F.lit(0).alias("kind"), F.col("comp").alias("label"))
    if seen is not None:
        shares = shares.unionByName(large.join(seen, "rep").select("node", "rep", "n", F.lit(1).alias("kind"), F.col("label")))
    shares = shares.groupBy("node", "kind", "label").agg(F.count("*").alias("many"), F.sum("n").alias("tokens"))
    best = F.max(F.struct("many", -F.col("kind"), "label", "tokens"))
    total = [F.sum(F.when(F.col("kind") == 0, F.col(c))) for c in ("many", "tokens")]
    main = shares.groupBy("node").agg(best.alias("best"), total[0].alias("many"), total[1].alias("tokens"))
    main = main.select("node", (F.col("best.col2") < 0).alias("earlier"), "best.label", (F.col("many") - F.col("best.many")).alias("left_over"),
                       (F.col("tokens") - F.col("best.tokens")).alias("tokens")).where("left_over > 0")
    main = main.select("node", "earlier", "label", "left_over", _shards(F.col("left_over"), F.col("tokens"), rules).alias("leads"))
    rows = large.join(materialise(main, "near-main"), "node")
    known = F.col("comp") == F.col("label")
    if seen is not None:
        rows = rows.join(seen.withColumn("met", F.lit(True)), ["rep", "label"], "left")
        known = F.when(F.col("earlier"), F.col("met").isNotNull()).otherwise(known)
    return materialise(rows.withColumn("known", known).select(*large.columns, "known", "left_over", "leads"), "near-sorted")


def _left_over(large: DataFrame, reps: DataFrame, seen: DataFrame | None, depth: int, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups that compare what is left in nodes with all their members, the children of nodes that branch, and (rep, label) of costly groups."""
    known = _known_part(large, seen, rules)
    made = F.col("size") * F.col("leads") + F.col("left_over") * F.col("shards")
    costly = made > rules.copies * F.col("size")
    many = F.lit(False) if depth >= rules.deepest else (F.col("left_over") > rules.rest) | costly
    children = materialise(_children(known.where(many).join(reps.select("rep", "sig"), "rep"), rules.trees), "near-children")
    nodes = known.where(many).select("node", "size", "left_over").distinct().join(_scattered(children), "node")
    branching = (F.col("left_over") > rules.rest) | (2 * F.col("pairs") <= F.col("size") * (F.col("size") - 1))
    branching = materialise(nodes.where(branching).select("node"), "near-branching")
    branched = branching.withColumnRenamed("node", "parent")

    def places(count: str, made) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), made)

    def place(i: Column, j: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))

    as_any = places("leads", lambda i: place(i, _shard(F.col("shards"))))
    as_lead = places("shards", lambda j: place(_shard(F.col("leads")), j))
    at = F.when(F.col("known"), as_any).otherwise(F.array_distinct(F.concat(as_any, as_lead)))
    done = known.join(branching, "node", "left_anti")
    finished = done.select("node", "rep", F.explode(at).alias("at")).select("node", "at.i", "at.j", "rep")
    branched = children.join(branched, "parent", "left_semi").select("node", "tree", "rep", "n").distinct()
    return finished, branched, done.where(costly).select("rep", F.col("node").alias("label"))


def _tree_links(roots: DataFrame, reps: DataFrame, comparer: Comparer, links: DataFrame, comps: DataFrame | None, seen: DataFrame | None,
                rules: Rules) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """All links found under the given roots (node, tree, rep, n), joined into the components known before; and the members compared."""

    def found(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = comparer.links(_labelled(groups, comps).join(reps, "rep"))
        after = components(materialise(links.unionByName(more), "near-joined"))
        return after.select(F.col("id").alias("a"), F.col("comp").alias("b")), after

    live, waiting, depth = _live(roots, comps, rules), None, 0
    while True:
        nothing_left = live.isEmpty()
        if nothing_left and waiting is None:
            return links, comps, seen
        large = live.where((F.col("size") > rules.small) | (F.col("shards") > 1))
        small = live.where((F.col("size") <= rules.small) & (F.col("shards") <= 1)).select("node", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep")
        groups = small.unionByName(_with_pivots(large, rules.pivots).select("node", "i", "j", "rep"))
        groups = groups if waiting is None else waiting if nothing_left else groups.unionByName(waiting)
        links, comps = found(groups)
        if nothing_left:
            return links, comps, seen
        large = _live(large.select("node", "tree", "rep", "n"), comps, rules)
        if large.isEmpty():
            return links, comps, seen
        waiting, children, met = _left_over(large, reps, seen, depth, rules)
        # Used from the next round on, when these groups have been compared.
        seen = materialise(met if seen is None else seen.unionByName(met), "near-seen")
        live = _live(children, comps, rules)
        depth += 1


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """id, n_shingles, component_id, kept, class_id (the representative of its equal sets): one row per input row."""
    # Rows with sets are large: their batches are bounded by bytes.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sketched = materialise(sketches(docs, id_col, text_col, rules), "near-sketches")
    held = sketched.where("id is not null and n > 0")
    classes = held.groupBy("digest").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "nodes", "sig"), "id").alias("s"))
    classes = materialise(classes.select("digest", "rep", "s.*"), "near-classes")
    reps = classes.select("rep", "n", "sig").dropDuplicates(["rep"])
    comparer = Comparer(docs, id_col, text_col, rules)
    # Ids whose rows have different sets tie their classes together.
    links = held.join(classes.select("digest", "rep"), "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = materialise(links.join(classes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi"), "near-links")
    comps = seen = None
    planted = classes.select("rep", "n", F.posexplode("nodes").alias("tree", "node")).select("node", "tree", "rep", "n")
    for part in (F.col("tree") < rules.first_trees, F.col("tree") >= rules.first_trees):
        links, comps, seen = _tree_links(planted.where(part), reps, comparer, links, comps, seen, rules)
    comps = comps if comps is not None else components(links)
    roots = classes.select("digest", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    roots = materialise(roots.select("digest", "rep", F.coalesce("comp", "rep").alias("root")), "near-roots")
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce("root", "id"))
    return sketched.join(roots, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), F.when(known, F.coalesce("rep", "id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs with the document of the smallest id of each component; columns as they are."""
    return without_ids(docs, similar(docs, id_col, text_col, rules).where("not kept").select(id_col), id_col, "near-dropped")
