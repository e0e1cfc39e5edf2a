"""Language-model scoring with a probabilistic suffix tree over words, whose root is one over classes of words.

The tree over words has every run of up to ``depth`` words of the training texts as a context, whatever its count, and every word
or end that follows it: nothing is pruned, and it grows with the corpus. A context's next-word distribution is smoothed towards
that of its longest proper suffix, with the weight of ``prior`` observations: a word after a context has the probability
(n(context, word) + prior p) / (n(context) + prior), with p from the suffix. The empty context has the probabilities of the tree over
classes, which gives words and contexts without counts theirs:

Words are counted over the whole training text. A word with at least ``symbol_share`` of all tokens is a symbol of its own;
the others are symbols by their last two bytes where such a class has that share, or else one symbol for the rest. The end
of a text is a token and a symbol. This tree's states are contexts of up to ``depth`` symbols. It grows level by level: a
context is counted if it makes up at least ``context_share`` of the tokens, and retained if the distribution of what follows
it diverges from that of its longest retained suffix by at least ``divergence`` bits. Its next-symbol distribution is
smoothed towards that suffix's, with the weight of ``prior`` observations; the root is smoothed by 0.5 a symbol.

There a token's probability is that of its symbol in the longest state that is a suffix of what came before, times that of the
word within its symbol: (c + 0.5) / (C + 0.5 (V + 1)) over the V known words of the symbol and one unknown.

The shares bound the tree over classes only: at most 2 / symbol_share + 2 symbols and depth / context_share states, whatever
the input, so it is broadcast. What grows, the counts of words and of runs of words, is never broadcast. Runs meet by 63 bits of
hash: of n distinct runs, n * n / 2^64 pairs are expected to be taken for one.

Cases: null text is empty (its end alone is scored); rows that repeat are rows of their own; a null id counts as the empty
text for the split; an empty training set gives base scores of an empty vocabulary; further columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, text_slices, trimmed, words_of
from tidemark.session import scratch_path
from tidemark.sources.store import materialise, mounted

END = b""  # no word is empty
DISTINCT = 400_000
# Tokens of a block, and tokens of all blocks for each range of hashes.
BLOCK_TOKENS, ASKED_TOKENS = 2_000_000, 1_000_000
BLOCK_ROWS = "block bigint, size bigint, tokens binary, lengths binary, train binary, hashes binary, symbols binary, tags binary"
BLOCK_NAMES = [x.split()[0] for x in BLOCK_ROWS.split(", ")]
SCORE_NAMES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


@dataclass(frozen=True)
class Rules:
    depth: int = 2
    symbol_share: float = 5e-4
    context_share: float = 5e-4
    frequent_share: float = 1e-5
    divergence: float = 0.01
    prior: float = 10.0


@dataclass
class Symbols:
    """The bounded part of the vocabulary and the classes."""

    frequent: dict[bytes, int]  # word -> index
    of_frequent: np.ndarray  # symbol by index
    classes: dict[bytes, int]  # last two bytes -> symbol
    log_mass: np.ndarray  # by symbol: log10 of the mass its words share
    counts: np.ndarray  # by symbol
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def rest(self) -> int:
        return self.size - 1

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index in frequent (-1: not) and symbol of each word."""
        index = np.fromiter(map(self.frequent.get, words, repeat(-1)), np.int64, len(words))
        symbol = self.of_frequent[index] if len(self.of_frequent) else np.zeros(len(words), np.int64)
        rare = np.flatnonzero(index < 0)
        classes, rest = self.classes, self.rest
        symbol[rare] = np.fromiter((classes.get(words[i][-2:], rest) for i in rare.tolist()), np.int64, len(rare))
        return index, symbol


@dataclass
class Tree:
    """Retained contexts by length, and log10 of the next-symbol distribution of each state; state 0 is the root."""

    size: int
    contexts: list[np.ndarray] = field(default_factory=list)  # sorted codes by length
    states: list[np.ndarray] = field(default_factory=list)
    log_next: np.ndarray | None = None

    def states_of(self, symbols: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """The state before each position; ``closed`` marks the first position of each text."""
        state = np.zeros(len(symbols), np.int64)
        for length, (codes, numbers) in enumerate(zip(self.contexts, self.states, strict=True), 1):
            at, code = contexts_before(symbols, closed, length, self.size)
            if len(codes) and len(at):
                slot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[slot] == code
                state[at[hit]] = numbers[slot[hit]]
        return state


def contexts_before(symbols: np.ndarray, first: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``length`` symbols before them in their own text, and those symbols as one number, oldest first."""
    n = len(symbols)
    if n <= length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.flatnonzero(np.arange(n) - starts >= length)
    code = np.zeros(len(at), np.int64)
    for back in range(length, 0, -1):
        code = code * size + symbols[at - back]
    return at, code


def _texts(batches):
    for batch in batches:
        for part in text_slices(batch, batch.num_columns - 1):
            yield part, [words_of(t) for t in part.column(part.num_columns - 1).to_pylist()]


def word_counts(training: DataFrame, text_col: str = "text") -> DataFrame:
    """word (UTF-8), c: every word of the training texts, and the empty word for their ends."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for _, texts in _texts(batches):
            for words in texts:
                counts.update(words)
            counts[END] += len(texts)
            if len(counts) > DISTINCT:
                yield flush()
        if counts:
            yield flush()

    found = training.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


def symbols_of(counts: DataFrame, rules: Rules) -> Symbols:
    """Collects what the shares bound: frequent words and classes, and three totals."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(total["n"]), int(total["v"])
    frequent = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= max(1.0, rules.frequent_share * tokens))
                       .where(F.col("word") != F.lit(END)).collect()), key=lambda x: (-x[1], x[0]))
    own = [(w, c) for w, c in frequent if c >= rules.symbol_share * tokens]
    ends = tokens and int(counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    floor = rules.symbol_share * tokens
    classed = counts.where((F.col("c") < floor) & (F.col("word") != F.lit(END))).groupBy(F.expr("substring(word, -2, 2)").alias("tail")).agg(
        F.sum("c").alias("c"), F.count("*").alias("v"))
    large = classed.where(F.col("c") >= max(1.0, floor)).collect()
    left = classed.where(F.col("c") < max(1.0, floor)).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    # Symbols: 0 is the end, then words, then classes, then the rest.
    words = {w: i for i, (w, _) in enumerate(own, 1)}
    classes = {bytes(r["tail"]): i for i, r in enumerate(sorted(large, key=lambda r: bytes(r["tail"])), 1 + len(own))}
    n_class = {bytes(r["tail"]): (r["c"], r["v"]) for r in large}
    rest = 1 + len(own) + len(classes)
    sizes = [ends, *(c for _, c in own), *(n_class[t][0] for t in classes), left[0]]
    mass = [ends + 0.5, *(c + 0.5 for _, c in own), *(n_class[t][0] + 0.5 * (n_class[t][1] + 1) for t in classes), left[0] + 0.5 * (left[1] + 1)]
    symbol = [words.get(w, classes.get(w[-2:], rest)) for w, _ in frequent]
    return Symbols({w: i for i, (w, _) in enumerate(frequent)}, np.array([*symbol, rest], np.int64), classes, np.log10(np.array(mass, float)),
                   np.array(sizes, np.int64), tokens, distinct)


def _sequence(symbols: Symbols, texts: list[list[bytes]]):
    """All symbols of some texts in a row, each text closed by the end; where texts begin."""
    flat = [w for words in texts for w in words]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    _, symbol = symbols.read(flat)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), lengths)
    row = np.zeros(len(flat) + len(texts), np.int64)
    row[place] = symbol
    first = np.zeros(len(row), bool)
    first[np.cumsum(lengths + 1) - lengths - 1] = True
    return row, first


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adds up counts of equal codes."""
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[starts], np.add.reduceat(n, starts)


def next_counts(training: DataFrame, symbols, length: int, candidates: np.ndarray, size: int, text_col: str = "text") -> DataFrame:
    """code (context * size + next symbol), n: what follows each candidate context of this length."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast((symbols, candidates))

    def run(batches):
        known, wanted = shared.value
        codes, counts, held = [], [], 0
        for _, texts in _texts(batches):
            row, first = _sequence(known, texts)
            at, code = contexts_before(row, first, length, size)
            if not len(at) or not len(wanted):
                continue
            slot = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            hit = wanted[slot] == code
            found, n = np.unique(code[hit] * size + row[at[hit]], return_counts=True)
            codes.append(found)
            counts.append(n)
            held += len(found)
            if held > 4_000_000:
                found, n = _summed(codes, counts)
                codes, counts, held = [found], [n], 0
        if codes:
            found, n = _summed(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["code", "n"])

    found = training.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "code bigint, n bigint")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def grow_tree(training: DataFrame, symbols: Symbols, rules: Rules, text_col: str = "text") -> Tree:
    """Level by level; per level at most 1 / context_share contexts with what follows them come to the driver."""
    size = symbols.size
    tree = Tree(size)
    root = (symbols.counts + 0.5) / (symbols.tokens + 0.5 * size)
    rows, state_of = [root], {}
    least = rules.context_share * symbols.tokens
    candidates = np.flatnonzero(symbols.counts >= max(1.0, least))
    candidates = candidates[candidates != 0].astype(np.int64)  # nothing follows the end
    for length in range(1, rules.depth + 1):
        if not len(candidates):
            break
        table = next_counts(training, symbols, length, candidates, size, text_col).toArrow()
        code, n = table["code"].to_numpy(), table["n"].to_numpy().astype(np.float64)
        context, follow = code // size, code % size
        kept, numbers = [], []
        order = np.argsort(context, kind="stable")
        context, follow, n = context[order], follow[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        for start, stop in zip(starts, [*starts[1:], len(context)], strict=True):
            here = int(context[start])
            parent = rows[_longest(here, length, size, state_of)]
            observed, seen, total = follow[start:stop], n[start:stop], n[start:stop].sum()
            share = seen / total
            if (share * np.log2(share / parent[observed])).sum() < rules.divergence:
                continue
            mixed = rules.prior * parent
            mixed[observed] += seen
            state_of[(length, here)] = len(rows)
            kept.append(here)
            numbers.append(len(rows))
            rows.append(mixed / (total + rules.prior))
        tree.contexts.append(np.array(kept, np.int64))
        tree.states.append(np.array(numbers, np.int64))
        # A longer context can only reach the share if the pair of its last symbols does.
        reach = (n >= max(1.0, least)) & (follow != 0)
        candidates = np.sort((context * size + follow)[reach])
    tree.log_next = np.log10(np.array(rows)).astype(np.float32)
    return tree


def _longest(code: int, length: int, size: int, state_of: dict) -> int:
    """The state of the longest retained proper suffix of a context."""
    for shorter in range(length - 1, 0, -1):
        if (state := state_of.get((shorter, code % size**shorter))) is not None:
            return state
    return 0


def _mixed(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of tokens that are longer by one."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + token
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, each compressed: upper planes have few values."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    parts = [pa.compress(planes[:, i].tobytes(), "zstd", asbytes=True) for i in range(width)]
    return np.array([len(values), width, *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpacked(blob: bytes) -> np.ndarray:
    n, width = np.frombuffer(blob, "<u4", 2).tolist()
    out, at = np.zeros((n, 8), np.uint8), 8 + 4 * width
    for i, size in enumerate(np.frombuffer(blob, "<u4", width, 8).tolist()):
        out[:, i] = np.frombuffer(pa.decompress(blob[at:at + size], n, "zstd", asbytes=True), np.uint8)
        at += size
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _blocks(shared, tags: list[str]):
    """Rows (*tags, train, text) to blocks of texts: tokens as numbers of the block's own words, their hashes and symbols."""

    def run(batches):
        known, partition = shared.value[0], TaskContext.get().partitionId()
        numbers: defaultdict = defaultdict()
        numbers.default_factory = numbers.__len__
        tokens, lengths, train, kept, made, held = [], [], [], [], 0, 0

        def flush():
            row, words = np.concatenate(tokens), list(numbers)
            # Frequent words get small numbers, which take few bytes.
            order = np.argsort(-np.bincount(row, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words = [words[i] for i in order.tolist()]
            symbol = known.read(words)[1]
            symbol[rank[numbers[END]]] = 0
            hashes = pd.util.hash_array(np.array(words, object), categorize=False)
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(kept)
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            values = [(partition << 24) + made, len(row), packed(rank[row]), packed(np.concatenate(lengths)), packed(np.concatenate(train)), hashes.astype("<u8").tobytes(),
                      packed(symbol), sink.getvalue().to_pybytes()]
            for x in (tokens, lengths, train, kept, numbers):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] * 2 + [pa.binary()] * 6, strict=True)], names=BLOCK_NAMES)

        for part, texts in _texts(batches):
            flat = []
            for words in texts:
                flat += words
                flat.append(END)
            tokens.append(np.fromiter(map(numbers.__getitem__, flat), np.int32, len(flat)))
            lengths.append(np.fromiter((len(words) + 1 for words in texts), np.int64, len(texts)))
            train.append(part.column(len(tags)).to_numpy(zero_copy_only=False).astype(np.int64))
            kept.append(pa.RecordBatch.from_arrays(part.columns[:len(tags)], names=tags))
            held += len(flat)
            if held >= BLOCK_TOKENS:
                yield flush()
                made, held = made + 1, 0
        if held:
            yield flush()

    return trimmed(run)


def _opened(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the length of each text, where each begins, and the place of each token in its text."""
    tokens, lengths = unpacked(block["tokens"]).astype(np.int64), unpacked(block["lengths"]).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    return tokens, lengths, starts, np.arange(len(tokens)) - np.repeat(starts, lengths)


def _runs(block: dict, tokens: np.ndarray, place: np.ndarray, deepest: int):
    """For one token, two, up to ``deepest``: where runs of so many tokens of a text end, and their hashes (63 bits)."""
    token = np.frombuffer(block["hashes"], "<u8").astype(np.uint64, copy=False)[tokens]
    run = token
    for length in range(1, deepest + 1):
        if length > 1:
            longer = np.zeros(len(run), np.uint64)
            longer[1:] = _mixed(run[:-1], token[1:])
            run = longer
        at = np.flatnonzero(place >= length - 1)
        yield at, run[at] >> np.uint64(1)


def _asked(deepest: int, ranges: int):
    """Blocks to (slot, block, keys, n): the distinct runs of a block by length and range of hashes, and how many are in training texts."""

    def run(batches):
        bounds = np.array([(r << 63) // ranges for r in range(1, ranges)], np.uint64)
        one = np.uint64(1)
        for batch in batches:
            for block in batch.to_pylist():
                tokens, lengths, _, place = _opened(block)
                train = np.repeat(unpacked(block["train"]), lengths)
                slots, keys, n = [], [], []
                for level, (at, key) in enumerate(_runs(block, tokens, place, deepest)):
                    ordered = np.sort(key << one | train[at])
                    starts = _starts(ordered >> one)
                    if not len(starts):
                        continue
                    counts, key = np.add.reduceat(ordered & one, starts), ordered[starts] >> one
                    cuts = [0, *np.searchsorted(key, bounds).tolist(), len(key)]
                    for r, (low, high) in enumerate(pairwise(cuts)):
                        if low < high:
                            slots.append(level * ranges + r)
                            keys.append(packed(np.diff(key[low:high], prepend=np.uint64(0))))
                            n.append(packed(counts[low:high]))
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([block["block"]] * len(slots), pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())],
                                                 names=["slot", "block", "keys", "n"])

    return trimmed(run)


def _totals(rows: pa.Table) -> pa.Table:
    """The runs of one slot from all blocks: each block gets back, in its own order, how often they are in all training texts."""
    keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in rows.column("keys").to_pylist()]
    key, n = np.concatenate(keys), np.concatenate([unpacked(x) for x in rows.column("n").to_pylist()])
    order = np.argsort(key)
    starts = _starts(key[order])
    total = np.empty(len(key), np.uint64)
    total[order] = np.repeat(np.add.reduceat(n[order], starts), np.diff(starts, append=len(key)))
    parts = np.split(total, np.cumsum([len(x) for x in keys])[:-1])
    return pa.table({"slot": rows.column("slot"), "block": rows.column("block"), "n": pa.array([packed(x) for x in parts], pa.binary())})


def _scored(shared, rules: Rules, ranges: int):
    """Blocks with what came back for them to scored rows."""

    def run(batches):
        known, tree = shared.value
        base = math.log10(known.tokens + 0.5 * (known.distinct + 1))
        for batch in batches:
            for block in batch.to_pylist():
                if "path" in block:
                    block |= pq.read_table(block["path"], partitioning=None).to_pylist()[0]
                tokens, lengths, starts, place = _opened(block)
                back = [[] for _ in range(rules.depth + 1)]
                for x in sorted(block["found"], key=lambda x: x["slot"]):
                    back[x["slot"] // ranges].append(unpacked(x["n"]))
                counts = []
                for parts, (at, key) in zip(back, _runs(block, tokens, place, rules.depth + 1), strict=True):
                    n = np.zeros(len(tokens))
                    if len(at):
                        order = np.argsort(key)
                        first = _starts(key[order])
                        own = np.empty(len(at))
                        own[order] = np.repeat(np.concatenate(parts).astype(float), np.diff(first, append=len(at)))
                        n[at] = own
                    counts.append(n)
                symbol = unpacked(block["symbols"]).astype(np.int64)[tokens]
                logs = np.log10(counts[0] + 0.5)
                chance = 10.0 ** (tree.log_next[tree.states_of(symbol, place == 0), symbol] + logs - known.log_mass[symbol])
                for length in range(1, rules.depth + 1):
                    at = np.flatnonzero(place >= length)
                    chance[at] = (counts[length][at] + rules.prior * chance[at]) / (counts[length - 1][at - 1] + rules.prior)
                tags = pa.ipc.open_stream(block["tags"]).read_all().combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in tags.columns), pa.array(lengths),
                     pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts)), pa.array(np.full(len(lengths), known.tokens, np.int64)),
                     pa.array(np.add.reduceat(logs, starts) - lengths * base), pa.array(np.add.reduceat(np.log10(chance), starts))], names=[*tags.column_names, *SCORE_NAMES])

    return trimmed(run)


def score(docs: DataFrame, train, symbols: Symbols, tree: Tree, rules: Rules, id_col: str = "doc_id", text_col: str = "text",
          carry: list[str] | None = None) -> DataFrame:
    """id, carried columns, n_tokens, n_known, train_tokens, base_score, score of every row; ``train`` (a column) marks the training texts.

    Texts are written once as blocks of tokens. A block asks for each distinct run of up to ``depth`` + 1 words once, by ranges of
    hashes, so no run is hot wherever it is counted, and the counts come back to the block in its own order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((symbols, tree))
    carried = [id_col, *(carry or [])]
    tags = [f"c{i}" for i in range(len(carried))]
    rows = docs.select(*[F.col(c).alias(t) for c, t in zip(carried, tags, strict=True)], F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    path = scratch_path(spark, "token-blocks")
    # A file per block: on a mounted file system the task that scores it opens it, and it is not shuffled.
    rows.mapInArrow(_blocks(shared, tags), BLOCK_ROWS).write.option("maxRecordsPerFile", 1).parquet(path)
    blocks = spark.read.schema(BLOCK_ROWS).parquet(path)
    deepest = rules.depth + 1
    ranges = 1 + int(blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // ASKED_TOKENS
    asked = blocks.mapInArrow(_asked(deepest, ranges), "slot bigint, block bigint, keys binary, n binary")
    found = asked.groupBy("slot").applyInArrow(_totals, "slot bigint, block bigint, n binary").groupBy("block").agg(F.collect_list(F.struct("slot", "n")).alias("found"))
    if mounted(spark, path):
        blocks = blocks.select("block", F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), F.lit("+"), F.lit("%2B"))).alias("path"))
    kinds = ", ".join(f"{t} {rows.schema[t].dataType.simpleString()}" for t in tags)
    out = found.join(blocks, "block").mapInArrow(_scored(shared, rules, ranges), f"{kinds}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.select(*[F.col(t).alias(c) for c, t in zip(carried, tags, strict=True)], *SCORE_NAMES)


def learn_and_score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Learns from the rows outside ``held_out`` (a column) and scores all rows."""
    (flag,) = fresh(docs, "held_out")
    marked = docs.withColumn(flag, held_out)
    training = marked.where(~F.col(flag))
    counts = materialise(word_counts(training, text_col), "word-counts")
    symbols = symbols_of(counts, rules)
    tree = grow_tree(training, symbols, rules, text_col)
    out = score(marked, ~F.col(flag), symbols, tree, rules, id_col, text_col, [flag])
    return out.withColumnRenamed(flag, "held_out")
