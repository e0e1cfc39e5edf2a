"""Sets of word shingles, and exact comparison of all sets of one group inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.common import give_back, words_of

WORDS = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
DENSE = 48


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; empty without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * MIX + h[i:len(h) - width + 1 + i]
    return np.unique(mixed(out))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of all pairs of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    owner, elements = owner[order], elements[order]
    starts = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]]))
    times = np.diff(np.append(starts, len(elements)))
    out = np.zeros(n * n, np.int32)
    for d in range(2, min(DENSE, n) + 1):  # rare in this group: their pairs are counted one by one
        here = starts[times == d]
        step = max(1, 500_000 // (d * d))
        for lo in range(0, len(here), step):
            who = owner[here[lo:lo + step, None] + np.arange(d)]
            out += np.bincount((who[:, :, None] * n + who[:, None, :]).ravel(), minlength=n * n).astype(np.int32)
    out = out.reshape(n, n)
    often = np.flatnonzero(times > DENSE)
    for lo in range(0, len(often), 2048):  # the others as columns of a matrix
        part = often[lo:lo + 2048]
        has = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), times[part])
        has[owner[np.concatenate([np.arange(starts[i], starts[i] + times[i]) for i in part])], column] = 1
        out += (has @ has.T).astype(np.int32)
    return out


def _forest(table: pa.Table, percent: int) -> pa.Table:
    """(a, b): a spanning forest of the links among the rows (rep, n, tokens)."""
    table = table.combine_chunks()
    rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
    a, b = [], []
    if len(rep) > 1:
        common = overlaps([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("tokens")]).astype(np.int64)
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        free = np.ones(len(rep), bool)
        for start in range(len(rep)):
            if not free[start]:
                continue
            free[start] = False
            edge = np.array([start])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(axis=0) & free)
                free[edge] = False
                a += [rep[start]] * len(edge)
                b += rep[edge].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def compared(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """a, b: a spanning forest of the links in each group of rows (keys, rep, n, tokens: sorted 64-bit hashes).

    A group goes to one task as a whole and no pair leaves it but the forest's, so its size is the caller's to bound.
    """

    def run(table: pa.Table) -> pa.Table:
        found, large = _forest(table, percent), table.num_rows > 128
        if large:
            give_back()
        return found

    return groups.groupBy(*keys).applyInArrow(run, "a bigint, b bigint")
