"""Small tables with the cases that every operator must take, and brute-force versions to hold results against."""

from __future__ import annotations

import random
import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest string, score string, kept string, row bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "s"]) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    passage = prose(rng, 30)
    base = prose(rng, 120)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(20)]
    texts += [texts[0], texts[0].replace(" ", "  \t"), texts[3], f"{prose(rng, 10)} {passage} {prose(rng, 5)}", f"{passage}\n{prose(rng, 20)}", passage]
    for k in (1, 1, 2, 3, 8, 30):
        words = base.split()
        for i in rng.sample(range(len(words)), k):
            words[i] = "edited"
        texts.append(" ".join(words))
    texts += [base, base.upper(), None, "", "  \n ", "one", "One", "a b c d", "a b c d", "x " * 400, "x " * 401, "é" * 3000, "Ünïcödé ß 漢字 " * 40, prose(rng, 3000)]
    out = [(i, t, "en", "src0" if i % 3 else None, None if t is None else len(t), "x", "y", "z", "k", i) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, "no id here", None, None, None, None, None, None, None, None), (None, texts[1], "en", "s", 1, "x", "y", "z", "k", 1)]
    rng.shuffle(out)
    return out


def docs(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def remainder(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text) -> frozenset:
    w = [x.lower() for x in words(text)]
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def near_components(table: list[tuple]) -> dict:
    """doc_id -> smallest id reachable over links at 85 percent, all pairs compared."""
    sets = [(r[0], shingle_set(r[1])) for r in table if r[0] is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def removed_words(table: list[tuple], width: int = 13) -> dict:
    """doc_id -> (words, removed, kept words)."""
    first: dict = {}
    for r in table:
        w = words(r[1])
        for i in range(len(w) - width + 1):
            if r[0] is not None:
                key = tuple(w[i:i + width])
                first[key] = min(first.get(key, r[0]), r[0])
    out = {}
    for r in table:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if r[0] is not None and first[tuple(w[i:i + width])] < r[0]:
                gone[i:i + width] = [True] * width
        out[r[0], r[1]] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out
