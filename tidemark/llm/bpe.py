r"""Byte-level BPE by monoid tree reduction.

A text is halved until a part is at most ``leaf`` characters; leaves are encoded on their own. Two neighbours join by
encoding a window around their seam again. The window grows outwards until both edges are calm: a calm place is one where
white space follows a character that is not white space. No match of the pattern can reach across it and none looks past
it, so the tokens outside the window are those of the joined text, whatever comes before or after (the proof is local:
every alternative of the pattern takes white space only at its start or is white space throughout).

A run without calm places, such as a page of one letter or of text without spaces, is one window. Its matches are encoded
one by one, and a match of more than ``piece`` bytes is itself a tree: halves of its bytes, whose token lists are joined by
encoding the last and first 2, 4, 8, ... tokens again until the pair of tokens at either edge is stable, that is, encodes to
itself. A sequence in which every pair of neighbours is stable is the encoding of its bytes, as no merge can cross such a
pair before one inside it does.

Decoding concatenates up the same tree. Texts are independent rows; the ranks (below a megabyte) go to the tasks as a
broadcast variable. Cases: null text is empty and has no ids; rows that repeat are encoded each; a very long text costs
its own length times the depth of its tree; an empty table gives an empty result; columns named in ``keep`` go through.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import text_slices, trimmed

LEAF_CHARS, PIECE_BYTES = 16384, 256
_CALM = regex.compile(r"[^\s\x1c-\x1f\x85᠎​][ \t\n\r]")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class TreeCodec:
    """Encodes and decodes one text at a time with the given ranks file and pattern."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF_CHARS, piece: int = PIECE_BYTES):
        lines = (line.split() for line in ranks.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.matches = regex.compile(pattern)
        self.leaf, self.piece = leaf, piece
        self.stable = lru_cache(1 << 16)(self._stable)

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, 0, len(text))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _leaf(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def _tree(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        start, end = self._calm_before(text, lo, mid), self._calm_after(text, mid, hi)
        outside = len(left) if start == lo else len(self._window(text[start:mid]))
        inside = len(right) if end == hi else len(self._window(text[mid:end]))
        return np.concatenate([left[:len(left) - outside], self._window(text[start:end]), right[inside:]])

    @staticmethod
    def _calm_before(text: str, lo: int, mid: int) -> int:
        reach = 32
        while True:
            start = max(lo, mid - reach)
            found = None
            for found in _CALM.finditer(text, start, mid + 1):
                pass
            if found:
                return found.end() - 1
            if start == lo:
                return lo
            reach *= 2

    @staticmethod
    def _calm_after(text: str, mid: int, hi: int) -> int:
        found = _CALM.search(text, max(mid - 1, 0), hi)
        return found.end() - 1 if found else hi

    def _window(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._leaf(text)
        parts = []
        for match in self.matches.finditer(text):
            raw = match[0].encode()
            parts.append(self._leaf(match[0]) if len(raw) <= self.piece else np.array(self._pieces(raw), np.uint32))
        return np.concatenate(parts)

    def _pieces(self, raw: bytes) -> list[int]:
        if len(raw) <= self.piece:
            return self._merged(raw)
        half = len(raw) // 2
        left, right = self._pieces(raw[:half]), self._pieces(raw[half:])
        width = 2
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            core = self._merged(b"".join(self.bytes_of[t] for t in [*left[i:], *right[:j]]))
            if (i == 0 or self.stable(left[i - 1], core[0])) and (j == len(right) or self.stable(core[-1], right[j])):
                return left[:i] + core + right[j:]
            width *= 2

    def _stable(self, a: int, b: int) -> bool:
        return self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _merged(self, raw: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        n = len(raw)
        end = list(range(1, n + 1))  # end[i]: where the token that starts at i ends; 0 once it is part of another
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := self.ranks.get(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := self.ranks.get(raw[i:end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (last := before[i]) >= 0 and (rank := self.ranks.get(raw[last:stop])) is not None:
                heapq.heappush(heap, (rank, last, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:end[i]]])
            i = end[i]
        return out


@lru_cache(2)
def codec(ranks: bytes, pattern: str) -> TreeCodec:
    """One codec per worker process and ranks file."""
    return TreeCodec(ranks, pattern)


def _mapped(df: DataFrame, keep: list[str], source: str, outputs: list[str], ranks: bytes, pattern: str, work) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(o, T.BinaryType()) for o in outputs])

    def run(batches):
        coder = codec(shared.value, pattern)
        for whole in batches:
            for batch in text_slices(whole, whole.num_columns - 1):
                made = [work(coder, v) for v in batch.column(batch.num_columns - 1).to_pylist()]
                columns = [pa.array(c, pa.binary()) for c in zip(*made)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *outputs])

    return df.select(*keep, df[source].alias("_source")).mapInArrow(trimmed(run), schema)


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4", copy=False).tobytes()


def encode(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep + ids: the token ids, packed as little-endian unsigned 32-bit integers."""
    return _mapped(docs, keep, text_col, ["ids"], ranks, pattern, lambda coder, text: (_packed(coder.encode(text or "")),))


def decode(tokens: DataFrame, ranks: bytes, pattern: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """keep + decoded: the bytes behind packed ids."""
    return _mapped(tokens, keep, ids_col, ["decoded"], ranks, pattern,
                   lambda coder, ids: (coder.decode(np.frombuffer(ids or b"", "<u4")),))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep + ids + decoded in one pass: the packed ids of each text, and the bytes that they decode to."""

    def work(coder: TreeCodec, text: str | None):
        ids = coder.encode(text or "")
        return _packed(ids), coder.decode(ids)

    return _mapped(docs, keep, text_col, ["ids", "decoded"], ranks, pattern, work)
