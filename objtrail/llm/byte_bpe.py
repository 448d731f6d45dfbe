"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings gives the id
of a pre-token that is itself in the vocabulary.  Tier two: any other pre-token
is a doubly linked list of bytes whose adjacent pairs wait in a heap by (rank,
place), so the lowest rank, leftmost first, merges next in O(n log n).
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries of a worker's cache; none has a key over ``CACHED_CHARS``
CACHE_LIMIT = 600_000
CACHED_CHARS = 48
_GAMMA = 2
_ALL = 2**64 - 1
_STEP = 0x9E3779B97F4A7C15
_MIX = 0xFF51AFD7ED558CCD


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a tiktoken rank file, in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    table = [b""] * len(pairs)
    for text, rank in pairs:
        table[int(rank)] = base64.b64decode(text)
    return table


class PerfectHash:
    """Minimal perfect hash of distinct byte strings, by cascaded bit arrays.

    At each level the keys that are still left hash into an array twice their
    number; those alone in their slot are settled there, the rest go on.  A key's
    index is the number of settled slots before its own, so n keys map onto
    0..n-1 exactly.  Foreign strings map anywhere; compare the key found.
    """

    def __init__(self, keys: list[bytes]) -> None:
        left = self.digests(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        before = 0
        while len(left):
            size = _GAMMA * len(left) + 1
            slots = self._slots(left, len(self.levels), size)
            alone = np.bincount(slots, minlength=size) == 1
            rank = before + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            before += int(alone.sum())
            left = left[~alone[slots]]
            if len(self.levels) > 64:
                raise ValueError("two keys share their digest")
        self.size = before
        # plain sequences, for look-ups one at a time
        self.plain = [(len(alone), alone.tobytes(), rank.tolist()) for alone, rank in self.levels]

    @staticmethod
    def digests(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    @staticmethod
    def _slots(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (digests ^ np.uint64(_STEP * (level + 1) & _ALL)) * np.uint64(_MIX)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
        return ((x >> np.uint64(20)) % np.uint64(size)).astype(np.int64)

    def index(self, key: bytes) -> int:
        """Index of a key, or -1 where no level can hold it."""
        digest = xxhash.xxh3_64_intdigest(key)
        for level, (size, alone, rank) in enumerate(self.plain):
            x = ((digest ^ (_STEP * (level + 1) & _ALL)) * _MIX) & _ALL
            x = ((x ^ (x >> 32)) * _MIX) & _ALL
            slot = (x >> 20) % size
            if alone[slot]:
                return rank[slot]
        return -1


class _Learnt(dict):
    """A dict that asks ``learn`` for a missing key; it forgets all when full and keeps no long keys."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        value = self.learn(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHE_LIMIT:
                self.clear()
            self[key] = value
        return value


class ByteCoder:
    """Encoder and decoder of one vocabulary; ids are cached by chunk of text.

    A single space between two characters other than white space always begins a
    pre-token, so texts are cut there, and only there, for caching.
    """

    #: white space next to a space, or at an end of the text; \s here knows more than the pattern's, which is safe
    _BESIDE = re.compile(r" \s|\s | \Z")
    _CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, table: list[bytes], pattern: str, perfect: PerfectHash | None = None) -> None:
        self.table = table
        self.ranks = {t: i for i, t in enumerate(table)}
        self.pairs = [-1] * 65536
        for i, t in enumerate(table):
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = i
        self.pattern = regex.compile(pattern)
        self.perfect = perfect or PerfectHash(table)
        self.ids = [0] * len(table)
        for i, t in enumerate(table):
            self.ids[self.perfect.index(t)] = i
        self.known = _Learnt(self._chunk)

    def encode(self, text: str) -> np.ndarray:
        if "\0" in text or self._BESIDE.search(text):
            chunks = self._CUT.split(text)
        else:
            chunks = text.replace(" ", "\0 ").split("\0")
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), dtype="<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk; a pre-token is matched again as itself, so one cache holds both."""
        parts = self.pattern.findall(chunk)
        return self._token(chunk) if len(parts) == 1 else b"".join([self.known[t] for t in parts])

    def _token(self, token: str) -> bytes:
        body = token.encode("utf-8", "surrogatepass")
        at = self.perfect.index(body)
        found = [self.ids[at]] if at >= 0 and self.table[self.ids[at]] == body else self._merge(body)
        return pack_ids("<%di" % len(found), *found)

    def _merge(self, body: bytes) -> list[int]:
        """Heap-driven merges over a linked list of byte spans.

        A span ends where the next begins.  ``rank[i]`` is that of the pair of
        spans that begins at i; heap entries, rank * n + i, of other ranks are stale.
        """
        ranks, pairs, n = self.ranks, self.pairs, len(body)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [pairs[x << 8 | y] for x, y in zip(body, body[1:])]
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        rank.append(-1)
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            rank[i] = rank[j] = -1
            if k < n:
                before[k] = i
                r = ranks.get(body[i : after[k]])
                if r is not None:
                    rank[i] = r
                    heapq.heappush(heap, r * n + i)
            h = before[i]
            if h >= 0:
                r = ranks.get(body[h:k])
                if r is None:
                    rank[h] = -1
                else:
                    rank[h] = r
                    heapq.heappush(heap, r * n + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[body[i : after[i]]])
            i = after[i]
        return out


@lru_cache(maxsize=2)
def byte_coder(vocabulary: str, pattern: str) -> ByteCoder:
    """One coder a worker process, so that its caches outlive a task."""
    return ByteCoder(read_ranks(vocabulary), pattern)


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decode_too: bool = False,
) -> DataFrame:
    """doc_id, ids (array<int>) and, with ``decode_too``, the decoded bytes.

    Null and empty texts have no ids.  Each row stands alone: repeated rows give
    repeated results, an empty table an empty one, other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    if decode_too:
        fields.append(("decoded", pa.binary()))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(vocabulary, pattern)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(names), 512):
                ids = [coder.encode(t or "") for t in texts[at : at + 512]]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                cols = [
                    pa.array(names[at : at + 512], type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))),
                ]
                if decode_too:
                    cols.append(pa.array([coder.decode(x) for x in ids], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    out = "doc_id long, ids array<int>" + (", decoded binary" if decode_too else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of arrays of ids; null arrays decode to nothing."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_ranks(vocabulary)
        for batch in batches:
            rows = [b"".join(map(table.__getitem__, r or ())) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.binary())], schema=schema)

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, decoded binary")
