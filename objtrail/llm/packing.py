"""Packing of token sequences into fixed windows, best-fit decreasing.

Overlong documents are first cut into full windows.  What is left of each
document is placed, longest first, into the open window whose remaining capacity
is the tightest that fits; a segment tree indexed by remaining capacity finds it
in O(log window).  Only lengths decide the placement, so token ids never move:
they are cut where they are made, and short rows go to the packers.

Pieces are dealt by a hash of their row, and equal rows by a hash of their number
among them, to shards of about ``SHARD_PIECES`` pieces, each packed on its own; a
shard leaves at most one poorly filled window, and its memory is bounded at every
input size, also where ids are missing or repeated.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objtrail.llm.shared import store

WINDOW = 2048
SHARD_PIECES = 4096
#: entries of each of a worker's two caches; none has a key over ``CACHED_CHARS``
CACHE_LIMIT = 600_000
CACHED_CHARS = 48
_LIMIT_BITS = 24


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


class WordPieces:
    """Ids by a tokenizers file, by way of caches of white-space chunks and words.

    No match of this kind of pre-tokenizer spans white space, so a text is the
    concatenation of its chunks.  A chunk not met before is cut into normalised
    words, and a word not met before is encoded by the tokenizer itself.  Only
    scripts whose characters all Unicode versions treat alike are cut here; a
    chunk with any other character goes to the tokenizer whole.  Literal added
    tokens in a text are ids of their own, as the library has it by default.
    """

    _SPACE = regex.compile(r"\p{White_Space}+")
    _ODD = regex.compile("[\x1c-\x1f]")
    _WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: letters and marks of Latin, Greek, Cyrillic, common punctuation, kana, CJK ideographs and Hangul
    _PLAIN = regex.compile(
        "[\x00-\u021f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u2010-\u2027\u2030-\u205e\u20a0-\u20ac\u3001-\u3003\u3008-\u3011"
        "\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
    )

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self.whole = Tokenizer.from_file(path)
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.added = {content: pack_ids("<I", number) for content, number in added.items()}
        self.literals = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        # words come normalised and cut: only the byte mapping and the merges are left
        steps = whole["pre_tokenizer"]["pretokenizers"]
        whole |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": steps[-1], "post_processor": None}
        self.tokenizer = Tokenizer.from_str(json.dumps(whole))
        self.words = _Learnt(self._word)
        self.chunks = _Learnt(self._chunk)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if any(map(text.__contains__, self.added)):
            parts = self.literals.split(text)
            return b"".join([self.added[p] if k % 2 else self._plain(p) for k, p in enumerate(parts)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        split = self._SPACE.split(text) if self._ODD.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, split))

    def _word(self, word: str) -> bytes:
        return self._ids(self.tokenizer, word)

    @staticmethod
    def _ids(tokenizer, text: str) -> bytes:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return pack_ids("<%dI" % len(ids), *ids)

    def _chunk(self, chunk: str) -> bytes:
        words = self.words
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return words[chunk]
        elif self._PLAIN.fullmatch(chunk):
            # character by character, as the tokenizer does: no final sigma
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        else:
            return self._ids(self.whole, chunk)
        return b"".join([words[w] for w in self._WORD.findall(chunk)])


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    """One coder a worker process, so that its caches outlive a task."""
    return WordPieces(path)


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[bytes], int] | None = None,
) -> DataFrame:
    """Cut every document's ids (and ``end_id``) into pieces of at most ``window``.

    Returns doc_id, start, length, doc_tokens and either ``ids`` (array<int>) or,
    when ``digest`` is given, ``digest`` of the piece's little-endian bytes, so
    that a caller who wants a checksum does not carry the ids.  Null text is
    empty and gives one piece that holds ``end_id`` alone.
    """
    value = pa.field("ids", pa.list_(pa.int32())) if digest is None else pa.field("digest", pa.int64())
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), value]
    )
    tail = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_pieces(vocabulary)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(names), 512):
                cols: list[list] = [[], [], [], [], []]
                for name, text in zip(names[at : at + 512], texts[at : at + 512], strict=True):
                    ids = coder.encode(text or "") + tail
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        row = digest(piece) if digest else np.frombuffer(piece, dtype="<i4")
                        for col, x in zip(cols, (name, start, len(piece) // 4, n, row), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema
                )

    out = f"doc_id long, start long, length long, doc_tokens long, {'ids array<int>' if digest is None else 'digest long'}"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, out)


class CapacityTree:
    """Segment tree over remaining capacities 0..window: which have open windows."""

    def __init__(self, window: int) -> None:
        self.leaves = 1
        while self.leaves < window + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.open[capacity].append(number)
        self._shift(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, number) of the tightest window that holds ``length``."""
        node, count = self.leaves + length, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        number = self.open[capacity].pop()
        self._shift(capacity, -1)
        return capacity, number

    def _shift(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item; ``lengths`` must be in descending order."""
    tree, bins, offsets, made = CapacityTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            capacity, number = window, made
            made += 1
        else:
            capacity, number = found
        bins.append(number)
        offsets.append(window - capacity)
        if capacity > length:
            tree.add(capacity - length, number)
    return bins, offsets


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Place pieces (doc_id, start, length and any other columns) into sequences.

    Adds ``sequence_id`` (unique over all shards), ``offset`` (gapless from 0 in
    each sequence) and ``padded_length`` (``window``, or the sequence's own
    length where that is a power of two).  The result depends on the rows alone,
    not on how they were partitioned: a shard is packed in the order of length,
    doc_id, start and a hash of the row, and which of equal rows comes first does
    not show.  An empty table gives an empty result.
    """
    table = store(pieces, "pieces")
    shards = max(1, -(-table.count() // shard_pieces))
    # equal rows are counted and dealt by their number, so that no shard gets them all
    dealt = (
        table.groupBy(*table.columns)
        .agg(F.count("*").alias("_n"))
        .withColumn("_row", F.xxhash64(*table.columns))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .withColumn("_shard", F.pmod(F.xxhash64("_row", "_copy"), F.lit(shards)).cast("long"))
        .drop("_n", "_copy")
    )

    def place(shard: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("_row", "ascending")]
        shard = shard.sort_by(order)
        number = shard.column("_shard")[0].as_py()
        lengths = shard.column("length").to_pylist()
        bins, offsets = best_fit_decreasing(lengths, window)
        bin_array = np.array(bins, dtype=np.int64)
        filled = np.bincount(bin_array, weights=lengths).astype(np.int64)[bin_array]
        exact = (filled & (filled - 1)) == 0
        return (
            shard.drop_columns(["_row", "_shard"])
            .append_column("sequence_id", pa.array((number << _LIMIT_BITS) + bin_array))
            .append_column("offset", pa.array(offsets, type=pa.int64()))
            .append_column("padded_length", pa.array(np.where(exact, filled, window)))
        )

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_shard").applyInArrow(
        place, f"{names}, sequence_id long, offset long, padded_length long"
    )
