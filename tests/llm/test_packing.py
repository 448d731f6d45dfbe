import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from objtrail.llm import packing

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def check_packed(rows, window):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    for parts in by_sequence.values():
        parts.sort()
        at = 0
        for offset, length, _ in parts:
            assert offset == at
            at += length
        assert at <= window
        assert {p for _, _, p in parts} == {at if at & (at - 1) == 0 else window}


def test_pieces_cover_documents_exactly(docs, tokenizer):
    rows = [(1, None), (2, ""), (3, "Hello, wörld! it's 2024"), (4, "word " * 5000), (5, "\x1c a"), (5, "\x1c a"), (None, "x")]
    got = packing.pack(packing.token_pieces(docs(rows), VOCABULARY, window=64), window=64).collect()
    check_packed(got, 64)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in rows[:4]:
        ids = [x for r in sorted(pieces[i], key=lambda r: r.start) for x in r.ids]
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert {r.doc_tokens for r in pieces[i]} == {len(ids)}
    assert len(pieces[5]) == 2


def test_digest_instead_of_ids(docs, tokenizer):
    row = packing.token_pieces(docs([(1, "abc def")]), VOCABULARY, digest=zlib.crc32).first()
    ids = [*tokenizer.encode("abc def", add_special_tokens=False).ids, 1]
    assert row.digest == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_result_does_not_depend_on_partitions(docs):
    rows = [(i, "word " * (i % 90)) for i in range(300)]
    a, b = (
        sorted(map(tuple, packing.pack(packing.token_pieces(docs(rows).repartition(n), VOCABULARY, window=64, digest=zlib.crc32), window=64, shard_pieces=100).collect()))
        for n in (2, 7)
    )
    assert a == b


def test_empty_table(docs):
    assert packing.pack(packing.token_pieces(docs([]), VOCABULARY, digest=zlib.crc32)).collect() == []


def slow_best_fit(lengths, window):
    room, bins = [], []
    for length in lengths:
        fits = [r for r in room if r >= length]
        if fits:
            best = min(fits)
            room.remove(best)
            room.append(best - length)
        else:
            room.append(window - length)
        bins.append(length)
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_decreasing_by_the_tree(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = packing.best_fit_decreasing(lengths, 37)
    filled = {}
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        assert filled.get(b, 0) == o
        filled[b] = o + n
    assert sorted(37 - x for x in filled.values()) == slow_best_fit(lengths, 37)


def test_caches_do_not_change_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_LIMIT", 5)
    coder, rng = packing.WordPieces(VOCABULARY), random.Random(4)
    alphabet = "ab' \n\t é1²\x1cΣς.don't I'LL　Ａ中é\u0085İ"
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_character_as_the_library(tokenizer):
    coder = packing.WordPieces(VOCABULARY)
    for cp in range(1, 0x20000):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            text = f"a{c}b1 {c}{c}' é{c}"
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(cp)


def test_literal_added_tokens_as_the_library(tokenizer):
    coder = packing.WordPieces(VOCABULARY)
    for text in ("hi <|endoftext|> there", "<|startoftext|>a<|endoftext|>", "<|endof text|>", "É<|endoftext|>\u0301x", "<|ENDOFTEXT|>"):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_missing_ids_do_not_share_a_shard(docs):
    rows = [(None, "word " * (i % 7)) for i in range(400)]
    a, b = (
        sorted(map(str, packing.pack(packing.token_pieces(docs(rows).repartition(n), VOCABULARY, window=64, digest=zlib.crc32), window=64, shard_pieces=50).collect()))
        for n in (2, 5)
    )
    assert a == b and len(a) == 400
    got = packing.pack(packing.token_pieces(docs(rows), VOCABULARY, window=64, digest=zlib.crc32), window=64, shard_pieces=50).collect()
    check_packed(got, 64)
    assert max(sum(r.sequence_id >> 24 == s for r in got) for s in range(8)) < 100


def test_little_padding():
    rng = random.Random(5)
    lengths = sorted((min(2047, int(rng.lognormvariate(5.5, 1))) or 1 for _ in range(4000)), reverse=True)
    bins, _ = packing.best_fit_decreasing(lengths, 2048)
    assert sum(lengths) / ((max(bins) + 1) * 2048) > 0.99
