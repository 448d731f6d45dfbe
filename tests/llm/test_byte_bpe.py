import base64
import itertools
import random

import pytest

from objtrail.llm import byte_bpe

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
VOCABULARY = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_minimal_and_perfect():
    table = byte_bpe.read_ranks(VOCABULARY)
    perfect = byte_bpe.PerfectHash(table)
    assert sorted(map(perfect.index, table)) == list(range(len(table)))


def test_encodes_as_the_library(theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_LIMIT", 50)
    coder, rng = byte_bpe.ByteCoder(byte_bpe.read_ranks(VOCABULARY), public.PATTERN), random.Random(6)
    alphabet = "abcde' \n\t é1²中　\x00<|>Z\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    for text in [*texts, "", " ", "  a", "a ", "it's 'll", "\r\n a  b", "z" * 3000, "ab" * 2000]:
        ids = coder.encode(text)
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert coder.decode(ids).decode() == text


def test_mixed_white_space(theirs):
    coder = byte_bpe.ByteCoder(byte_bpe.read_ranks(VOCABULARY), public.PATTERN)
    for n in range(6):
        for chars in itertools.product("x \n\u00a0\u3000\x85\x1c", repeat=n):
            text = "".join(chars)
            assert coder.encode(text).tolist() == theirs.encode_ordinary(text), repr(text)


def test_every_character_as_the_library(theirs):
    coder = byte_bpe.ByteCoder(byte_bpe.read_ranks(VOCABULARY), public.PATTERN)
    for cp in range(1, 0x20000):
        if not 0xD800 <= cp < 0xE000:
            text = f"a{chr(cp)}b1 {chr(cp)}{chr(cp)}' é{chr(cp)} x"
            assert coder.encode(text).tolist() == theirs.encode_ordinary(text), hex(cp)


def test_long_chunks_are_not_cached(theirs):
    coder = byte_bpe.ByteCoder(byte_bpe.read_ranks(VOCABULARY), public.PATTERN)
    text = "short ones " + "ab" * 5000 + " " + "中文" * 100 + "." * 99
    assert coder.encode(text).tolist() == theirs.encode_ordinary(text)
    assert max(map(len, coder.known)) <= byte_bpe.CACHED_CHARS


def test_frames(docs, theirs):
    rows = [(1, None), (2, ""), (3, "hello  world"), (3, "hello  world"), (None, "x"), (4, "ab " * 3000)]
    coded = byte_bpe.encode(docs(rows), VOCABULARY, public.PATTERN, decode_too=True)
    got = sorted(((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in coded.collect()))
    assert got == sorted((i or 0, theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    back = byte_bpe.decode(coded.select("doc_id", "ids"), VOCABULARY).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.encode(docs([]), VOCABULARY, public.PATTERN).collect() == []
