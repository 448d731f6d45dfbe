import random
import re
from collections import defaultdict

import pytest

from objtrail.llm import ngram_join


def brute(rows):
    """component by comparing all pairs of sets of word tuples."""
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets[i] = frozenset(grams)
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and both:
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=140):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for base in range(n // 14):
        text = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        if base % 3 == 0:
            text += passage
        for _ in range(14):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


EDGES = [
    (1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"),
    (1006, "a b c d e"), (1007, "A\tB C d\ne"), (1008, "É b c d e"), (1009, "é b c d e"), (1010, "a b c d e f"),
]


def test_matches_all_pairs(docs):
    rows = corpus(1) + EDGES
    assert got(ngram_join.ngram_classes(docs(rows))) == brute(rows)


def test_long_lists_in_tiles(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 1)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 900)
    rows = corpus(2)
    assert got(ngram_join.ngram_classes(docs(rows))) == brute(rows)


def test_order_of_shingles_does_not_matter(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    rows = corpus(3, 70)
    assert got(ngram_join.ngram_classes(docs(rows))) == brute(rows)


def test_empty_and_unlinked(docs):
    assert ngram_join.ngram_classes(docs([])).collect() == []
    assert got(ngram_join.ngram_classes(docs([(5, "a b c d e f"), (6, "")]))) == {5: (2, 5), 6: (0, 6)}


def test_repeated_and_missing_ids(docs):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f")]
    found = ngram_join.ngram_classes(docs(rows)).collect()
    assert {r.component_id for r in found} == {3}
    assert len(found) == 4


def brute_by_id(rows):
    """Links of all texts of an id: sets that share an id are linked as well."""
    classes = brute([(k, t) for k, (_, t) in enumerate(rows)])
    ids = [i for i, _ in rows]
    label = {k: c for k, (n, c) in classes.items() if n}
    for _ in rows:
        for k in label:
            same = {label[j] for j in label if ids[j] == ids[k]} | {label[k]}
            label = {j: min(same) if c in same else c for j, c in label.items()}
    low = {c: min(ids[j] for j in label if label[j] == c) for c in label.values()}
    return sorted((ids[k], classes[k][0], low[label[k]] if k in label else ids[k]) for k in classes)


def test_sets_of_a_repeated_id_are_linked(docs):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "x y z w v u"), (9, "x y z w v u"), (12, "k l m n o p"), (12, "q r s t u v")]
    rows += [(20 + i % 7, t) for i, (_, t) in enumerate(corpus(5, 28))]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(docs(rows)).collect())
    assert found == brute_by_id(rows)


def test_lists_of_common_shingles_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for seed in (7, 8):
            rows = corpus(seed, 112)
            assert got(ngram_join.ngram_classes(docs(rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lists_over_many_batches(spark, docs):
    rows = corpus(6, 112)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert got(ngram_join.ngram_classes(docs(rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("size", range(1, 60))
def test_prefix_length_is_safe(size):
    need = ngram_join.required(size, 80)
    assert 100 * need >= 80 * size > 100 * (need - 1)


def test_positions_filter_keeps_similar_pairs():
    import numpy as np

    for a in range(1, 40):
        for b in range(a, 50):
            for both in range(1, a + 1):
                if 100 * both >= 80 * (a + b - both):
                    # the first shared element can stand no later than this
                    assert ngram_join._within(a, a - both, np.array([b]), np.array([b - both]), 80).all()


def test_many_copies_make_one_node(docs):
    rows = [(i, "a b c d e f g") for i in range(300)] + [(900, "z y x w v")]
    found = defaultdict(list)
    for r in ngram_join.ngram_classes(docs(rows)).collect():
        found[r.component_id].append(r.doc_id)
    assert {k: len(v) for k, v in found.items()} == {0: 300, 900: 1}
