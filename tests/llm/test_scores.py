import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from objtrail.llm import quality, toxicity


def prose(rng, n):
    return " ".join(rng.choice(["la", "mora", "tiko", "sena", "ruvi", "pelo", "dano", "kise"]) + rng.choice("abcdefgh") for _ in range(n))


def labelled(n=400):
    rng, docs, labels = random.Random(7), [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        lines = [prose(rng, 12).capitalize() + "." for _ in range(rng.randint(1, 6))]
        if bad:
            lines = [rng.choice([x.upper() + "!!", " | ".join(x.split()), " ".join(w + "***" for w in x.split())]) for x in lines]
        if toxic:
            lines[0] += " " + rng.choice(["idiot", "scum", "zurkaba", "zurkino", "zurkelu"])
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, docs):
    rows, marks = labelled()
    frame, labels = docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in marks}
    scored = {r.doc_id: r.score for r in quality.quality_scores(frame, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scored[i] >= 0.5) == truth[i][0] for i in held]) > 0.97
    scored = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.5) == truth[i][1] for i in held]) > 0.95


def test_held_out_labels_are_not_read(spark, docs):
    rows, marks = labelled(200)
    flipped = [
        (i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t)
        for i, q, t in marks
    ]
    for module, run in ((quality, quality.quality_scores), (toxicity, toxicity.toxicity_scores)):
        a, b = (
            sorted(map(tuple, run(docs(rows), spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect()))
            for m in (marks, flipped)
        )
        assert a == b, module


def test_edge_texts_and_no_labels(spark, docs):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "word " * 40_000), (5, "x\n" * 3000), (5, "x"), (None, "you idiot")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        found = run(docs(rows), none).collect()
        assert len(found) == 7
        assert all(0 <= r.score <= 1 for r in found)
        assert run(docs([]), none).collect() == []
    assert toxicity.toxicity_scores(docs(rows), none).where("doc_id IS NULL").first().score > 0.5


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    count = np.array([1, 4, 3, 0 + 2])
    e, a = rng.normal(size=(10, 2)), rng.normal(size=(2, 2))
    marginal, pairs, log_z = quality.forward_backward(e, a, count)
    start, want_pairs, want_z = 0, np.zeros((2, 2)), 0.0
    for n in count:
        weights = {}
        for k in range(2**n):
            path = [(k >> b) & 1 for b in range(n)]
            weights[tuple(path)] = np.exp(sum(e[start + i, s] for i, s in enumerate(path)) + sum(a[s, t] for s, t in zip(path, path[1:])))
        z = sum(weights.values())
        want_z += np.log(z)
        for i in range(n):
            assert np.isclose(marginal[start + i, 1], sum(w for p, w in weights.items() if p[i]) / z)
        for p, w in weights.items():
            for s, t in zip(p, p[1:]):
                want_pairs[s, t] += w / z
        start += n
    assert np.allclose(pairs, want_pairs)
    assert np.isclose(log_z, want_z)


def test_long_chains_by_stretches():
    rng = np.random.default_rng(6)
    for n in (2, 3, 50, 1001):
        e, a = rng.normal(size=(n, 2)) * 3, rng.normal(size=(2, 2))
        want, _, _ = quality.forward_backward(e, a, np.array([n]))
        assert np.allclose(quality.long_marginals(e, a), want)


def test_texts_of_many_lines(monkeypatch):
    rows, marks = labelled(200)
    model = quality.fit([t for _, t in rows], [q for _, q, _ in marks])
    texts = ["\n".join(t for _, t in rows[k : k + 60]) for k in range(0, 180, 20)] + ["a\n\n" * 50, "\n" * 80, ""]
    want = quality.score(model, texts)
    monkeypatch.setattr(quality, "STRETCH", 7)
    assert np.allclose(quality.score(model, texts), want)
    monkeypatch.undo()
    begin = time.perf_counter()
    quality.score(model, ["A line of words.\n" * 200_000])
    assert time.perf_counter() - begin < 20


def test_correlated_voters_share_their_weight():
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.3
    good = np.where(rng.random(3000) < 0.85, y, ~y) * 2.0 - 1
    weak = np.where(rng.random(3000) < 0.75, y, ~y) * 2.0 - 1
    votes = np.stack([good, weak, weak, weak], axis=1)
    model = toxicity.LabelModel(votes, y)
    assert model.accuracy[0] > model.accuracy[1] > 0.3
    assert model.correlation[1, 2] > 0.99
    assert model.weight[0] > model.weight[1:].sum() * 0.8


def test_posterior_matches_brute_force():
    rng = np.random.default_rng(8)
    votes = rng.integers(-1, 2, size=(60, 5)).astype(float)
    model = toxicity.LabelModel(votes, rounds=3)
    for row, got in zip(votes, model.posterior(votes), strict=True):
        joint = []
        for c, prior in ((0, 1 - model.prior), (1, model.prior)):
            joint.append(prior * np.prod([model.rate[c, j, int(v) + 1] ** model.say[j] for j, v in enumerate(row)]))
        assert np.isclose(got, joint[1] / sum(joint))
    for j in range(5):
        say = 1 / sum(max(0.0, model.correlation[j, k]) ** 2 for k in range(5))
        assert np.isclose(model.say[j], say, rtol=1e-3)


def test_posteriors_not_labels_train_the_classifier():
    rows, marks = labelled(1200)
    texts, truth = [t for _, t in rows], np.array([t for _, _, t in marks])
    rng = np.random.default_rng(2)
    wrong = rng.random(len(truth)) < 0.1
    said = np.where(wrong, 1 - truth, truth)
    features = toxicity.Features(texts)
    model = toxicity.LabelModel(toxicity.Voters().votes(texts, features, said.astype(float)))
    assert ((model.rows > 0.5) == truth).mean() > 0.98 > (said == truth).mean()
    scorer = toxicity.Scorer(toxicity.fit(texts, said.tolist()))
    assert np.mean([(scorer.score(t) >= 0.5) == y for t, y in zip(texts, truth, strict=True)]) > 0.98


def test_a_row_does_not_vote_for_its_own_label():
    texts = [f"only{i} " * 3 for i in range(64)]
    labels = np.array([i % 2 for i in range(64)], dtype=float)
    features = toxicity.Features(texts)
    assert (toxicity.Voters().votes(texts, features, labels) <= 0).all()


def test_labels_with_clashing_columns(spark, docs):
    rows, marks = labelled(150)
    plain = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    clash = plain.withColumn("_id", F.lit("x")).withColumn("text", F.lit(1)).withColumn("_y", F.lit(None).cast("int")).withColumn("n", F.lit(0))
    frame = docs(rows).withColumn("_y", F.lit(3)).withColumn("score", F.lit("s")).withColumn("quality", F.lit(0))
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        assert sorted(run(frame, clash).collect()) == sorted(run(docs(rows), plain).collect())


def test_rules_of_the_split(spark):
    rows = spark.range(100).select(F.col("id"), quality.training_row("id").alias("q"), toxicity.training_row("id").alias("t")).collect()
    for r in rows:
        c = zlib.crc32(str(r.id).encode())
        assert (r.q, r.t) == (c % 3 != 1, c % 5 != 0)
