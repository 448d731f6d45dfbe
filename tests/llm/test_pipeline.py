"""The stages against brute force on a small corpus, and the registered queries' contracts."""

import random
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from objtrail.llm.oracles import ORACLES
from objtrail.llm.queries import QUERIES
from tests.llm.test_ngram_join import brute
from tests.llm.test_scores import labelled

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, marks = labelled(300)
    rng = random.Random(9)
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    rows += [(2000 + i, rows[i][1].rstrip(".") + " " + rng.choice(["tikob", "morac"]) + ".") for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), dict(rows)


def test_each_stage_does_its_part(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.collect()})
    quality, toxic, exact, near = kept[1:]
    assert 0.6 < len(quality) / len(kept[0]) < 0.9
    assert len(toxic) < len(quality)
    last = {}
    for i in sorted(toxic):
        last[texts[i]] = i
    assert exact == set(last.values())
    assert near == {i for i, (_, low) in brute([(i, texts[i]) for i in exact]).items() if i == low}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == near
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_are_decided_one_by_one(spark, folder):
    path, texts = folder
    some = list(texts.values())
    toxic = next(t for t in some if "idiot" in t)
    clean = [t for t in some if not any(w in t for w in ("idiot", "scum", "zurk")) and t.capitalize() == t and len(t) < 150][:3]
    rows = [(None, toxic), (None, clean[0]), (None, clean[0]), (7, clean[1]), (7, clean[1]), (7, toxic), (8, clean[1]), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], COLUMNS)
    got = {name: sorted(map(str, ((r.doc_id, r.text) for r in stage(spark, docs, path).collect()))) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert str((7, toxic)) not in got["toxicity"] and str((None, toxic)) not in got["toxicity"]
    assert str((7, clean[1])) in got["toxicity"] and str((None, clean[0])) in got["toxicity"]
    assert len(got["exact_dedup"]) == 4
    assert got["exact_dedup"] == sorted(map(str, ((7, toxic), (None, clean[0]), (8, clean[1]), (9, ""))))
    assert got["ngram_jaccard_join"] == sorted(map(str, ((7, toxic), (None, clean[0]), (7, clean[1]), (None, None), (9, ""))))


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).collect() == [], name


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "ngram_jaccard_join", "packing"]
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert set(__spark_entry__.queries()) >= {*QUERIES, "pipeline"}


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert Counter(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall()) == Counter(
        repr(tuple(r[c] for c in columns)) for r in df.collect()
    )
