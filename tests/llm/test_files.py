"""Tables of the dedup stages take few files, however many shuffle partitions there are."""

from pathlib import Path

import pytest

from objtrail import storage
from objtrail.llm import exact_dedup, ngram_join
from tests.llm.test_ngram_join import brute

PARTITIONS = 24


@pytest.fixture
def files(spark, monkeypatch):
    """Files of every stored table by its label, the most of each, without coalescing at run time."""
    most = {}
    init = storage.Stored.__init__

    def counted(self, df, label, *args, **kwargs):
        init(self, df, label, *args, **kwargs)
        n = len(list(Path(self.path.removeprefix("file:")).glob("part-*")))
        most[label] = max(n, most.get(label, 0))

    monkeypatch.setattr(storage.Stored, "__init__", counted)
    wanted = {
        "spark.sql.shuffle.partitions": str(PARTITIONS),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield most
    for k, v in before.items():
        spark.conf.set(k, v)


def test_no_checksum_files(spark):
    table = storage.Stored(spark.range(10), "numbers")
    names = [f.name for f in Path(table.path.removeprefix("file:")).iterdir()]
    assert names and all(n.startswith("part-") for n in names)
    assert sorted(r.id for r in table.df.collect()) == list(range(10))
    table.drop()
    assert not Path(table.path.removeprefix("file:")).exists()


def near(n):
    words = [f"w{i}" for i in range(40)]
    return [(k, " ".join([*words, *(f"x{k}y{i}" for i in range(3))])) for k in range(n)]


def alone(n, first):
    return [(first + k, " ".join(f"a{k}b{i}" for i in range(30))) for k in range(n)]


def test_exact_dedup(docs, files):
    rows = alone(60, 0) + [(100 + i, t) for i, t in alone(60, 0)]
    kept = exact_dedup.distinct_rows(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100, 160))
    assert kept.rdd.getNumPartitions() == files["gone"] == 1, files


def test_near_dedup(docs, files):
    rows = near(40) + alone(40, 100)
    classes = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(docs(rows)).collect()}
    assert classes == brute(rows)
    assert files["lists"] == files["edges"] == 1, files
