"""Registered queries against their SQL, at the smallest scale."""

from collections import Counter
from pathlib import Path

import pytest

from objtrail.plans.oracles import ORACLES
from objtrail.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert Counter(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
    assert want or name == "r_warnings"


def test_every_key_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
