import numpy as np
from pyspark.sql import types as T

from objtrail.llm.embedding_dedup import embedding_classes

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("key", T.LongType()),
        T.StructField("block", T.LongType()),
    ]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows):
    usable = {i: np.array(v, dtype=np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    units = {i: np.float32(v).astype(np.float64) / np.linalg.norm(np.float32(v).astype(np.float64)) for i, v in usable.items()}
    links = {i: [j for j in units if j != i and len(units[j]) == len(units[i]) and units[i] @ units[j] >= 0.9] for i in units}
    low = {i: i for i, _ in rows}
    for _ in rows:
        low |= {i: min([low[i], *(low[j] for j in links.get(i, []))]) for i in low}
    return {i: (len(links.get(i, [])), low[i], low[i] == i) for i, _ in rows}


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(16)
        rows += [base + rng.normal(0, s, 16) for s in (0, 0.05, 0.2, 0.3, 0.35, 0.4, 0.5)]
    rows += [rows[0], rows[0], 3 * rows[1], -rows[2]]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_matches_all_pairs(spark):
    rows = vectors(1)
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0, None] * 8), (204, [float("nan")] * 16), (205, [float("inf")] * 16), (206, [1.0, 2.0]), (207, [2.0, 4.0])]
    assert got(embedding_classes(frame(spark, rows))) == brute(rows)


def test_small_tiles_and_other_blocks(spark):
    rows = vectors(2)
    for blocks, tile in ((1, 5), (4, 7), (8, 1000)):
        assert got(embedding_classes(frame(spark, rows), blocks=blocks, tile=tile)) == brute(rows)


def test_empty_table(spark):
    assert embedding_classes(frame(spark, [])).collect() == []


def test_repeated_ids_count_each_other(spark):
    found = embedding_classes(frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.n_links) for r in found) == [(1, 1), (1, 1), (2, 0)]
