"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine c or more are within squared distance 2 - 2c.  A fixed
random rotation spreads that distance over the coordinates; the rotated vectors
are split into blocks, and in at least one block two such vectors are within
their proportional share of the budget.  Each block is range-joined on its own:
its leading coordinate cuts it into strips as wide as the block's radius, so
partners lie in the same or the next strip, and a strip with many vectors is
cut into tiles of bounded size.  Tasks hold two tiles, compute distances within
the block, and verify what falls within its budget on the whole vectors in double
precision.  A pair is reported by the first block that finds it, so numbers of
links add up without pairs being gathered, and a task returns counts and a
spanning forest of its links instead of the links.

Strip tables have at most 2 / width + 3 rows a block, whatever the input, since
unit vectors' coordinates lie within -1..1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objtrail.operators.components import connected_components
from objtrail.llm.shared import Scratch, store

COSINE = 0.9
BLOCKS = 4
#: vectors of a tile; a task holds two tiles, about 20 bytes a component each
TILE = 16384
_CHUNK = 1024
_SLACK = 1e-4
_SEED = 20240607


@lru_cache(maxsize=8)
def rotation(width: int) -> np.ndarray:
    """A fixed random rotation of that many dimensions; a worker process makes it once."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _cuts(width: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, width, min(blocks, width) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, against overflow."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _strips(nodes: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """A row per node (key, weight, raw) and block, with the strip of its leading coordinate."""
    value = pa.float32() if nodes.schema["raw"].dataType.elementType.typeName() == "float" else pa.float64()
    schema = pa.schema([(c, pa.int64()) for c in ("width", "key", "weight", "block", "strip")] + [("raw", pa.list_(value))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for n in np.unique(widths).tolist():
                rows = batch.filter(pa.array(widths == n))
                flat = rows.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                turned = _unit(flat.reshape(rows.num_rows, n)) @ rotation(n).T
                for k, (lo, hi) in enumerate(_cuts(n, blocks)):
                    radius = np.sqrt((2 - 2 * cosine) * (hi - lo) / n) + _SLACK
                    strip = np.floor(turned[:, lo] / radius).astype(np.int64)
                    same = np.ones(rows.num_rows, dtype=np.int64)
                    cols = [same * n, rows.column(0), rows.column(1), same * k, strip, rows.column(2)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(cols, schema, strict=True)],
                        schema=schema,
                    )

    kind = nodes.schema["raw"].dataType.simpleString()
    return nodes.select("key", "weight", "raw").mapInArrow(
        run, f"width long, key long, weight long, block long, strip long, raw {kind}"
    )


def _links(table: pa.Table, cosine: float, blocks: int) -> pa.Table:
    """Link counts (kind 0: node a, n in b) and forest edges (kind 1: a, b) of one pair of tiles."""
    block = table.column("block")[0].as_py()
    node, weight = table.column("key").to_numpy(), table.column("weight").to_numpy()
    flat = table.column("raw").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    unit = _unit(flat.astype(np.float64).reshape(len(node), -1))
    left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
    right = table.column("right").to_numpy(zero_copy_only=False).astype(bool)
    turned = unit @ rotation(unit.shape[1]).T
    cuts = _cuts(unit.shape[1], blocks)
    budgets = [(2 - 2 * cosine) * (hi - lo) / unit.shape[1] + _SLACK**2 + 1e-9 for lo, hi in cuts]
    lo, hi = cuts[block]
    low = turned[:, lo:hi].astype(np.float32)
    norm = (low * low).sum(axis=1, keepdims=True)
    # one product gives all squared distances: |x|^2 + |y|^2 - 2 x.y
    one = np.ones_like(norm)
    rows, columns = np.hstack([low, norm, one]), np.ascontiguousarray(np.hstack([-2 * low, one, norm]).T)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    same = len(a) == len(b) and (a == b).all()
    count = np.zeros(len(node))
    parent = np.arange(len(node))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for at in range(0, len(a), _CHUNK):
        i = a[at : at + _CHUNK]
        for bt in range(at if same else 0, len(b), _CHUNK):
            j = b[bt : bt + _CHUNK]
            near = rows[i] @ columns[:, j] <= budgets[block] + 1e-4
            if same and at == bt:
                near = np.triu(near, 1)
            if not near.any():
                continue
            x, y = np.divmod(np.flatnonzero(near), len(j))
            for part in range(0, len(x), 50_000):
                p, q = i[x[part : part + 50_000]], j[y[part : part + 50_000]]
                ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                p, q = p[ok], q[ok]
                first = np.ones(len(p), dtype=bool)
                gap = (turned[p] - turned[q]) ** 2
                for k in range(block):
                    first &= gap[:, cuts[k][0] : cuts[k][1]].sum(axis=1) > budgets[k]
                mine = gap[:, lo:hi].sum(axis=1) <= budgets[block]
                p, q = p[first & mine], q[first & mine]
                count += np.bincount(p, weights=weight[q], minlength=len(node))
                count += np.bincount(q, weights=weight[p], minlength=len(node))
                root = np.fromiter(map(find, range(len(node))), dtype=np.int64) if len(p) > len(node) else None
                if root is not None:
                    new = root[p] != root[q]
                    p, q = p[new], q[new]
                for s, t in zip(p.tolist(), q.tolist(), strict=True):
                    u, v = find(s), find(t)
                    if u != v:
                        parent[u] = v
                        edges.append((node[s], node[t]))
    some = np.flatnonzero(count)
    m = len(some)
    return pa.table(
        {
            "kind": pa.array([0] * m + [1] * len(edges), type=pa.int64()),
            "a": pa.array([*node[some].tolist(), *(int(e[0]) for e in edges)], type=pa.int64()),
            "b": pa.array([*map(int, count[some].tolist()), *(int(e[1]) for e in edges)], type=pa.int64()),
        }
    )


def embedding_classes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    blocks: int = BLOCKS,
    tile: int = TILE,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Vectors of cosine ``cosine`` or more are linked, so are copies; ``n_links``
    counts other rows linked directly, ``component_id`` is the smallest id
    reachable.  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; vectors of different widths do not link.  Rows
    that repeat an id count each other as links when their vectors link.  An
    empty table gives an empty result; other columns are ignored.

    Identical vectors are one node with a weight from the start, by map-side
    partial counts, and only nodes are joined.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("raw"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.size("raw") > 0) & ~bad & F.exists("raw", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    scratch = Scratch()
    nodes = scratch.store(
        rows.where("usable")
        .groupBy("raw")
        .agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
        .withColumn("key", F.monotonically_increasing_id()),
        "nodes",
    )
    strips = scratch.store(_strips(nodes, cosine, blocks), "strips")
    found = scratch.store(
        _dealt(strips, tile, scratch)
        .groupBy("width", "block", "s", "i", "j", "own")
        .applyInArrow(lambda table: _links(table, cosine, blocks), "kind long, a long, b long"),
        "links",
    )
    label = connected_components(found.where("kind = 1").select("a", "b"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("partners"))
    placed = (
        nodes.join(label.withColumnRenamed("node", "key"), "key", "left")
        .join(counts, "key", "left")
        .select(
            "raw", "low", F.coalesce("component", "key").alias("component"),
            (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).cast("long").alias("n_links"),
        )
    )
    placed = scratch.store(placed, "placed")
    names = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    # all that the result reads besides the vectors
    known = store(placed.join(names, "component").select("raw", "n_links", "component_id"), "classes")
    scratch.drop()
    linked = rows.where("usable").join(known, "raw").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        "*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _dealt(strips: DataFrame, tile: int, scratch: Scratch) -> DataFrame:
    """Every node's copies for the pairs of tiles it takes part in.

    Strip s meets itself (own) and strip s + 1.  Pair (s, i, j, own) holds tiles i
    and j of strip s; (s, i, j, not own) holds tile i of strip s and j of strip s + 1.
    """
    at = ["width", "block", "strip"]
    tiles = scratch.store(
        strips.groupBy(*at).agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles")), "tiles"
    )
    above = tiles.select("width", "block", (F.col("strip") - 1).alias("strip"), F.col("tiles").alias("above"))
    below = tiles.select("width", "block", (F.col("strip") + 1).alias("strip"), F.col("tiles").alias("below"))
    for other in (above, below):
        tiles = tiles.join(other, at, "left")
    dealt = strips.join(F.broadcast(tiles), at).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")))

    def partners(n: str, pair) -> F.Column:
        many = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1), pair)
        return F.filter(many, lambda _: F.col(n).isNotNull())

    def entry(s, i, j, left, right, own) -> F.Column:
        return F.struct(
            s.alias("s"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"), F.lit(own).alias("own")
        )

    strip, mine, yes, no = F.col("strip"), F.col("tile"), F.lit(True), F.lit(False)
    pairs = F.concat(
        partners("tiles", lambda o: entry(strip, F.least(mine, o), F.greatest(mine, o), mine <= o, mine >= o, True)),
        partners("above", lambda o: entry(strip, mine, o, yes, no, False)),
        partners("below", lambda o: entry(strip - 1, o, mine, no, yes, False)),
    )
    return dealt.select("width", "block", "key", "weight", "raw", F.explode(pairs).alias("p")).select(
        "width", "block", "p.*", "key", "weight", "raw"
    )
