"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objtrail.storage import Stored


def connected_components(edges: DataFrame, limit: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    Each round links all larger neighbours of a node to its smallest one, then all
    smaller ones, until nothing moves; rounds grow with the logarithm of the
    longest path.  Rounds are tables in the shared folder, so nothing is gathered
    on the driver and a lost executor repeats one round only.  ``rows``, where a bound of
    the edges is known, bounds the files of the first table.
    """
    once = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Stored(once, "edges", rows)
    mark = _mark(now.df)
    for _ in range(limit):
        if mark[0] == 0:
            break
        # a round adds no edges, so the count before it bounds the files
        new = Stored(_small_star(_large_star(now.df)), "edges", mark[0])
        new_mark = _mark(new.df)
        now.drop()
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("components did not settle")
    star = now.df
    roots = star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set, to see whether a round moved it."""
    digest = F.xxhash64("a", "b")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(digest).alias("x"), F.sum(digest % 1000003).alias("s")).first()
    return (row.n, row.x, row.s)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
