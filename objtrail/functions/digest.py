"""Content digest of a log, independent of row order and partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.operators.normalize import normalized


def row_digests(log: OcelFrames) -> DataFrame:
    """table, digest: sha256 of each normalised row's JSON."""
    parts = [
        df.select(F.lit(name).alias("table"), F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256).alias("digest"))
        for name, df in normalized(log).tables()
    ]
    return reduce(DataFrame.unionByName, parts)


def content_digest(log: OcelFrames) -> DataFrame:
    """table, n_rows, digest: of the sorted row digests, through a fixed number of levels.

    Rows are dealt to buckets by their digest's leading digits, as many levels as
    keep a bucket small are folded; the result does not depend on how many rows a
    task holds.
    """
    rows = row_digests(log)
    counted = rows.groupBy("table", "digest").agg(F.count("*").alias("n"))
    leaf = counted.groupBy("table", F.substring("digest", 1, 6).alias("bucket")).agg(
        F.sum("n").alias("n"),
        F.sha2(
            F.array_join(F.array_sort(F.collect_list(F.concat("digest", F.lit(":"), F.col("n").cast("string")))), ","), 256
        ).alias("digest"),
    )
    for width in (4, 2, 0):
        leaf = leaf.groupBy("table", F.substring("bucket", 1, width).alias("bucket")).agg(
            F.sum("n").alias("n"),
            F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", F.lit("="), F.col("digest")))), ","), 256).alias("digest"),
        )
    return leaf.select("table", F.col("n").cast("long").alias("n_rows"), "digest")
