"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objtrail.storage import ROWS_PER_FILE, Scratch, Stored, shared_folder, store

__all__ = ["ROWS_PER_FILE", "Scratch", "Stored", "labelled_sample", "load", "shared_folder", "small_or_shuffled", "store"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` when its counted rows are within ``limit``, else leave
    the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def labelled_sample(docs: DataFrame, labels: DataFrame, rule: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows (_id, _text, _y), by a hash of their ids.

    ``docs`` has _id and _text, ``labels`` has _id and _y with one row an id;
    ``rule`` over _id says which rows may be taken.  Ids are chosen on narrow
    tables; those few, bounded by ``max_rows``, are broadcast to the texts.
    """
    turn = [F.xxhash64("_id"), "_id"]
    chosen = labels.where(rule).join(docs.select("_id"), "_id", "left_semi").orderBy(*turn).limit(max_rows)
    return docs.join(F.broadcast(chosen), "_id").orderBy(*turn, "_text").limit(max_rows)
