"""The corpus pipeline: quality, toxicity, exact and near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of ``docs``; the last returns the packed pieces.  ``run`` writes every stage's
result as Parquet in the shared folder and rereads it as the next one's input.

A filtering stage decides rows one by one, not by their ids: the classifiers are
columns over the text, and the dedup stages number the rows they read.  Rows that
repeat an id or have none are decided like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from objtrail.llm import exact_dedup, ngram_join, packing, quality, toxicity
from objtrail.llm.shared import load, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: None: learning and packing are beyond SQL; tests hold the stages against brute force
ORACLE_SQL: str | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores one half or more; a null text is scored like an empty one."""
    score = quality.quality_scorer(docs, load(spark, sf_dir, "labels"))
    return docs.where(score("text") >= 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier scores below one half."""
    score = toxicity.toxicity_scorer(docs, load(spark, sf_dir, "labels"))
    return docs.where(score("text") < 0.5)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of whole-row repeats one."""
    return exact_dedup.distinct_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id."""
    return ngram_join.one_of_each_class(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: one row per piece."""
    import public_tokenizers

    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, digest=zlib.crc32)
    return packing.pack(pieces.withColumnRenamed("digest", "ids_crc32"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
