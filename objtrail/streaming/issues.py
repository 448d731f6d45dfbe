"""Validation of unbounded input: the rules that look at one row at a time.

Undeclared types, undeclared attributes and mismatches depend on a row and the
declarations alone, so they hold for a stream as they do for a table, in append
mode and without state.  Dangling ends are checked against tables of ids that
are complete for the stream.  Duplicates are not monotone on unbounded input and
stay with the batch validator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from objtrail.operators.validate import counted_ids, entity_issues, relation_issues


def stream_entity_issues(entities: DataFrame, types: DataFrame, kind: str) -> DataFrame:
    """Issues of streaming events or objects (``kind``) against declared types."""
    return entity_issues(entities, types, kind)


def stream_relation_issues(relations: DataFrame, kind: str, ends: tuple[tuple[str, str, DataFrame], ...]) -> DataFrame:
    """Dangling ends of streaming relations; ends: column, noun, table of ids."""
    return relation_issues(relations, kind, tuple((column, noun, counted_ids(ids)) for column, noun, ids in ends))


def write_issues(issues: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append issues as Parquet, once each, until the input is used up."""
    return (
        issues.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
