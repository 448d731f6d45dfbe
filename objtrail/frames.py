"""A log as six DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from objtrail.records import RECORDS, as_row
from objtrail.schema import SCHEMAS, plain


@dataclass(frozen=True)
class OcelFrames:
    """Six tables of fixed types; rows keep duplicates and have no order."""

    event_types: DataFrame
    object_types: DataFrame
    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame

    def __post_init__(self) -> None:
        for name, schema in SCHEMAS.items():
            df = getattr(self, name)
            if not isinstance(df, DataFrame):
                raise TypeError(f"{name} must be a DataFrame")
            for wanted in schema:
                if wanted.name not in df.columns:
                    raise TypeError(f"{name} must have a column {wanted.name}")
                found = plain(df.schema[wanted.name].dataType)
                if found != plain(wanted.dataType):
                    hint = "; naive timestamps need a recorded zone" if "timestamp_ntz" in found else ""
                    raise TypeError(f"{name}.{wanted.name} must be {plain(wanted.dataType)}, not {found}{hint}")
            if df.columns != schema.names:
                object.__setattr__(self, name, df.select(*schema.names))

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    def tables(self) -> Iterator[tuple[str, DataFrame]]:
        for name in SCHEMAS:
            yield name, getattr(self, name)


def to_frame(spark: SparkSession, name: str, items: DataFrame | Iterable[object]) -> DataFrame:
    """A table from a DataFrame, or from records, each iterable consumed once."""
    if isinstance(items, DataFrame):
        return items
    try:
        rows = list(items)
    except TypeError as odd:
        raise TypeError(f"{name} must be iterable") from odd
    kind = RECORDS[name]
    for row in rows:
        if not isinstance(row, kind):
            raise TypeError(f"every item in {name} must be {kind.__name__}")
    return spark.createDataFrame([as_row(r) for r in rows], SCHEMAS[name])


def frames(spark: SparkSession, **components: DataFrame | Iterable[object]) -> OcelFrames:
    """A log from DataFrames or records; tables left out are empty."""
    odd = set(components) - set(SCHEMAS)
    if odd:
        raise TypeError(f"no such table: {', '.join(sorted(odd))}")
    return OcelFrames(**{name: to_frame(spark, name, components.get(name, ())) for name in SCHEMAS})
