"""A log as a folder of six tables: Parquet, or CSV with nested columns as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objtrail.frames import OcelFrames
from objtrail.operators.normalize import ordered as in_order
from objtrail.schema import SCHEMAS, configure


def write_bundle(log: OcelFrames, path: str, mode: str = "errorifexists", ordered: bool = False) -> None:
    """Six Parquet folders; ``ordered`` sorts each by its canonical keys, by range."""
    for name, df in log.tables():
        out = in_order(df, name) if ordered else df
        out.write.mode(mode).parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str) -> OcelFrames:
    configure(spark)
    return OcelFrames(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})


def _nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.ArrayType)


def write_csv(log: OcelFrames, path: str, mode: str = "errorifexists") -> None:
    """Six CSV folders; texts are always quoted, so empty ones stay apart from nulls."""
    for name, df in log.tables():
        flat = df.select(*[F.to_json(f.name).alias(f.name) if _nested(f) else F.col(f.name) for f in SCHEMAS[name]])
        writer = flat.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
        writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(f"{path}/{name}")


def read_csv(spark: SparkSession, path: str) -> OcelFrames:
    configure(spark)
    tables: dict[str, DataFrame] = {}
    for name, schema in SCHEMAS.items():
        plain = T.StructType([T.StructField(f.name, T.StringType() if _nested(f) else f.dataType) for f in schema])
        reader = spark.read.schema(plain).option("header", True).option("escape", '"').option("multiLine", True)
        rows = reader.option("emptyValue", "").option("nullValue", "\x00").option(
            "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
        ).csv(f"{path}/{name}")
        tables[name] = rows.select(
            *[F.from_json(f.name, f.dataType).alias(f.name) if _nested(f) else F.col(f.name) for f in schema]
        )
    return OcelFrames(**tables)
