"""Row types of the six tables of a log, and the session settings they rely on."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: Time 0: the time of an object attribute's initial value.
OCEL_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

# fixed values: the primitive value types and the payload field of each
PAYLOAD = {"string": "s", "time": "t", "integer": "i", "float": "f", "boolean": "b"}
VALUE_TYPES = tuple(PAYLOAD)

#: A text without any character that is not white space, as Python's str.strip() sees it.
BLANK = r"(?U)^[\x1c-\x1f\s]*$"

VALUE = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("t", T.TimestampType()),
        T.StructField("i", T.DecimalType(38, 0)),
        T.StructField("f", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
    ]
)
DECLARATION = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
EVENT_ATTR = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", VALUE)])
OBJECT_ATTR = T.StructType([*EVENT_ATTR.fields, T.StructField("time", T.TimestampType())])


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TYPES = _table(name=T.StringType(), attributes=T.ArrayType(DECLARATION))
SCHEMAS = {
    "event_types": _TYPES,
    "object_types": _TYPES,
    "events": _table(
        id=T.StringType(), type=T.StringType(), time=T.TimestampType(), attributes=T.ArrayType(EVENT_ATTR)
    ),
    "objects": _table(id=T.StringType(), type=T.StringType(), attributes=T.ArrayType(OBJECT_ATTR)),
    "e2o": _table(event=T.StringType(), object=T.StringType(), qualifier=T.StringType()),
    "o2o": _table(source=T.StringType(), target=T.StringType(), qualifier=T.StringType()),
}
ISSUE = _table(
    code=T.StringType(), message=T.StringType(), level=T.StringType(), at=T.ArrayType(T.StringType(), False)
)


def configure(spark: SparkSession) -> SparkSession:
    """Instants print and parse in UTC; nothing is cast silently."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    return spark


def plain(kind: T.DataType) -> str:
    """A type's text without nullability, for comparison."""
    return kind.simpleString()
