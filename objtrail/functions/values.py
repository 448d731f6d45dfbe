"""Tagged values and the keys that order them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from objtrail.schema import PAYLOAD, VALUE


def value(tag: str, payload: Column) -> Column:
    """A tagged value; the payload must already have the tag's own type."""
    fields = [F.lit(tag).alias("tag")]
    for name in VALUE.names[1:]:
        kind = VALUE[name].dataType
        fields.append((payload if PAYLOAD[tag] == name else F.lit(None)).cast(kind).alias(name))
    return F.struct(*fields)


def string_value(c: Column) -> Column:
    return value("string", c)


def time_value(c: Column) -> Column:
    return value("time", c)


def integer_value(c: Column) -> Column:
    return value("integer", c)


def float_value(c: Column) -> Column:
    return value("float", c)


def boolean_value(c: Column) -> Column:
    return value("boolean", c)


def time_key(c: Column) -> Column:
    """ISO text of an instant in UTC with microseconds; the session zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def float_hex(c: Column) -> Column:
    """A double's hexadecimal text with 13 digits of mantissa and a signed exponent."""
    h = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("toHexString"), c)
    sign = F.when(h.startswith("-"), "-").otherwise("")
    power = F.when(h.contains("p-"), "").otherwise("+")
    digits = F.rpad(F.regexp_extract(h, r"\.([0-9a-f]+)p", 1), 13, "0")
    full = F.concat(
        F.regexp_extract(h, r"^(-?0x[01]\.)", 1), digits, F.lit("p"), power, F.regexp_extract(h, r"p(.*)$", 1)
    )
    return F.when(c == 0, F.concat(sign, F.lit("0x0.0p+0"))).otherwise(full)


def value_key(v: Column) -> Column:
    """(tag, text) of a value: integers and floats order by their text, not their size."""
    tag = v["tag"]
    text = (
        F.when(tag == "time", time_key(v["t"]))
        .when(tag == "boolean", F.when(v["b"], "true").otherwise("false"))
        .when(tag == "integer", v["i"].cast("string"))
        .when(tag == "float", float_hex(v["f"]))
        .otherwise(v["s"])
    )
    return F.struct(tag.alias("tag"), text.alias("text"))
