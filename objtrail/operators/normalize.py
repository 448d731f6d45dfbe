"""Normal form of a log: nested order, and keys that order its tables.

Instants are already UTC: a timestamp holds an instant, and the session zone
decides only how it prints.  Nested collections are sorted in the row, without a
shuffle.  Tables have no order; ``ordered`` gives one at the edge, where rows are
collected or written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.functions.values import time_key, value_key
from objtrail.records import OCEL, as_record
from objtrail.storage import store


def _sorted(items: Column, own: Callable[[Column], list[Column]], key: Callable[[Column], Column]) -> Column:
    """An array sorted by ``own`` fields of its elements, then by ``key``, elements unchanged.

    Shape rules make the own fields unique within a row, so the natural order of structs
    does; only where they repeat is the key, which costs more, computed at all.
    """
    plain = F.sort_array(F.transform(items, lambda a: F.struct(*[c.alias(f"k{i}") for i, c in enumerate(own(a))], a.alias("item"))))
    n = len(own(F.lit(None)))
    head = lambda x: F.struct(*[x[f"k{i}"].alias(f"k{i}") for i in range(n)])
    repeats = F.exists(
        F.zip_with(plain, F.slice(plain, 2, F.size(plain)), lambda x, y: y.isNotNull() & (head(x) == head(y))),
        lambda same: F.coalesce(same, F.lit(False)),
    )
    keyed = F.sort_array(
        F.transform(items, lambda a: F.struct(*[c.alias(f"k{i}") for i, c in enumerate(own(a))], key(a).alias("key"), a.alias("item")))
    )
    return F.when(repeats, F.transform(keyed, lambda x: x["item"])).otherwise(F.transform(plain, lambda x: x["item"]))


def sort_type_attributes(types: DataFrame) -> DataFrame:
    """Declarations by (name, type)."""
    return types.withColumn("attributes", F.sort_array("attributes"))


def sort_event_attributes(events: DataFrame) -> DataFrame:
    """Attributes by (name, value key)."""
    return events.withColumn(
        "attributes", _sorted(F.col("attributes"), lambda a: [a["name"]], lambda a: value_key(a["value"]))
    )


def sort_object_history(objects: DataFrame) -> DataFrame:
    """Assignments by (name, time, value key)."""
    return objects.withColumn(
        "attributes", _sorted(F.col("attributes"), lambda a: [a["name"], a["time"]], lambda a: value_key(a["value"]))
    )


def normalized(log: OcelFrames) -> OcelFrames:
    """The same rows with their nested collections in order; nothing is repaired."""
    return OcelFrames(
        event_types=sort_type_attributes(log.event_types),
        object_types=sort_type_attributes(log.object_types),
        events=sort_event_attributes(log.events),
        objects=sort_object_history(log.objects),
        e2o=log.e2o,
        o2o=log.o2o,
    )


def order_keys(table: str) -> list[Column]:
    """Keys that order a normalised table totally, but for rows of equal content."""
    attributes = F.col("attributes") if table in ("event_types", "object_types", "events", "objects") else None
    if table in ("event_types", "object_types"):
        return [F.col("name"), attributes]
    if table == "events":
        signature = F.transform(attributes, lambda a: F.struct(a["name"], value_key(a["value"])))
        return [F.col("id"), F.col("type"), time_key(F.col("time")), signature]
    if table == "objects":
        signature = F.transform(
            attributes, lambda a: F.struct(a["name"], time_key(a["time"]), value_key(a["value"]))
        )
        return [F.col("id"), F.col("type"), signature]
    return [F.col(c) for c in (("event", "object") if table == "e2o" else ("source", "target"))] + [F.col("qualifier")]


def ordered(df: DataFrame, table: str) -> DataFrame:
    """A normalised table in canonical order: a range-partitioned sort."""
    keys = order_keys(table)
    names = [f"_k{i}" for i in range(len(keys))]
    return df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)]).orderBy(*names).drop(*names)


def records(log: OcelFrames, limit: int = 100_000) -> OCEL:
    """A small log as records, normalised and in canonical order; more than ``limit`` rows are refused."""
    found = {}
    for table, df in normalized(log).tables():
        rows = ordered(df, table).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{table} has more than {limit} rows; read it as a DataFrame")
        found[table] = tuple(as_record(table, row) for row in rows)
    return OCEL(**found)


def numbered(df: DataFrame, table: str) -> DataFrame:
    """``ord``: each row's place (from 1) in the canonical order, without one task for all.

    Rows are dealt by range, sorted and stored with their place in their partition;
    the sizes of the partitions before, one number a partition, give the rest.
    """
    keys = [k.alias(f"_k{i}") for i, k in enumerate(order_keys(table))]
    names = [f"_k{i}" for i in range(len(keys))]
    placed = (
        df.select("*", *keys)
        .repartitionByRange(*names)
        .sortWithinPartitions(*names)
        .withColumn("_id", F.monotonically_increasing_id())
        .drop(*names)
    )
    placed = store(placed, f"ordered-{table}").withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(before), "_part").withColumn("ord", place.cast("long")).drop("_part", "_id", "_before")
