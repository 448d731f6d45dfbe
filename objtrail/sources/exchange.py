"""Import of the three exchange formats of object-centric logs: JSON, XML, SQLite.

Values are read as the type their entity type declares for them.  A value that
does not read as its declared type, or has none, stays a string, and the
validator then says so; nothing is dropped.  Times without a zone are read as
UTC, and that is listed as evidence.
"""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.functions.values import (
    boolean_value,
    float_value,
    integer_value,
    string_value,
    time_value,
)
from objtrail.operators.validate import BROADCAST_TYPES
from objtrail.schema import SCHEMAS, configure

# fixed values: spellings of the value types
ALIASES = {
    "string": "string", "str": "string", "text": "string", "varchar": "string",
    "time": "time", "date": "time", "datetime": "time", "timestamp": "time",
    "integer": "integer", "int": "integer", "bigint": "integer", "long": "integer",
    "float": "float", "double": "float", "real": "float", "number": "float",
    "boolean": "boolean", "bool": "boolean",
}
#: bytes of a JSON document or SQLite file that is read as one
MAX_DOCUMENT = 1 << 30
MODES = ("strict", "recover", "inspect")
_ZONE = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"


@dataclass(frozen=True)
class ImportResult:
    """status (valid, recovered, invalid, unsupported), the log, and evidence rows (kind, subject, detail)."""

    status: str
    log: OcelFrames | None
    evidence: DataFrame | None
    assumptions: tuple[str, ...] = field(default=("times without a zone are UTC",))


def _declared(c: Column) -> Column:
    """A declared type in its canonical spelling, or as it is."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(known[F.lower(c)], c)


def instant(c: Column) -> Column:
    return F.try_to_timestamp(F.when(c.rlike(_ZONE), c).otherwise(F.concat(c, F.lit("Z"))))


def typed(text: Column, kind: Column) -> Column:
    """A text as the tagged value of a declared type, or as a string."""
    number = text.rlike(r"^[+-]?\d+$")
    as_int, as_float, as_time = text.try_cast("decimal(38,0)"), text.try_cast("double"), instant(text)
    finite = as_float.isNotNull() & ~F.isnan(as_float) & (F.abs(as_float) != float("inf"))
    return (
        F.when((kind == "integer") & number & as_int.isNotNull(), integer_value(as_int))
        .when((kind == "float") & finite, float_value(as_float))
        .when((kind == "boolean") & F.lower(text).isin("true", "false"), boolean_value(F.lower(text) == "true"))
        .when((kind == "time") & as_time.isNotNull(), time_value(as_time))
        .otherwise(string_value(text))
    )


def _types(rows: DataFrame) -> DataFrame:
    item = F.coalesce("attributes", F.array().cast("array<struct<name:string,type:string>>"))
    return rows.select("name", F.transform(item, lambda a: F.struct(a["name"].alias("name"), _declared(a["type"]).alias("type"))).alias("attributes"))


def _with_types(entities: DataFrame, types: DataFrame, timed: bool) -> DataFrame:
    """Raw attributes (name, value text, time text) as tagged values."""
    # of a type declared twice no declaration is preferred: its values stay strings, and the validator reports the type
    kinds = types.groupBy(F.col("name").alias("_type")).agg(F.count("*").alias("_n"), F.first("attributes").alias("_fields"))
    kinds = kinds.select("_type", F.when(F.col("_n") == 1, F.col("_fields")).alias("_fields"))
    kinds = F.broadcast(kinds) if types.count() <= BROADCAST_TYPES else kinds
    joined = entities.join(kinds, entities["type"] == kinds["_type"], "left")

    def read(a: Column) -> Column:
        kind = F.get(F.filter("_fields", lambda d: d["name"] == a["name"]), 0)["type"]
        cells = [a["name"].alias("name"), typed(a["value"], F.coalesce(kind, F.lit("string"))).alias("value")]
        if timed:
            epoch = F.timestamp_seconds(F.lit(0))
            cells.append(F.coalesce(instant(a["time"]), epoch).alias("time"))
        return F.struct(*cells)

    given = F.coalesce("attributes", F.array().cast(entities.schema["attributes"].dataType))
    return joined.withColumn("attributes", F.transform(given, read)).drop("_type", "_fields")


def _relations(rows: DataFrame, child: str, names: tuple[str, str]) -> DataFrame:
    exploded = rows.select(F.col("id").alias(names[0]), F.explode("relationships").alias("r"))
    return exploded.select(names[0], F.col(f"r.{child}").alias(names[1]), F.coalesce("r.qualifier", F.lit("")).alias("qualifier"))


def _assemble(
    event_types: DataFrame, object_types: DataFrame, events: DataFrame, objects: DataFrame, child: str, mode: str,
    corrupt: list[DataFrame],
) -> ImportResult:
    """events, objects: id, type, time text, attributes, relationships.

    An attribute of an object without a time holds from the epoch on and a relation
    without a qualifier has an empty one; both are evidence, as are times without a zone.
    """
    event_types, object_types = _types(event_types), _types(object_types)
    log = OcelFrames(
        event_types=event_types,
        object_types=object_types,
        events=_with_types(events.withColumn("time", instant(F.col("time"))), event_types, False),
        objects=_with_types(objects, object_types, True),
        e2o=_relations(events, child, ("event", "object")),
        o2o=_relations(objects, child, ("source", "target")),
    )
    unread = events.where(F.col("time").isNotNull() & instant(F.col("time")).isNull())
    naive = events.where(instant(F.col("time")).isNotNull() & ~F.col("time").rlike(_ZONE))
    given = objects.select("id", F.explode("attributes").alias("a")).select("id", F.col("a.name").alias("name"), F.col("a.time").alias("time"))
    lost = [
        (unread, "unreadable_time"),
        (events.where("time IS NULL"), "missing_time"),
        (given.where(F.col("time").isNotNull() & instant(F.col("time")).isNull()), "unreadable_time"),
    ]
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), F.col("id").alias("subject"), detail.alias("detail"))
    errors = reduce(DataFrame.unionByName, [*[row(df, kind, F.col("time")) for df, kind in lost], *corrupt])
    # what is read in one way though the source leaves it open
    noted = row(naive, "time_without_zone", F.col("time"))
    zoneless = given.where(instant(F.col("time")).isNotNull() & ~F.col("time").rlike(_ZONE))
    noted = noted.unionByName(row(zoneless, "time_without_zone", F.col("time")))
    noted = noted.unionByName(row(given.where("time IS NULL"), "attribute_without_time", F.col("name")))
    for df in (events, objects):
        bare = df.select("id", F.explode("relationships").alias("r")).where("r.qualifier IS NULL")
        noted = noted.unionByName(row(bare, "relation_without_qualifier", F.col(f"r.{child}")))
    evidence = errors.unionByName(noted)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "inspect":
        return ImportResult("invalid" if not errors.isEmpty() else "valid", None, evidence)
    broken = not errors.isEmpty()
    if broken and mode == "strict":
        return ImportResult("invalid", None, evidence)
    return ImportResult("recovered" if broken or not noted.isEmpty() else "valid", log, evidence)


_ATTRIBUTES = "array<struct<name:string,type:string>>"
_JSON = (
    f"objectTypes array<struct<name:string,attributes:{_ATTRIBUTES}>>, eventTypes array<struct<name:string,attributes:{_ATTRIBUTES}>>, "
    "objects array<struct<id:string,type:string,attributes:array<struct<name:string,value:string,time:string>>,"
    "relationships:array<struct<objectId:string,qualifier:string>>>>, "
    "events array<struct<id:string,type:string,time:string,attributes:array<struct<name:string,value:string>>,"
    "relationships:array<struct<objectId:string,qualifier:string>>>>, _corrupt_record string"
)


def _size(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of the largest file, from the listing."""
    listed = spark.read.format("binaryFile").load(path).select("length")
    return listed.agg(F.max("length").alias("n")).first().n or 0


def read_json(spark: SparkSession, path: str | list[str], mode: str = "strict", lines: bool = False) -> ImportResult:
    """JSON documents, each a whole log or a part of one.

    With ``lines`` every line is a document, so files are split over tasks and a log may
    have any size: one line may hold one event.  Without, a file is one document and
    one task's row; files over ``MAX_DOCUMENT`` bytes are refused.
    """
    configure(spark)
    if not lines and (size := _size(spark, path)) > MAX_DOCUMENT:
        return ImportResult("unsupported", None, None, (f"a document of {size} bytes: write it as lines, one event or object each",))
    # texts parsed by an expression: the file source does not read its corrupt records alone
    read = F.from_json("value", _JSON, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    texts = spark.read.option("wholetext", not lines).text(path).where("trim(value) <> ''")
    raw = texts.select(read.alias("d")).select("d.*")
    corrupt = raw.where("_corrupt_record IS NOT NULL").select(
        F.lit("unreadable_document").alias("kind"), F.lit(None).cast("string").alias("subject"), F.col("_corrupt_record").alias("detail")
    )
    part = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    return _assemble(part("eventTypes"), part("objectTypes"), part("events"), part("objects"), "objectId", mode, [corrupt])


def read_xml(spark: SparkSession, path: str, mode: str = "strict") -> ImportResult:
    """XML documents; a relation is a ``relationship`` or an ``object`` element.

    Elements that do not parse, and elements that begin but are not read to their end,
    are evidence; either makes a strict import invalid.
    """
    configure(spark)

    def rows(tag: str, schema: str) -> DataFrame:
        reader = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE")
        return reader.option("columnNameOfCorruptRecord", "_corrupt_record").schema(f"{schema}, _corrupt_record string").load(path)

    def unread(tag: str, read: DataFrame) -> DataFrame:
        """Evidence of corrupt elements, and of elements that began but were not read."""
        text = F.regexp_replace("value", "<!--.*?-->", "")
        begun = spark.read.text(path).agg(F.sum(F.regexp_count(text, F.lit(f"<{tag}\\s[^>]*?\\b(?:id|name)\\s*="))).alias("n"))
        counted = read.agg(F.count("*").alias("m"), F.count("_corrupt_record").alias("bad"))
        both = begun.join(F.broadcast(counted), F.lit(True)).where("coalesce(n, 0) > m - bad")
        detail = F.concat((F.col("m") - F.col("bad")).cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(f" {tag} elements read"))
        return both.select(F.lit("unreadable_document").alias("kind"), F.lit(None).cast("string").alias("subject"), detail.alias("detail"))

    corrupt = []

    fields = "attributes struct<attribute:array<struct<_name:string,_type:string>>>"
    link = "array<struct<`_object-id`:string,_qualifier:string>>"
    values = "attributes struct<attribute:array<struct<_name:string,_time:string,_VALUE:string>>>"
    inside = f"objects struct<relationship:{link},object:{link}>"

    def types(tag: str) -> DataFrame:
        read = rows(tag, f"_name string, {fields}").where("_name IS NOT NULL OR _corrupt_record IS NOT NULL")
        corrupt.append(unread(tag, read))
        return read.where("_name IS NOT NULL").select(
            F.col("_name").alias("name"),
            F.transform("attributes.attribute", lambda a: F.struct(a["_name"].alias("name"), a["_type"].alias("type"))).alias("attributes"),
        )

    def entities(tag: str, time: Column, timed: bool) -> DataFrame:
        read = rows(tag, f"_id string, _type string, _time string, {values}, {inside}")
        read = read.where("_id IS NOT NULL OR _corrupt_record IS NOT NULL")
        corrupt.append(unread(tag, read))
        read = read.where("_id IS NOT NULL")
        empty = F.array().cast(link)
        links = F.concat(F.coalesce("objects.relationship", empty), F.coalesce("objects.object", empty))

        def attribute(a: Column) -> Column:
            cells = [a["_name"].alias("name"), F.coalesce(a["_VALUE"], F.lit("")).alias("value")]
            return F.struct(*cells, *([a["_time"].alias("time")] if timed else []))

        return read.select(
            F.col("_id").alias("id"),
            F.col("_type").alias("type"),
            time.alias("time"),
            F.transform("attributes.attribute", attribute).alias("attributes"),
            F.transform(links, lambda r: F.struct(r["_object-id"].alias("objectId"), r["_qualifier"].alias("qualifier"))).alias("relationships"),
        )

    event_types, object_types = types("event-type"), types("object-type")
    events, objects = entities("event", F.col("_time"), False), entities("object", F.lit(None).cast("string"), True)
    return _assemble(event_types, object_types, events, objects, "objectId", mode, corrupt)


def read_sqlite(spark: SparkSession, path: str, mode: str = "strict") -> ImportResult:
    """A SQLite file, read by the driver alone: for logs that fit there.

    No JDBC driver for it comes with Spark; files over ``MAX_DOCUMENT`` bytes are refused,
    convert such logs to a bundle first.
    """
    configure(spark)
    if (size := os.path.getsize(path)) > MAX_DOCUMENT:
        return ImportResult("unsupported", None, None, (f"a file of {size} bytes: convert it to a bundle",))
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
        needed = {"event", "object", "event_object", "object_object", "event_map_type", "object_map_type"}
        if not needed <= names:
            return ImportResult("unsupported", None, None, (f"missing tables: {', '.join(sorted(needed - names))}",))

        def quoted(name: str) -> str:
            return '"' + name.replace('"', '""') + '"'

        def entities(kind: str) -> tuple[list, list]:
            types, rows = [], []
            of = dict(db.execute(f"SELECT ocel_id, ocel_type FROM {kind}"))
            for type_name, short in db.execute(f"SELECT ocel_type, ocel_type_map FROM {kind}_map_type").fetchall():
                table = f"{kind}_{short}"
                columns = db.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
                own = [(c[1], re.sub(r"\W.*", "", c[2]).lower() or "string") for c in columns if not c[1].startswith("ocel_")]
                types.append((type_name, own))
                heads = [c[1] for c in columns]
                seen: dict[str, list] = {}
                times: dict[str, str | None] = {}
                for row in db.execute(f"SELECT * FROM {quoted(table)}").fetchall():
                    cells = dict(zip(heads, row, strict=True))
                    time, changed = cells.get("ocel_time"), cells.get("ocel_changed_field")
                    times[cells["ocel_id"]] = time
                    items = seen.setdefault(cells["ocel_id"], [])
                    for name, _ in own:
                        if cells[name] is not None and (changed is None or changed == name):
                            items.append((name, str(cells[name]), time) if kind == "object" else (name, str(cells[name])))
                rows += [(i, of.get(i, type_name), times[i], items) for i, items in seen.items()]
            listed = {r[0] for r in rows}
            rows += [(i, t, None, []) for i, t in of.items() if i not in listed]
            return types, rows

        def links(table: str, a: str, b: str) -> dict[str, list]:
            found: dict[str, list] = {}
            for x, y, q in db.execute(f"SELECT {a}, {b}, ocel_qualifier FROM {table}").fetchall():
                found.setdefault(x, []).append((y, q))
            return found

        (event_types, events), (object_types, objects) = entities("event"), entities("object")
        e2o, o2o = links("event_object", "ocel_event_id", "ocel_object_id"), links("object_object", "ocel_source_id", "ocel_target_id")
    relation = "relationships array<struct<objectId:string,qualifier:string>>"
    make = lambda rows, item, rel: spark.createDataFrame(
        [(*r, rel.get(r[0], [])) for r in rows],
        f"id string, type string, time string, attributes array<struct<name:string,value:string{item}>>, {relation}",
    )

    def types_frame(rows: Iterable) -> DataFrame:
        return spark.createDataFrame(list(rows), SCHEMAS["event_types"])

    return _assemble(
        types_frame(event_types), types_frame(object_types), make(events, "", e2o), make(objects, ",time:string", o2o), "objectId", mode, [],
    )
