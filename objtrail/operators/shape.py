"""Local shape rules of rows, as one query that lists violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.schema import BLANK, PAYLOAD, VALUE_TYPES

# fixed values: the record that a table's rows stand for
RECORD_OF = {
    "event_types": "EventType",
    "object_types": "ObjectType",
    "events": "Event",
    "objects": "Object",
    "e2o": "E2O",
    "o2o": "O2O",
}
_TEXTS = {
    "event_types": ("name",),
    "object_types": ("name",),
    "events": ("id", "type"),
    "objects": ("id", "type"),
    "e2o": ("event", "object"),
    "o2o": ("source", "target"),
}
_ITEM = {"event_types": "Attribute", "object_types": "Attribute", "events": "EventAttr", "objects": "ObjectAttr"}


def _found(bad: Column, error: str, field: str, message: str) -> Column:
    """An array with the violation, or an empty one."""
    hit = F.struct(F.lit(field).alias("field"), F.lit(error).alias("error_class"), F.lit(f"{field} {message}").alias("message"))
    return F.when(F.coalesce(bad, F.lit(False)), F.array(hit)).otherwise(
        F.array().cast("array<struct<field:string,error_class:string,message:string>>")
    )


def _text(c: Column, field: str) -> list[Column]:
    return [
        _found(c.isNull(), "TypeError", field, "must be a string"),
        _found(c.rlike(BLANK), "ValueError", field, "must not be empty"),
    ]


def _payload_fits(v: Column) -> Column:
    """Exactly the payload that the tag names is there."""
    fits = F.lit(False)
    for tag, name in PAYLOAD.items():
        others = [v[o].isNull() for o in PAYLOAD.values() if o != name]
        fits = fits | ((v["tag"] == tag) & v[name].isNotNull() & reduce(lambda a, b: a & b, others))
    return F.coalesce(fits, F.lit(False))


def _not_finite(v: Column) -> Column:
    return F.coalesce(F.isnan(v["f"]) | (F.abs(v["f"]) == float("inf")), F.lit(False))


def _attributes(table: str) -> list[Column]:
    record, item, items = RECORD_OF[table], _ITEM[table], F.col("attributes")

    def some(bad) -> Column:
        return F.exists(items, lambda a: F.coalesce(bad(a), F.lit(False)))

    rules = [
        _found(items.isNull(), "TypeError", f"{record}.attributes", "must be an array"),
        _found(some(lambda a: a.isNull()), "TypeError", f"{record}.attributes", "must not hold null"),
        _found(some(lambda a: a.isNotNull() & a["name"].isNull()), "TypeError", f"{item}.name", "must be a string"),
        _found(some(lambda a: a["name"].rlike(BLANK)), "ValueError", f"{item}.name", "must not be empty"),
    ]
    keys = F.transform(items, lambda a: a["name"])
    what = "attribute names"
    if item == "Attribute":
        bad_type = some(lambda a: a.isNotNull() & ~F.coalesce(a["type"].isin(*VALUE_TYPES), F.lit(False)))
        rules.append(_found(bad_type, "TypeError", "Attribute.type", "must be ValueType"))
    else:
        rules.append(
            _found(
                some(lambda a: a.isNotNull() & ~_payload_fits(a["value"])),
                "TypeError",
                f"{item}.value",
                "must be str, datetime, int, float, or bool",
            )
        )
        rules.append(_found(some(lambda a: _not_finite(a["value"])), "ValueError", f"{item}.value", "must be finite"))
    if item == "ObjectAttr":
        bad_time = some(lambda a: a.isNotNull() & a["time"].isNull())
        rules.append(_found(bad_time, "TypeError", "ObjectAttr.time", "must be a datetime"))
        keys = F.transform(items, lambda a: F.struct(a["name"], a["time"]))
        what = "attribute assignments"
    twice = F.size(F.array_distinct(keys)) < F.size(keys)
    return [*rules, _found(twice, "ValueError", f"{record} {what}", "must not contain duplicates")]


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("v")))


def _numbered_violations(log: OcelFrames) -> DataFrame:
    """rank (table, rule), table, field, error_class, message: one row per row and rule broken."""
    parts = []
    for number, (table, df) in enumerate(log.tables()):
        record = RECORD_OF[table]
        rules = [r for c in _TEXTS[table] for r in _text(F.col(c), f"{record}.{c}")]
        if table in ("e2o", "o2o"):
            rules.append(_found(F.col("qualifier").isNull(), "TypeError", f"{record}.qualifier", "must be a string"))
        if table == "events":
            rules.append(_found(F.col("time").isNull(), "TypeError", "Event.time", "must be a datetime"))
        if table in _ITEM:
            rules += _attributes(table)
        ranked = [_ranked(r, 100 * number + k) for k, r in enumerate(rules)]
        parts.append(df.select(F.explode(F.concat(*ranked)).alias("x")).select("x.rank", F.lit(table).alias("table"), "x.v.*"))
    return reduce(DataFrame.unionByName, parts)


def shape_violations(log: OcelFrames) -> DataFrame:
    """table, field, error_class, message: one row per row and rule broken.

    A narrow pass over each table, without any shuffle.
    """
    return _numbered_violations(log).drop("rank")


def require_shape(log: OcelFrames) -> None:
    """Raise the first violation, by table and rule, as the exception it names."""
    first = F.min(F.struct("rank", "error_class", "message")).alias("first")
    bad = _numbered_violations(log).agg(first).first().first
    if bad is not None:
        raise {"TypeError": TypeError, "ValueError": ValueError}[bad.error_class](bad.message)
