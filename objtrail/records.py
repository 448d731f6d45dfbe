"""Plain records for small logs written in Python.

Each record checks its own shape when made.  Large logs come as DataFrames and
are checked by ``operators.shape``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone
from decimal import Decimal
from enum import Enum
from math import isfinite
from typing import Any


#: what an attribute may hold
Value = str | datetime | int | float | bool


class ValueType(str, Enum):
    """Primitive attribute types."""

    STRING = "string"
    TIME = "time"
    INTEGER = "integer"
    FLOAT = "float"
    BOOLEAN = "boolean"


def _string(x: object, at: str) -> None:
    if not isinstance(x, str):
        raise TypeError(f"{at} must be a string")


def _text(x: object, at: str) -> None:
    _string(x, at)
    if not x.strip():
        raise ValueError(f"{at} must not be empty")


def _instant(x: object, at: str) -> None:
    if not isinstance(x, datetime):
        raise TypeError(f"{at} must be a datetime")
    if x.utcoffset() is None:
        raise ValueError(f"{at} must include timezone information")


def _value(x: object, at: str) -> None:
    match x:
        case datetime():
            _instant(x, at)
        case bool() | int() | str():
            pass
        case float():
            if not isfinite(x):
                raise ValueError(f"{at} must be finite")
        case _:
            raise TypeError(f"{at} must be str, datetime, int, float, or bool; got {type(x).__name__}")


def _value_type(x: object, at: str) -> None:
    if not isinstance(x, ValueType):
        raise TypeError(f"{at} must be ValueType")


def _many(kind: type, what: str | None = None, key: Callable[[Any], object] | None = None) -> Callable[[object, str], None]:
    def rule(x: object, at: str) -> None:
        if type(x) is not tuple and not isinstance(x, tuple):
            raise TypeError(f"{at} must be a tuple")
        for item in x:
            if not isinstance(item, kind):
                raise TypeError(f"every item in {at} must be {kind.__name__}")
        if key is not None and len({key(item) for item in x}) < len(x):
            raise ValueError(f"{at.split('.')[0]} {what} must not contain duplicates")

    return rule


def _is(rule: Callable[[object, str], None], **more: Any) -> Any:
    return field(metadata={"rule": rule}, **more)


class _Checked:
    __slots__ = ()

    def __post_init__(self) -> None:
        for f in fields(self):
            f.metadata["rule"](getattr(self, f.name), f"{type(self).__name__}.{f.name}")


def _by_name(item: Any) -> object:
    return item.name


@dataclass(frozen=True, slots=True)
class Attribute(_Checked):
    name: str = _is(_text)
    type: ValueType = _is(_value_type)


@dataclass(frozen=True, slots=True)
class EventType(_Checked):
    name: str = _is(_text)
    attributes: tuple[Attribute, ...] = _is(_many(Attribute, "attribute names", _by_name), default=())


@dataclass(frozen=True, slots=True)
class ObjectType(_Checked):
    name: str = _is(_text)
    attributes: tuple[Attribute, ...] = _is(_many(Attribute, "attribute names", _by_name), default=())


@dataclass(frozen=True, slots=True)
class EventAttr(_Checked):
    name: str = _is(_text)
    value: Value = _is(_value)


@dataclass(frozen=True, slots=True)
class ObjectAttr(_Checked):
    name: str = _is(_text)
    value: Value = _is(_value)
    time: datetime = _is(_instant)


@dataclass(frozen=True, slots=True)
class Event(_Checked):
    id: str = _is(_text)
    type: str = _is(_text)
    time: datetime = _is(_instant)
    attributes: tuple[EventAttr, ...] = _is(_many(EventAttr, "attribute names", _by_name), default=())


@dataclass(frozen=True, slots=True)
class Object(_Checked):
    id: str = _is(_text)
    type: str = _is(_text)
    attributes: tuple[ObjectAttr, ...] = _is(
        _many(ObjectAttr, "attribute assignments", lambda a: (a.name, a.time)), default=()
    )


@dataclass(frozen=True, slots=True)
class E2O(_Checked):
    event: str = _is(_text)
    object: str = _is(_text)
    qualifier: str = _is(_string)


@dataclass(frozen=True, slots=True)
class O2O(_Checked):
    source: str = _is(_text)
    target: str = _is(_text)
    qualifier: str = _is(_string)


@dataclass(frozen=True, slots=True)
class OCEL(_Checked):
    """A small log as records, in the order given."""

    event_types: tuple[EventType, ...] = _is(_many(EventType), default=())
    object_types: tuple[ObjectType, ...] = _is(_many(ObjectType), default=())
    events: tuple[Event, ...] = _is(_many(Event), default=())
    objects: tuple[Object, ...] = _is(_many(Object), default=())
    e2o: tuple[E2O, ...] = _is(_many(E2O), default=())
    o2o: tuple[O2O, ...] = _is(_many(O2O), default=())


RECORDS = {
    "event_types": EventType,
    "object_types": ObjectType,
    "events": Event,
    "objects": Object,
    "e2o": E2O,
    "o2o": O2O,
}


def tagged(x: object) -> tuple:
    """A value as the row (tag, s, t, i, f, b)."""
    match x:
        case datetime():
            return ("time", None, x, None, None, None)
        case bool():
            return ("boolean", None, None, None, None, x)
        case int():
            if abs(x) >= 10**38:
                raise ValueError("unsupported: integer of more than 38 digits")
            return ("integer", None, None, Decimal(x), None, None)
        case float():
            return ("float", None, None, None, x, None)
        case _:
            return ("string", x, None, None, None, None)


def as_row(record: Any) -> tuple:
    """A record as the row of its table."""
    cells = []
    for f in fields(record):
        x = getattr(record, f.name)
        if f.name == "attributes":
            cells.append([as_row(item) for item in x])
        elif f.name == "value":
            cells.append(tagged(x))
        else:
            cells.append(x.value if isinstance(x, Enum) else x)
    return tuple(cells)


def untagged(v: Any) -> Value:
    """The value of a tagged row."""
    match v.tag:
        case "time":
            return _utc(v.t)
        case "integer":
            return int(v.i)
        case "float":
            return v.f
        case "boolean":
            return v.b
        case _:
            return v.s


def _utc(x: datetime) -> datetime:
    """An instant as Spark collects it, without a zone in the machine's own, in UTC."""
    return x.astimezone(timezone.utc)


_ITEMS = {"event_types": Attribute, "object_types": Attribute, "events": EventAttr, "objects": ObjectAttr}


def as_record(table: str, row: Any) -> Any:
    """The record of a table's row."""

    def cell(name: str, x: Any) -> Any:
        match name:
            case "attributes":
                kind = _ITEMS[table]
                return tuple(kind(*[cell(f.name, item[f.name]) for f in fields(kind)]) for item in x)
            case "value":
                return untagged(x)
            case "time":
                return _utc(x)
            case "type" if table in ("event_types", "object_types"):
                return ValueType(x)
            case _:
                return x

    kind = RECORDS[table]
    return kind(*[cell(f.name, row[f.name]) for f in fields(kind)])
