"""Small logs for tests."""

from datetime import UTC, datetime, timedelta, timezone

from objtrail.api import (
    E2O,
    O2O,
    OCEL_EPOCH,
    Attribute,
    Event,
    EventAttr,
    EventType,
    Object,
    ObjectAttr,
    ObjectType,
    ValueType,
)

NOON = datetime(2026, 8, 8, 12, tzinfo=UTC)
SEOUL = timezone(timedelta(hours=9))


def valid_log() -> dict:
    """Every value type, a history, and a relation of each kind."""
    return {
        "event_types": [
            EventType(
                "pay",
                (
                    Attribute("amount", ValueType.FLOAT),
                    Attribute("count", ValueType.INTEGER),
                    Attribute("done", ValueType.BOOLEAN),
                    Attribute("due", ValueType.TIME),
                    Attribute("note", ValueType.STRING),
                ),
            )
        ],
        "object_types": [ObjectType("invoice", (Attribute("state", ValueType.STRING),))],
        "events": [
            Event(
                "e1",
                "pay",
                NOON,
                (
                    EventAttr("note", "it's"),
                    EventAttr("amount", 1.5),
                    EventAttr("count", 3),
                    EventAttr("done", True),
                    EventAttr("due", NOON),
                ),
            )
        ],
        "objects": [
            Object("i1", "invoice", (ObjectAttr("state", "paid", NOON), ObjectAttr("state", "open", OCEL_EPOCH))),
            Object("i2", "invoice"),
        ],
        "e2o": [E2O("e1", "i1", "pays")],
        "o2o": [O2O("i1", "i2", "follows"), O2O("i2", "i2", "self")],
    }
