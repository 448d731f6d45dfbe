import pytest

from objtrail.api import (
    E2O,
    O2O,
    Attribute,
    Event,
    EventAttr,
    EventType,
    Object,
    ObjectAttr,
    ObjectType,
    ValueType,
    frames,
    validate,
)
from tests.logs import NOON, valid_log

CREATE = EventType("create")


def issues(spark, **tables):
    return [(i.code, i.at, i.message) for i in validate(frames(spark, **tables)).collect()]


def codes(spark, **tables):
    return [x[0] for x in issues(spark, **tables)]


def test_valid_and_empty_logs(spark):
    assert codes(spark, **valid_log()) == []
    assert codes(spark) == []


def test_duplicate_types_and_ids_report_each_key_once(spark):
    found = issues(
        spark,
        event_types=[CREATE, CREATE, CREATE],
        object_types=[ObjectType("o"), ObjectType("o", (Attribute("a", ValueType.FLOAT),))],
        events=[Event("e", "create", NOON)] * 3,
        objects=[Object("x", "o")] * 2,
    )
    assert found == [
        ("duplicate_event_id", ("event", "e"), "Event id 'e' occurs more than once."),
        ("duplicate_event_type", ("event_type", "create"), "Event type 'create' is declared more than once."),
        ("duplicate_object_id", ("object", "x"), "Object id 'x' occurs more than once."),
        ("duplicate_object_type", ("object_type", "o"), "Object type 'o' is declared more than once."),
    ]


def test_undeclared_type_hides_attributes_and_counts_rows(spark):
    row = Event("e", "gone", NOON, (EventAttr("a", 1),))
    found = issues(spark, events=[row, row])
    assert [x[0] for x in found] == ["duplicate_event_id", "undeclared_event_type", "undeclared_event_type"]
    assert found[1][1] == ("event", "e", "type")
    assert found[1][2] == "Event 'e' refers to undeclared event type 'gone'."
    assert codes(spark, objects=[Object("o", "gone", (ObjectAttr("a", 1, NOON),))]) == ["undeclared_object_type"]


def test_undeclared_attribute_excludes_mismatch_and_counts_history(spark):
    assert issues(spark, event_types=[CREATE], events=[Event("e", "create", NOON, (EventAttr("a", 1),))]) == [
        (
            "undeclared_event_attribute",
            ("event", "e", "attribute", "a"),
            "Event 'e' has undeclared attribute 'a' for event type 'create'.",
        )
    ]
    later = NOON.replace(hour=13)
    history = (ObjectAttr("a", 1, NOON), ObjectAttr("a", "x", later))
    kinds = [ObjectType("o")]
    assert codes(spark, object_types=kinds, objects=[Object("x", "o", history)]) == ["undeclared_object_attribute"] * 2
    typed = [ObjectType("o", (Attribute("a", ValueType.FLOAT),))]
    assert codes(spark, object_types=typed, objects=[Object("x", "o", history)]) == ["object_attribute_type_mismatch"] * 2


@pytest.mark.parametrize(
    ("kind", "value", "actual"),
    [
        (ValueType.STRING, 1, "integer"),
        (ValueType.TIME, "2026-08-08T12:00:00Z", "string"),
        (ValueType.INTEGER, True, "boolean"),
        (ValueType.FLOAT, 1, "integer"),
        (ValueType.BOOLEAN, 1, "integer"),
        (ValueType.STRING, NOON, "time"),
        (ValueType.INTEGER, 1.0, "float"),
    ],
)
def test_types_match_exactly(spark, kind, value, actual):
    found = issues(
        spark,
        event_types=[EventType("t", (Attribute("a", kind),))],
        events=[Event("e", "t", NOON, (EventAttr("a", value),))],
    )
    assert found == [
        (
            "event_attribute_type_mismatch",
            ("event", "e", "attribute", "a"),
            f"Event 'e' attribute 'a' requires '{kind.value}' but contains '{actual}'.",
        )
    ]


def test_ambiguous_types_are_declared_but_have_no_schema(spark):
    types = [CREATE, EventType("create", (Attribute("a", ValueType.FLOAT),))]
    events = [Event("e", "create", NOON, (EventAttr("a", 1), EventAttr("b", 1)))]
    assert codes(spark, event_types=types, events=events) == ["duplicate_event_type"]


def test_dangling_ends_report_both_and_every_row(spark):
    assert issues(spark, e2o=[E2O("e", "o", "")]) == [
        ("dangling_e2o_event", ("e2o", "e", "o", ""), "E2O refers to unknown event 'e'."),
        ("dangling_e2o_object", ("e2o", "e", "o", ""), "E2O refers to unknown object 'o'."),
    ]
    twice = codes(spark, objects=[Object("o", "t")], object_types=[ObjectType("t")], e2o=[E2O("e", "o", "q")] * 2)
    assert twice == ["dangling_e2o_event", "dangling_e2o_event", "duplicate_e2o"]
    assert codes(spark, o2o=[O2O("a", "b", "q")]) == ["dangling_o2o_source", "dangling_o2o_target"]


def test_duplicate_ids_do_not_multiply_relation_issues(spark):
    found = codes(
        spark,
        event_types=[CREATE],
        events=[Event("e", "create", NOON)] * 3,
        e2o=[E2O("e", "missing", "q"), E2O("e", "missing", "r")],
    )
    assert found == ["dangling_e2o_object"] * 2 + ["duplicate_event_id"]


def test_duplicate_relations_and_qualifiers(spark):
    log = valid_log()
    log["e2o"] = [E2O("e1", "i1", "a"), E2O("e1", "i1", "b"), E2O("e1", "i1", " "), E2O("e1", "i1", "")]
    assert codes(spark, **log) == []
    log["e2o"] += [E2O("e1", "i1", "a")] * 2
    log["o2o"] = [O2O("i1", "i1", "q")] * 2
    found = issues(spark, **log)
    assert [x[0] for x in found] == ["duplicate_e2o", "duplicate_o2o"]
    assert found[0][2] == "E2O relation ('e1', 'i1', 'a') occurs more than once."


def test_report_does_not_depend_on_partitions(spark):
    tables = {"events": [Event(f"e{i % 7}", "t", NOON) for i in range(40)], "e2o": [E2O(f"e{i}", "o", "q") for i in range(20)]}
    base = frames(spark, **tables)
    other = frames(spark, **{n: getattr(base, n).repartition(5).orderBy(*reversed(getattr(base, n).columns[:2])) for n in tables})
    assert validate(base).collect() == validate(other).collect()


def test_only_logs_are_validated(spark):
    with pytest.raises(TypeError, match="ocel must be OCEL"):
        validate("log")
