from datetime import datetime

import pytest
from pyspark.sql import functions as F

from objtrail.api import E2O, Event, EventAttr, EventType, Object, ObjectAttr, build, frames, require_shape, shape_violations
from objtrail.functions.digest import content_digest
from objtrail.functions.values import float_hex, time_key
from objtrail.operators.build import settled
from objtrail.operators.normalize import numbered, ordered, sort_event_attributes
from objtrail.records import Attribute, O2O, ObjectType, ValueType, tagged
from objtrail.schema import SCHEMAS
from tests.logs import NOON, SEOUL, valid_log


def test_valid_build_orders_nested_collections(spark):
    result = build(spark, **valid_log())
    assert result.valid
    assert result.ocel is result.candidate
    event = result.candidate.events.first()
    assert [a.name for a in event.attributes] == ["amount", "count", "done", "due", "note"]
    history = result.candidate.objects.where("id = 'i1'").first().attributes
    assert [a.value.s for a in history] == ["open", "paid"]


def test_reversed_generators_build_the_same(spark):
    log = valid_log()
    one = build(spark, **log)
    two = build(spark, **{k: (x for x in reversed(v)) for k, v in log.items()})
    for (name, a), (_, b) in zip(one.candidate.tables(), two.candidate.tables(), strict=True):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        assert ordered(a, name).collect() == ordered(b, name).collect()
    assert content_digest(one.candidate).orderBy("table").collect() == content_digest(two.candidate).orderBy("table").collect()


def test_instants_compare_across_zones(spark):
    there = NOON.astimezone(SEOUL)
    rows = build(spark, check_shape=True, events=[Event("e", "t", there, (EventAttr("a", there),))]).candidate.events
    got = rows.select(time_key(F.col("time")), time_key(F.get("attributes", 0)["value"]["t"])).first()
    assert tuple(got) == ("2026-08-08T12:00:00.000000+00:00",) * 2


def test_nothing_is_repaired(spark):
    event = Event(" e ", " t ", NOON, (EventAttr("n", 1),))
    result = build(spark, events=[event, event], e2o=[E2O(" e ", "gone", "q")] * 3)
    assert not result.valid
    assert result.ocel is None
    assert result.candidate.events.count() == 2
    assert result.candidate.e2o.count() == 3
    row = result.candidate.events.first()
    assert (row.id, row.type, row.attributes[0].value.tag, row.attributes[0].value.i) == (" e ", " t ", "integer", 1)


def test_wrong_components(spark):
    with pytest.raises(TypeError, match="every item in events must be Event"):
        build(spark, events=[Object("o", "t")])
    with pytest.raises(TypeError, match="events must be iterable"):
        build(spark, events=3)
    naive = spark.createDataFrame([("e", "t", datetime(2026, 1, 1), [])], "id string, type string, time timestamp_ntz, attributes array<int>")
    with pytest.raises(TypeError, match=r"events\.time must be timestamp"):
        build(spark, events=naive)


@pytest.mark.parametrize(
    ("make", "error", "text"),
    [
        (lambda: Event("", "t", NOON), ValueError, "Event.id must not be empty"),
        (lambda: Event("e", " \t", NOON), ValueError, "Event.type must not be empty"),
        (lambda: Event(1, "t", NOON), TypeError, "Event.id must be a string"),
        (lambda: Event("e", "t", datetime(2026, 1, 1)), ValueError, "must include timezone information"),
        (lambda: Event("e", "t", "now"), TypeError, "must be a datetime"),
        (lambda: Event("e", "t", NOON, [EventAttr("a", 1)]), TypeError, "must be a tuple"),
        (lambda: Event("e", "t", NOON, (1,)), TypeError, "every item in Event.attributes must be EventAttr"),
        (lambda: Event("e", "t", NOON, (EventAttr("a", 1),) * 2), ValueError, "Event attribute names must not contain duplicates"),
        (lambda: EventAttr("a", float("nan")), ValueError, "must be finite"),
        (lambda: EventAttr("a", None), TypeError, "got NoneType"),
        (lambda: EventAttr("a", {}), TypeError, "got dict"),
        (lambda: Attribute("a", "string"), TypeError, "Attribute.type must be ValueType"),
        (lambda: EventType("t", (Attribute("a", ValueType.FLOAT),) * 2), ValueError, "EventType attribute names"),
        (lambda: ObjectType("t", (Attribute("a", ValueType.FLOAT),) * 2), ValueError, "ObjectType attribute names"),
        (lambda: Object("o", "t", (ObjectAttr("a", 1, NOON), ObjectAttr("a", 2, NOON.astimezone(SEOUL)))), ValueError, "Object attribute assignments"),
        (lambda: E2O("e", "o", None), TypeError, "E2O.qualifier must be a string"),
        (lambda: O2O("", "o", ""), ValueError, "O2O.source must not be empty"),
    ],
)
def test_records_check_their_shape(make, error, text):
    with pytest.raises(error, match=text.replace(".", r"\.")):
        make()


def test_records_are_frozen():
    with pytest.raises(AttributeError):
        E2O("e", "o", "q").event = "x"


def test_frames_check_the_same_shapes(spark):
    value = "named_struct('tag', 'float', 's', cast(null as string), 't', cast(null as timestamp), 'i', cast(null as decimal(38,0)), 'f', {}, 'b', cast(null as boolean))"
    rows = spark.sql(
        f"""SELECT ' ' AS id, 't' AS type, timestamp '2026-01-01 00:00:00Z' AS time,
        array(named_struct('name', 'a', 'value', {value.format("double('NaN')")}), named_struct('name', 'a', 'value', {value.format('1.0D')})) AS attributes
        UNION ALL SELECT 'e', 't', cast(null as timestamp), array(named_struct('name', 'b', 'value', {value.format('cast(null as double)')}))"""
    )
    log = frames(spark, events=rows)
    found = {(r.field, r.error_class) for r in shape_violations(log).collect()}
    assert found == {
        ("Event.id", "ValueError"), ("EventAttr.value", "ValueError"), ("Event attribute names", "ValueError"),
        ("Event.time", "TypeError"), ("EventAttr.value", "TypeError"),
    }
    with pytest.raises((TypeError, ValueError)):
        require_shape(log)
    assert shape_violations(frames(spark, **valid_log())).isEmpty()


def test_order_numbers_are_gapless(spark):
    rows = spark.range(500).selectExpr("concat('e', id % 40) AS event", "concat('o', id % 7) AS object", "'q' AS qualifier")
    got = numbered(rows.repartition(6), "e2o").orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(1, 501))
    assert [(r.event, r.object) for r in got] == sorted((r.event, r.object) for r in got)


def test_float_hex_is_pythons(spark):
    xs = [0.0, -0.0, 1.0, -1.5, 0.1, 1e300, 5e-324, 2.2250738585072014e-308, 3.14, -1e-310, 1e22]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", float_hex(F.col("x")).alias("h")).collect()
    assert [r.h for r in rows] == [x.hex() for x in xs]


def test_schemas_are_complete():
    assert list(SCHEMAS) == ["event_types", "object_types", "events", "objects", "e2o", "o2o"]


def test_the_first_violation_is_that_of_the_first_table_and_rule(spark):
    shaped = lambda rows, table: spark.createDataFrame(rows, SCHEMAS[table]).repartition(3)
    broken = {
        "events": shaped([("", "t", NOON, []), ("e", " ", NOON, []), ("f", "t", None, [])], "events"),
        "o2o": shaped([(None, "b", "q")], "o2o"),
    }
    for _ in range(3):
        with pytest.raises(ValueError, match="Event.id must not be empty"):
            require_shape(frames(spark, **broken))
    broken["events"] = broken["events"].where("id <> '' AND type <> ' '")
    with pytest.raises(TypeError, match="Event.time must be a datetime"):
        require_shape(frames(spark, **broken))


def test_computed_tables_are_stored_and_scans_are_not(spark):
    log = frames(spark, **valid_log())
    kept = settled(log)
    assert all(a is b for (_, a), (_, b) in zip(log.tables(), kept.tables(), strict=True))
    doubled = frames(spark, **{**dict(log.tables()), "events": log.events.union(log.events)})
    stored = settled(doubled)
    assert stored.events.count() == 2 * log.events.count() and stored.events is not doubled.events
    assert {i.code for i in build(spark, **dict(doubled.tables())).report.collect()} == {"duplicate_event_id"}


def test_repeated_names_settle_by_their_value_key(spark):
    """Rows that no shape rule has passed: ties of names fall back to the value key."""
    value = lambda x: tagged(x)
    rows = [("e", "t", NOON, [("b", value(2)), ("a", value(10)), ("a", value(9)), ("a", value("z"))])]
    events = spark.createDataFrame(rows, SCHEMAS["events"])
    found = sort_event_attributes(events).first().attributes
    assert [(a.name, a.value.tag, a.value.i) for a in found] == [("a", "integer", 10), ("a", "integer", 9), ("a", "string", None), ("b", "integer", 2)]
