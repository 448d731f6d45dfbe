import json
import sqlite3

import pytest

from objtrail.api import frames, read_bundle, read_csv, read_json, read_sqlite, read_xml, records, validate, write_bundle, write_csv
from objtrail.operators.normalize import normalized
from objtrail.sources import exchange
from tests.logs import valid_log


def same(a, b):
    for (_, x), (_, y) in zip(a.tables(), b.tables(), strict=True):
        assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def test_bundles_round_trip(spark, tmp_path):
    log = frames(spark, **valid_log())
    write_bundle(log, str(tmp_path / "p"), ordered=True)
    same(log, read_bundle(spark, str(tmp_path / "p")))
    write_csv(log, str(tmp_path / "c"))
    same(log, read_csv(spark, str(tmp_path / "c")))


def document():
    return {
        "objectTypes": [{"name": "order", "attributes": [{"name": "price", "type": "float"}]}],
        "eventTypes": [{"name": "place", "attributes": [{"name": "n", "type": "int"}, {"name": "at", "type": "date"}, {"name": "ok", "type": "boolean"}]}],
        "objects": [
            {"id": "o1", "type": "order", "attributes": [{"name": "price", "time": "1970-01-01T00:00:00Z", "value": 10}], "relationships": [{"objectId": "o2", "qualifier": "part of"}]},
            {"id": "o2", "type": "order"},
        ],
        "events": [
            {"id": "e1", "type": "place", "time": "2026-01-01T10:00:00+01:00", "attributes": [{"name": "n", "value": 3}, {"name": "at", "value": "2026-01-01T00:00:00Z"}, {"name": "ok", "value": True}], "relationships": [{"objectId": "o1", "qualifier": ""}]}
        ],
    }


def test_json(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(json.dumps(document()))
    result = read_json(spark, str(path))
    assert result.status == "valid"
    assert validate(result.log).collect() == ()
    event = result.log.events.first()
    assert [(a.name, a.value.tag) for a in event.attributes] == [("n", "integer"), ("at", "time"), ("ok", "boolean")]
    assert result.log.e2o.first().qualifier == ""
    assert result.log.o2o.collect()[0].target == "o2"


def test_json_evidence(spark, tmp_path):
    bad = document()
    bad["events"][0]["time"] = "2026-01-01T10:00:00"
    bad["events"][0]["attributes"][0]["value"] = "many"
    path = tmp_path / "log.json"
    path.write_text(json.dumps(bad))
    result = read_json(spark, str(path))
    assert result.status == "recovered"
    assert [r.kind for r in result.evidence.collect()] == ["time_without_zone"]
    assert [i.code for i in validate(result.log).collect()] == ["event_attribute_type_mismatch"]
    bad["events"][0]["time"] = "soon"
    path.write_text(json.dumps(bad))
    assert read_json(spark, str(path)).status == "invalid"
    assert read_json(spark, str(path), "inspect").log is None
    assert read_json(spark, str(path), "recover").log.events.count() == 1
    path.write_text("{ not json")
    result = read_json(spark, str(path))
    assert result.status == "invalid"
    assert [r.kind for r in result.evidence.collect()] == ["unreadable_document"]


def test_xml(spark, tmp_path):
    path = tmp_path / "log.xml"
    path.write_text(
        """<log><object-types><object-type name="order"><attributes><attribute name="price" type="float"/></attributes></object-type></object-types>
<event-types><event-type name="place"><attributes><attribute name="n" type="integer"/></attributes></event-type></event-types>
<objects><object id="o1" type="order"><attributes><attribute name="price" time="1970-01-01T00:00:00Z">1.5</attribute></attributes>
<objects><relationship object-id="o2" qualifier=""/></objects></object><object id="o2" type="order"/></objects>
<events><event id="e1" type="place" time="2026-01-01T10:00:00Z"><attributes><attribute name="n">3</attribute></attributes>
<objects><relationship object-id="o1" qualifier="q"/></objects></event></events></log>"""
    )
    result = read_xml(spark, str(path))
    assert result.status == "valid"
    assert validate(result.log).collect() == ()
    assert {r.id for r in result.log.objects.collect()} == {"o1", "o2"}
    assert result.log.e2o.collect()[0].asDict() == {"event": "e1", "object": "o1", "qualifier": "q"}
    assert result.log.o2o.first().qualifier == ""


def test_sqlite(spark, tmp_path):
    path = tmp_path / "log.sqlite"
    with sqlite3.connect(path) as db:
        db.executescript(
            """CREATE TABLE event(ocel_id TEXT, ocel_type TEXT); CREATE TABLE object(ocel_id TEXT, ocel_type TEXT);
CREATE TABLE event_map_type(ocel_type TEXT, ocel_type_map TEXT); CREATE TABLE object_map_type(ocel_type TEXT, ocel_type_map TEXT);
CREATE TABLE event_object(ocel_event_id TEXT, ocel_object_id TEXT, ocel_qualifier TEXT);
CREATE TABLE object_object(ocel_source_id TEXT, ocel_target_id TEXT, ocel_qualifier TEXT);
CREATE TABLE event_Place(ocel_id TEXT, ocel_time TIMESTAMP, n INTEGER); CREATE TABLE object_Order(ocel_id TEXT, ocel_time TIMESTAMP, ocel_changed_field TEXT, price REAL);
INSERT INTO event VALUES ('e1', 'place'); INSERT INTO object VALUES ('o1', 'order');
INSERT INTO event_map_type VALUES ('place', 'Place'); INSERT INTO object_map_type VALUES ('order', 'Order');
INSERT INTO event_object VALUES ('e1', 'o1', 'q'); INSERT INTO event_Place VALUES ('e1', '2026-01-01T10:00:00Z', 3);
INSERT INTO object_Order VALUES ('o1', '1970-01-01T00:00:00Z', NULL, 1.5), ('o1', '2026-01-02T00:00:00Z', 'price', 2.0);"""
        )
    result = read_sqlite(spark, str(path))
    assert result.status == "valid"
    assert validate(result.log).collect() == ()
    assert [a.value.f for a in result.log.objects.first().attributes] == [1.5, 2.0]
    with sqlite3.connect(tmp_path / "empty.sqlite") as db:
        db.execute("CREATE TABLE t(x)")
    assert read_sqlite(spark, str(tmp_path / "empty.sqlite")).status == "unsupported"


def test_what_a_source_leaves_open_is_evidence(spark, tmp_path):
    bad = document()
    del bad["objects"][0]["attributes"][0]["time"]
    del bad["events"][0]["relationships"][0]["qualifier"]
    path = tmp_path / "log.json"
    path.write_text(json.dumps(bad))
    result = read_json(spark, str(path))
    assert result.status == "recovered"
    assert sorted(r.kind for r in result.evidence.collect()) == ["attribute_without_time", "relation_without_qualifier"]
    bad["objects"][0]["attributes"][0]["time"] = "long ago"
    path.write_text(json.dumps(bad))
    assert read_json(spark, str(path)).status == "invalid"


def test_a_type_declared_twice_is_not_chosen(spark, tmp_path):
    bad = document()
    bad["eventTypes"].append({"name": "place", "attributes": [{"name": "n", "type": "string"}]})
    path = tmp_path / "log.json"
    path.write_text(json.dumps(bad))
    log = read_json(spark, str(path)).log
    assert {a.value.tag for a in log.events.first().attributes} == {"string"}
    assert [i.code for i in validate(log).collect()] == ["duplicate_event_type"]


def test_json_lines(spark, tmp_path):
    whole = document()
    lines = [{"eventTypes": whole["eventTypes"]}, {"objectTypes": whole["objectTypes"]}]
    lines += [{"objects": [o]} for o in whole["objects"]] + [{"events": [e]} for e in whole["events"]]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")
    result = read_json(spark, str(path), lines=True)
    assert result.status == "valid"
    (tmp_path / "log.json").write_text(json.dumps(whole))
    same(result.log, read_json(spark, str(tmp_path / "log.json")).log)


def test_too_large_documents_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exchange, "MAX_DOCUMENT", 10)
    (tmp_path / "log.json").write_text(json.dumps(document()))
    assert read_json(spark, str(tmp_path / "log.json")).status == "unsupported"
    with sqlite3.connect(tmp_path / "log.sqlite") as db:
        db.execute("CREATE TABLE t(x)")
    assert read_sqlite(spark, str(tmp_path / "log.sqlite")).status == "unsupported"


def test_malformed_xml_leaves_evidence(spark, tmp_path):
    path = tmp_path / "log.xml"
    good = '<event id="e1" type="place" time="2026-01-01T10:00:00Z"/>'
    for bad in ('<event id="e2" type="place" time="2026-01-01T10:00:00Z"><attributes></event>', '<event id="e2" type="place"'):
        path.write_text(f'<log><event-types><event-type name="place"/></event-types><events>{good}\n{bad}</events></log>')
        result = read_xml(spark, str(path))
        assert result.status == "invalid", bad
        assert {r.kind for r in result.evidence.collect()} >= {"unreadable_document"}
        assert read_xml(spark, str(path), "recover").log.events.where("id = 'e1'").count() == 1


def test_records_round_trip(spark):
    parts = valid_log()
    log = frames(spark, **parts)
    back = records(log)
    same(normalized(log), frames(spark, **{n: getattr(back, n) for n in ("event_types", "object_types", "events", "objects", "e2o", "o2o")}))
    assert [e.id for e in back.events] == sorted(e.id for e in back.events)
    assert validate(back).collect() == validate(log).collect()
    with pytest.raises(ValueError):
        records(log, 0)
