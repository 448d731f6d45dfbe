from objtrail.api import E2O, Attribute, Event, EventAttr, EventType, ValueType, frames
from objtrail.operators.validate import validate
from objtrail.schema import SCHEMAS
from objtrail.streaming.issues import stream_entity_issues, stream_relation_issues, write_issues
from tests.logs import NOON


def test_streamed_issues_are_the_batch_ones(spark, tmp_path):
    log = frames(
        spark,
        event_types=[EventType("t", (Attribute("a", ValueType.FLOAT),))],
        events=[Event("e1", "t", NOON, (EventAttr("a", 1), EventAttr("b", 1))), Event("e2", "gone", NOON)],
        e2o=[E2O("e1", "o", "q"), E2O("e9", "o", "q")],
    )
    want = sorted(map(repr, validate(log).issues.collect()))
    got = []
    for name in ("events", "e2o"):
        source = str(tmp_path / name)
        getattr(log, name).write.parquet(source)
        rows = spark.readStream.schema(SCHEMAS[name]).parquet(source)
        if name == "events":
            issues = stream_entity_issues(rows, log.event_types, "event")
        else:
            issues = stream_relation_issues(rows, "e2o", (("event", "event", log.events), ("object", "object", log.objects)))
        out = str(tmp_path / f"{name}-out")
        write_issues(issues, out, str(tmp_path / f"{name}-state")).awaitTermination()
        got += map(repr, spark.read.parquet(out).collect())
    assert sorted(got) == want
