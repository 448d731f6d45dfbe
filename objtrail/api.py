"""What users of the engine import."""

from objtrail.frames import OcelFrames, frames
from objtrail.operators.build import BuildResult, build, settled
from objtrail.operators.findings import Plan, analyze, compute, interpret, process_state
from objtrail.operators.normalize import ordered, records
from objtrail.operators.report import Issue, Level, Report
from objtrail.operators.results import ComputationResult
from objtrail.operators.shape import require_shape, shape_violations
from objtrail.operators.validate import validate
from objtrail.records import (
    E2O,
    O2O,
    OCEL,
    Attribute,
    Event,
    EventAttr,
    EventType,
    Object,
    ObjectAttr,
    ObjectType,
    Value,
    ValueType,
)
from objtrail.schema import OCEL_EPOCH, configure
from objtrail.sources.bundle import read_bundle, read_csv, write_bundle, write_csv
from objtrail.sources.exchange import ImportResult, read_json, read_sqlite, read_xml

__all__ = [
    "OCEL_EPOCH", "Attribute", "BuildResult", "ComputationResult", "E2O", "Event", "EventAttr", "EventType", "ImportResult", "Issue", "Level",
    "O2O", "OCEL", "Object", "ObjectAttr", "ObjectType", "OcelFrames", "Plan", "Report", "Value", "ValueType", "analyze", "build",
    "compute", "configure", "frames", "interpret", "ordered", "process_state", "read_bundle", "read_csv", "read_json", "read_sqlite",
    "read_xml", "records", "require_shape", "settled", "shape_violations", "validate", "write_bundle", "write_csv",
]
