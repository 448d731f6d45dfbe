"""Findings, per-object state and the façade over process facts.

A finding is a row (finding, subject, detail, status, computation_refs) with at
least one reference to the computed rows it rests on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.operators import process
from objtrail.operators.process import as_ref
from objtrail.operators.results import COMPUTED, INVALID_INPUT, ComputationResult, computed, unavailable
from objtrail.storage import store

COLUMNS = ("finding", "subject", "detail", "status", "computation_refs")


@dataclass(frozen=True)
class Plan:
    """What to compute: the object type, its required activities and order constraints."""

    object_type: str
    required: tuple[str, ...]
    constraints: tuple[tuple[str, str], ...] = ()
    completion: str | None = None
    strategy: str | None = None


def _finding(df: DataFrame, name: str, subject, detail, refs) -> DataFrame:
    return df.select(
        F.lit(name).alias("finding"), subject.alias("subject"), detail.alias("detail"), F.lit(COMPUTED).alias("status"),
        refs.alias("computation_refs"),
    )


def missing_lifecycle_activity(completeness: DataFrame) -> DataFrame:
    rows = completeness.where("size(missing) > 0").select("object", F.explode("missing").alias("activity"))
    return _finding(rows, "missing_lifecycle_activity", F.col("object"), F.col("activity"), as_ref("lifecycle", F.col("object")))


def temporal_order_violation(order: DataFrame) -> DataFrame:
    detail = F.concat("before", F.lit(">"), "after")
    return _finding(order.where("violated"), "temporal_order_violation", F.col("object"), detail, as_ref("temporal", F.col("object"), detail))


def dangling_relation(issues: DataFrame) -> DataFrame:
    rows = issues.where(F.col("code").startswith("dangling_"))
    return _finding(rows, "dangling_relation", F.array_join("at", "|"), F.col("code"), as_ref("integrity", F.array_join("at", "|")))


def orphan_evidence(log: OcelFrames) -> DataFrame:
    """Objects that neither an event nor another object refers to."""
    used = (
        log.e2o.select(F.col("object").alias("id"))
        .unionByName(log.o2o.select(F.col("source").alias("id")))
        .unionByName(log.o2o.select(F.col("target").alias("id")))
    )
    rows = log.objects.select("id", "type").join(used, "id", "left_anti")
    return _finding(rows, "orphan_evidence", F.col("id"), F.col("type"), as_ref("lineage", F.col("id")))


def ambiguous_provenance(log: OcelFrames) -> DataFrame:
    """Objects with more than one source under one qualifier of O2O."""
    rows = log.o2o.distinct().groupBy("target", "qualifier").agg(F.count("*").alias("n")).where("n > 1")
    return _finding(rows, "ambiguous_provenance", F.col("target"), F.col("qualifier"), as_ref("lineage", F.col("target"), F.col("qualifier")))


def false_completion_risk(
    log: OcelFrames, completeness: DataFrame, completion: str, object_type: str, rows: DataFrame | None = None
) -> DataFrame:
    """Objects whose completing activity happened while required ones are missing."""
    events = process.project_events(log, object_type) if rows is None else rows
    done = events.where(F.col("activity") == completion).select("object").distinct()
    rows = completeness.where("size(missing) > 0").join(done, "object", "left_semi")
    return _finding(
        rows, "false_completion_risk", F.col("object"), F.array_join("missing", ","), as_ref("lifecycle", F.col("object"))
    )


def ineffective_retry(runs: DataFrame) -> DataFrame:
    """Runs of retries that nothing followed."""
    return _finding(
        runs.where("NOT recovered"), "ineffective_retry", F.col("object"), F.col("activity"),
        as_ref("retries", F.col("object"), F.col("first_position").cast("string")),
    )


def compute(log: OcelFrames, plan: Plan) -> dict[str, ComputationResult]:
    """All process facts of a plan, by name.

    The projection, a join of three tables, is stored once; all facts read it.
    """
    events = store(process.project_events(log, plan.object_type), "projection")
    order = unavailable("temporal", "the plan has no constraints")
    if plan.constraints:
        rows = process.temporal_constraints(log, plan.constraints, plan.object_type, events)
        order = computed("temporal", rows, "Before compares first occurrences")
    return {
        "projection": computed("projection", events),
        "lifecycle": computed("lifecycle", process.lifecycle_completeness(log, plan.required, plan.object_type, events)),
        "temporal": order,
        "integrity": computed("integrity", process.relation_integrity(log).issues),
        "retries": computed(
            "retries", process.retries(log, plan.object_type, plan.strategy, events), "equal times are ordered by event id"
        ),
    }


def interpret(log: OcelFrames, facts: dict[str, ComputationResult], plan: Plan) -> DataFrame:
    """All findings of the facts, as one table."""
    parts = [
        missing_lifecycle_activity(facts["lifecycle"].rows),
        dangling_relation(facts["integrity"].rows),
        orphan_evidence(log),
        ambiguous_provenance(log),
        ineffective_retry(facts["retries"].rows),
    ]
    if facts["temporal"].rows is not None:
        parts.append(temporal_order_violation(facts["temporal"].rows))
    if plan.completion is not None:
        parts.append(false_completion_risk(log, facts["lifecycle"].rows, plan.completion, plan.object_type, facts["projection"].rows))
    return reduce(DataFrame.unionByName, parts)


def process_state(log: OcelFrames, facts: dict[str, ComputationResult], plan: Plan) -> DataFrame:
    """One row per object of the plan's type: stage, completed, required, missing, violations, unresolved.

    ``violations`` is null where no constraint could be computed, ``unresolved``
    counts those that could not.
    """
    last = facts["projection"].rows.groupBy("object").agg(
        F.max(F.struct("time", "event", "activity")).alias("last")
    )
    state = facts["lifecycle"].rows.join(last, "object", "left")
    if facts["temporal"].rows is not None:
        known = F.col("status") == COMPUTED
        broken = facts["temporal"].rows.groupBy("object").agg(
            F.when(F.count_if(known) > 0, F.count_if("violated")).alias("violations"), F.count_if(~known).alias("unresolved")
        )
        state = state.join(broken, "object", "left")
    else:
        state = state.withColumns({"violations": F.lit(None).cast("long"), "unresolved": F.lit(None).cast("long")})
    return state.select(
        "object", F.col("last.activity").alias("stage"), F.col("observed").alias("completed"), "required", "missing",
        "violations", "unresolved", "status",
    )


@dataclass(frozen=True)
class Analysis:
    """Facts, findings and state of one log; ``status`` is invalid_input for an invalid one."""

    status: str
    facts: dict[str, ComputationResult]
    findings: DataFrame | None
    state: DataFrame | None
    assumptions: Sequence[str] = (
        "equal times are ordered by event id",
        "Before compares first occurrences",
        "naive times of sources are read as UTC",
    )


def analyze(log: OcelFrames | None, plan: Plan) -> Analysis:
    """compute, interpret and project; a log that did not validate (None) is invalid input."""
    if log is None:
        return Analysis(INVALID_INPUT, {}, None, None)
    facts = compute(log, plan)
    return Analysis(COMPUTED, facts, interpret(log, facts, plan), process_state(log, facts, plan))
