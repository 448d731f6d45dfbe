"""Process facts over a log: projection, traces, order, completeness, lineage, retries.

The semantics below are this engine's choices where its model leaves them open:

* a trace holds each event of an object once, however many qualifiers relate them;
* events of equal time are ordered by id, for stability, not as a claim of order;
* ``Before(a, b)`` compares the first a with the first b; where either is missing
  the result is unavailable, which is not a violation;
* a retry is an activity directly repeated in a trace.

Every result says ``computed`` or ``unavailable``; a missing fact never becomes
false, zero or an empty list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.operators.report import Report
from objtrail.operators.results import COMPUTED, UNAVAILABLE
from objtrail.operators.validate import counted_ids, duplicate_relations, relation_issues
from objtrail.storage import Scratch, store

_ORDER = ("time", "event")


def project_events(log: OcelFrames, object_type: str | None = None) -> DataFrame:
    """object, object_type, event, activity, time, qualifier of every relation whose ends exist.

    Entities are reduced to one row per id first, so duplicate ids do not multiply
    relations; of duplicates the smallest (type, time) is read.
    """
    objects = log.objects.groupBy(F.col("id").alias("object")).agg(F.min("type").alias("object_type"))
    if object_type is not None:
        objects = objects.where(F.col("object_type") == object_type)
    first = F.min(F.struct("type", "time"))
    events = log.events.groupBy(F.col("id").alias("event")).agg(first.alias("e"))
    events = events.select("event", F.col("e.type").alias("activity"), F.col("e.time").alias("time"))
    return (
        log.e2o.join(objects, "object")
        .join(events, "event")
        .select("object", "object_type", "event", "activity", "time", "qualifier")
    )


def traces(log: OcelFrames, object_type: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """object, object_type, event, activity, time, position (from 1) of each object's events.

    ``rows``, here and below, is the projection where it is at hand, so that several facts
    share one.
    """
    rows = (project_events(log, object_type) if rows is None else rows).drop("qualifier").distinct()
    order = Window.partitionBy("object").orderBy(*_ORDER)
    return rows.withColumn("position", F.row_number().over(order).cast("long"))


def relation_integrity(log: OcelFrames) -> Report:
    """Dangling ends and repeated relations."""
    events, objects = counted_ids(log.events), counted_ids(log.objects)
    parts = [
        relation_issues(log.e2o, "e2o", (("event", "event", events), ("object", "object", objects))),
        relation_issues(log.o2o, "o2o", (("source", "source object", objects), ("target", "target object", objects))),
        duplicate_relations(log.e2o, "e2o"),
        duplicate_relations(log.o2o, "o2o"),
    ]
    return Report(reduce(DataFrame.unionByName, parts))


def temporal_constraints(
    log: OcelFrames, constraints: Sequence[tuple[str, str]], object_type: str | None = None, rows: DataFrame | None = None
) -> DataFrame:
    """object, before, after, first_before, first_after, violated, status of Before(before, after).

    Every object of the type has a row per constraint, those without events too.
    One aggregate per object serves all constraints; positions are compared by
    (time, event), so no window over the trace is needed.
    """
    rows = project_events(log, object_type) if rows is None else rows
    names = sorted({a for pair in constraints for a in pair})
    spot = F.struct("time", "event")
    # one column per activity that a constraint names
    firsts = [F.min(F.when(F.col("activity") == n, spot)).alias(f"a{i}") for i, n in enumerate(names)]
    per_object = rows.groupBy("object").agg(F.count("*").alias("_n"), *firsts)
    objects = log.objects if object_type is None else log.objects.where(F.col("type") == object_type)
    per_object = objects.select(F.col("id").alias("object")).distinct().join(per_object, "object", "left")
    at = {n: F.col(f"a{i}") for i, n in enumerate(names)}
    checks = F.array(
        *[
            F.struct(
                F.lit(a).alias("before"),
                F.lit(b).alias("after"),
                at[a].alias("x"),
                at[b].alias("y"),
            )
            for a, b in constraints
        ]
    )
    both = F.col("c.x").isNotNull() & F.col("c.y").isNotNull()
    return per_object.select("object", F.explode(checks).alias("c")).select(
        "object",
        "c.before",
        "c.after",
        F.col("c.x.time").alias("first_before"),
        F.col("c.y.time").alias("first_after"),
        F.when(both, F.col("c.x") > F.col("c.y")).alias("violated"),
        F.when(both, COMPUTED).otherwise(UNAVAILABLE).alias("status"),
    )


def lifecycle_completeness(
    log: OcelFrames, required: Sequence[str], object_type: str, rows: DataFrame | None = None
) -> DataFrame:
    """object, observed, required, missing, status for every object of the type.

    An object without any event is unavailable: nothing was observed of it.
    """
    # one aggregate serves both: which required activities, and whether any event at all
    rows = project_events(log, object_type) if rows is None else rows
    seen = rows.groupBy("object").agg(
        F.collect_set(F.when(F.col("activity").isin(*required), F.col("activity"))).alias("seen"), F.lit(True).alias("_any")
    )
    objects = log.objects.where(F.col("type") == object_type).select(F.col("id").alias("object")).distinct()
    wanted = F.array(*map(F.lit, sorted(required)))
    seen_set = F.coalesce("seen", F.array().cast("array<string>"))
    there = F.col("_any").isNotNull()
    joined = objects.join(seen, "object", "left")
    return joined.select(
        "object",
        F.when(there, F.size(seen_set).cast("long")).alias("observed"),
        F.lit(len(required)).cast("long").alias("required"),
        F.when(there, F.array_sort(F.array_except(wanted, seen_set))).alias("missing"),
        F.when(there, COMPUTED).otherwise(UNAVAILABLE).alias("status"),
    )


def lineage(log: OcelFrames, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """seed, kind, node, distance: what is reached from ``seeds`` (seed: object id) within ``depth`` steps.

    Steps follow E2O both ways and O2O from source to target (both ways unless
    ``directed``).  Each round joins the frontier alone and drops nodes seen before,
    so cycles end.
    """
    link = lambda a, ka, b, kb, df: df.select(
        F.lit(ka).alias("kind"), F.col(a).alias("node"), F.lit(kb).alias("to_kind"), F.col(b).alias("to_node")
    )
    links = link("event", "event", "object", "object", log.e2o).unionByName(
        link("object", "object", "event", "event", log.e2o)
    ).unionByName(link("source", "object", "target", "object", log.o2o))
    if not directed:
        links = links.unionByName(link("target", "object", "source", "object", log.o2o))
    # dealt once by the node that a step starts from, and read by every step
    scratch = Scratch()
    links = scratch.store(links.distinct().repartition("kind", "node"), "links")
    reached = seeds.select("seed", F.lit("object").alias("kind"), F.col("seed").alias("node"), F.lit(0).cast("long").alias("distance")).distinct()
    frontier = reached
    for step in range(1, depth + 1):
        found = (
            frontier.join(links, ["kind", "node"])
            .select("seed", F.col("to_kind").alias("kind"), F.col("to_node").alias("node"))
            .distinct()
            .join(reached, ["seed", "kind", "node"], "left_anti")
            .withColumn("distance", F.lit(step).cast("long"))
        )
        frontier = store(found, "lineage")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    scratch.drop()
    return reached


def retries(
    log: OcelFrames, object_type: str | None = None, strategy: str | None = None, rows: DataFrame | None = None
) -> DataFrame:
    """object, activity, attempts, recovered, strategy_changed, status: each run of one activity repeated.

    A run is recovered if another activity follows it.  ``strategy`` names an event
    attribute; whether it changed within the run is unavailable where an event
    lacks it.
    """
    rows = traces(log, object_type, rows)
    if strategy is not None:
        chosen = log.events.select(
            F.col("id").alias("event"),
            F.to_json(F.get(F.filter("attributes", lambda a: a["name"] == strategy), 0)["value"]).alias("_s"),
        ).groupBy("event").agg(F.min("_s").alias("_s"))
        rows = rows.join(chosen, "event", "left")
    else:
        rows = rows.withColumn("_s", F.lit(None).cast("string"))
    order = Window.partitionBy("object").orderBy("position")
    new = F.coalesce(F.col("activity") != F.lag("activity").over(order), F.lit(True))
    runs = rows.withColumn("_run", F.sum(new.cast("long")).over(order)).withColumn("_last", F.lead("activity").over(order).isNull())
    out = runs.groupBy("object", "_run", "activity").agg(
        F.count("*").alias("attempts"),
        (~F.bool_or("_last")).alias("recovered"),
        F.count("_s").alias("_known"),
        F.count_distinct("_s").alias("_kinds"),
        F.min("position").alias("first_position"),
    )
    known = F.col("_known") == F.col("attempts")
    return out.where("attempts > 1").select(
        "object",
        "activity",
        "first_position",
        "attempts",
        "recovered",
        F.when(known, F.col("_kinds") > 1).alias("strategy_changed"),
        F.when(known, COMPUTED).otherwise(UNAVAILABLE).alias("strategy_status"),
    )


def as_ref(*parts: Column | str) -> Column:
    """A computation reference: which result rows a finding rests on."""
    return F.array(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
