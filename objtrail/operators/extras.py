"""Extensions over a log: views that other tools for such logs offer.

None of them is part of the validated core; each keeps the log unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.operators.components import connected_components
from objtrail.operators.process import project_events, traces
from objtrail.operators.results import COMPUTED, UNAVAILABLE
from objtrail.storage import Scratch, store


def flatten(log: OcelFrames, object_type: str) -> DataFrame:
    """case, event, activity, time: the log seen from one object type; an event of
    several such objects is in several cases."""
    rows = project_events(log, object_type).select(F.col("object").alias("case"), "event", "activity", "time")
    return rows.distinct()


def directly_follows(log: OcelFrames) -> DataFrame:
    """object_type, source, target, n, mean_seconds of activities that follow directly."""
    order = Window.partitionBy("object").orderBy("position")
    steps = traces(log).select(
        "object_type",
        F.col("activity").alias("source"),
        F.lead("activity").over(order).alias("target"),
        (F.unix_micros(F.lead("time").over(order)) - F.unix_micros("time")).alias("gap"),
    )
    return (
        steps.where("target IS NOT NULL")
        .groupBy("object_type", "source", "target")
        .agg(F.count("*").alias("n"), (F.avg("gap") / 1_000_000).alias("mean_seconds"))
    )


def start_end_activities(log: OcelFrames) -> DataFrame:
    """object_type, activity, starts, ends."""
    rows = traces(log)
    last = Window.partitionBy("object")
    marked = rows.withColumn("_last", F.max("position").over(last))
    return (
        marked.groupBy("object_type", "activity")
        .agg(F.count_if(F.col("position") == 1).alias("starts"), F.count_if(F.col("position") == F.col("_last")).alias("ends"))
        .where("starts > 0 OR ends > 0")
    )


def object_summary(log: OcelFrames) -> DataFrame:
    """object, object_type, lifecycle (array), start, end, seconds, n_events, n_partners."""
    rows = project_events(log).drop("qualifier").distinct()
    own = rows.groupBy("object", "object_type").agg(
        F.array_sort(F.collect_list(F.struct("time", "event", "activity"))).alias("steps"),
        F.min("time").alias("start"),
        F.max("time").alias("end"),
        F.count("*").alias("n_events"),
    )
    pairs = object_interactions(log).select("object", "other")
    both = pairs.unionByName(pairs.select(F.col("other").alias("object"), F.col("object").alias("other")))
    partners = both.groupBy("object").agg(F.count("*").alias("n_partners"))
    return own.join(partners, "object", "left").select(
        "object",
        "object_type",
        F.col("steps.activity").alias("lifecycle"),
        "start",
        "end",
        ((F.unix_micros("end") - F.unix_micros("start")) / 1_000_000).alias("seconds"),
        "n_events",
        F.coalesce("n_partners", F.lit(0)).alias("n_partners"),
    )


def object_interactions(log: OcelFrames) -> DataFrame:
    """object, other, n_events: pairs of objects that share events, each once (object < other).

    An event of k objects makes k (k - 1) / 2 pairs: the graph itself.
    """
    rows = project_events(log).select("event", "object").distinct()
    pairs = rows.join(rows.withColumnRenamed("object", "other"), "event").where("object < other")
    return pairs.groupBy("object", "other").agg(F.count("*").alias("n_events"))


def activities_of_types(log: OcelFrames) -> DataFrame:
    """object_type, activity, n_events, n_objects: which activities the objects of each type take part in."""
    rows = project_events(log).select("object_type", "activity", "event", "object").distinct()
    return rows.groupBy("object_type", "activity").agg(
        F.count_distinct("event").alias("n_events"), F.count_distinct("object").alias("n_objects")
    )


def extended_table(log: OcelFrames, object_types: list[str]) -> DataFrame:
    """event, activity, time and per object type the sorted ids of its objects."""
    rows = project_events(log).drop("qualifier").distinct()
    wide = rows.groupBy("event", "activity", "time").pivot("object_type", object_types).agg(F.array_sort(F.collect_set("object")))
    empty = F.array().cast("array<string>")
    return wide.select("event", "activity", "time", *[F.coalesce(F.col(f"`{t}`"), empty).alias(t) for t in object_types])


def log_summary(log: OcelFrames) -> DataFrame:
    """measure, name, n: rows of each table and entities of each type."""
    parts = None
    for name, df in log.tables():
        one = df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("measure"), F.lit(name).alias("name"), "n")
        parts = one if parts is None else parts.unionByName(one)
    for name, df in (("events", log.events), ("objects", log.objects)):
        counted = df.groupBy("type").agg(F.count("*").alias("n"))
        parts = parts.unionByName(counted.select(F.lit(f"{name}_of_type").alias("measure"), F.col("type").alias("name"), "n"))
    return parts


def uses_ocel20(log: OcelFrames) -> DataFrame:
    """feature, present: what a log holds beyond the first version of the format."""
    checks = {
        "o2o": log.o2o,
        "qualifiers": log.e2o.where("qualifier <> ''"),
        "object_history": log.objects.where(F.size(F.array_distinct(F.transform("attributes", lambda a: a["time"]))) > 1),
    }
    parts = None
    for name, df in checks.items():
        one = df.limit(1).agg((F.count("*") > 0).alias("present")).select(F.lit(name).alias("feature"), "present")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def event_graph(log: OcelFrames) -> DataFrame:
    """source, target: events that follow each other directly at some object."""
    order = Window.partitionBy("object").orderBy("position")
    edges = traces(log).select(F.col("event").alias("source"), F.lead("event").over(order).alias("target"))
    return edges.where("target IS NOT NULL").distinct()


def executions_connected(log: OcelFrames) -> DataFrame:
    """event, execution: weakly connected events, named by the smallest event id."""
    links = project_events(log).select("event", "object").distinct()
    low = links.groupBy("object").agg(F.min("event").alias("b"))
    edges = links.join(low, "object").select(F.col("event").alias("a"), "b")
    label = connected_components(edges)
    events = log.events.select(F.col("id").alias("event")).distinct()
    return events.join(label.withColumnRenamed("node", "event"), "event", "left").select(
        "event", F.coalesce("component", "event").alias("execution")
    )


def executions_leading(log: OcelFrames, leading: str) -> DataFrame:
    """execution (a leading object), object, event: its events, the objects they involve, and
    the events of those of other types.

    An object that many executions involve brings all its events to each of them: that
    product is the result asked for.  Executions and links are reduced to distinct pairs
    before each join, so nothing else is multiplied.
    """
    links = project_events(log).select("object", "object_type", "event").distinct()
    own = links.where(F.col("object_type") == leading).select(F.col("object").alias("execution"), "event").distinct()
    others = own.join(links.where(F.col("object_type") != leading), "event").select("execution", "object").distinct()
    reached = others.join(links.select("object", "event"), "object").select("execution", "object", "event")
    return own.select("execution", F.col("execution").alias("object"), "event").unionByName(reached).distinct()


def variants(log: OcelFrames, object_type: str) -> DataFrame:
    """variant (activities joined by >), n objects, example (smallest object)."""
    rows = traces(log, object_type).groupBy("object").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "activity"))), lambda s: s["activity"]), ">").alias("variant")
    )
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.min("object").alias("example"))


#: links of an execution that are put in one row, to see which executions are the same
GATHERED = 64


def graph_variants(log: OcelFrames, rounds: int = 3) -> DataFrame:
    """variant, n executions, n_events of each, example (smallest execution): connected executions
    whose event graphs look alike.

    Weisfeiler-Lehman labels: an event's label is its activity, and in each round a digest of
    its own, its predecessors' and its successors' labels.  Neighbours and events are summed
    up by their digests, so neither a busy event nor a large execution is gathered.
    Isomorphic graphs always get one variant; others may, if ``rounds`` cannot tell them apart.

    Executions of up to ``GATHERED`` links that are the same but for their names are
    isomorphic, so one stands for all of them in the rounds; larger ones stand for themselves.
    """
    scratch = Scratch()
    total = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
    links = _grouped_links(log, scratch)
    large = links.groupBy("group").agg(F.count("*").alias("k")).where(F.col("k") > GATHERED).select("group")
    large = scratch.store(large, "large")
    alike = _same_executions(links.join(large, "group", "left_anti"))
    standing = scratch.store(alike.unionByName(large.select("group", F.lit(1).cast("long").alias("n"))), "standing")
    rows = scratch.store(links.join(standing.select("group"), "group", "left_semi").distinct(), "rows")
    order = Window.partitionBy("object").orderBy("time", "event")
    linked = rows.where("object IS NOT NULL")
    edges = linked.select(F.col("event").alias("source"), F.lead("event").over(order).alias("target"))
    edges = scratch.store(edges.where("target IS NOT NULL").distinct(), "graph")
    labels = scratch.store(rows.select("event", F.xxhash64("type").alias("label")).distinct(), "labels")
    for _ in range(rounds):
        after = edges.join(labels.withColumnRenamed("event", "target"), "target").groupBy(F.col("source").alias("event"))
        before = edges.join(labels.withColumnRenamed("event", "source"), "source").groupBy(F.col("target").alias("event"))
        again = F.xxhash64("label")
        joined = labels.join(after.agg(total(again).alias("out")), "event", "left").join(before.agg(total(again).alias("in")), "event", "left")
        fresh = F.xxhash64("label", F.coalesce("out", F.lit("")), F.lit("|"), F.coalesce("in", F.lit("")))
        labels = scratch.store(joined.select("event", fresh.alias("label")), "labels")
    placed = rows.select("group", "event").distinct().join(labels, "event")
    shapes = placed.groupBy("group").agg(
        F.count("*").alias("n_events"), total(F.xxhash64("label")).alias("shape"), F.min("event").alias("execution")
    )
    found = shapes.join(standing, "group").groupBy("shape", "n_events").agg(F.sum("n").alias("n"), F.min("execution").alias("example"))
    found = store(found.select(F.sha2("shape", 256).alias("variant"), "n", "n_events", "example"), "variants")
    scratch.drop()
    return found


def _grouped_links(log: OcelFrames, scratch: Scratch) -> DataFrame:
    """group, event, type, time, object: the links of each execution; an event without objects has
    one row and a group of its own."""
    objects = log.objects.select(F.col("id").alias("object")).distinct()
    held = log.e2o.select("event", "object").join(objects, "object", "left_semi")
    # dealt out first: the smallest of structs is found by sorting, once here and not before it as well
    events = log.events.select(F.col("id").alias("event"), "type", "time").where("id IS NOT NULL").repartition("event")
    events = events.groupBy("event").agg(F.min("type").alias("type"), F.min(F.struct("type", "time")).alias("e"))
    rows = events.select("event", "type", F.col("e.time").alias("time")).join(held, "event", "left")
    first = F.nullif(F.min("object").over(Window.partitionBy("event")), "object")
    links = scratch.store(rows.withColumn("first", first), "links")
    # objects are connected by their events: an event of one object connects none
    label = connected_components(links.where("first IS NOT NULL").select(F.col("object").alias("a"), F.col("first").alias("b")))
    group = F.coalesce(F.concat(F.lit("o:"), F.coalesce("component", "object")), F.concat(F.lit("e:"), "event"))
    placed = links.join(label.withColumnRenamed("node", "object"), "object", "left")
    return placed.select(group.alias("group"), "event", "type", "time", "object")


def _same_executions(links: DataFrame) -> DataFrame:
    """group, n: of the executions that are the same but for their names the one of the smallest event.

    Events are numbered by time and id and objects as they come up, so equal forms
    are equal graphs.
    """
    # dealt out first: before that no task holds two links of most executions
    rows = links.repartition("group").groupBy("group")
    rows = rows.agg(F.array_sort(F.collect_set(F.struct("time", "event", "object", "type"))).alias("links"))
    rows = rows.select(
        "group", "links", F.array_distinct("links.event").alias("events"), F.array_distinct("links.object").alias("objects")
    )
    form = F.transform(
        "links", lambda k: F.struct(k["type"], F.array_position("events", k["event"]), F.array_position("objects", k["object"]))
    )
    first = F.struct(F.array_min("events").alias("event"), "group")
    same = rows.groupBy(form.alias("form")).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return same.select("first.group", "n")


def statistics(log: OcelFrames) -> DataFrame:
    """object_type, activity, n_events, n_objects, rework (objects that have it more than once) and
    mean_sojourn_seconds: from the object's event before; null for activities that only come first."""
    order = Window.partitionBy("object").orderBy("position")
    gap = F.unix_micros("time") - F.unix_micros(F.lag("time").over(order))
    rows = traces(log).withColumn("gap", gap).groupBy("object_type", "activity", "object").agg(
        F.count("*").alias("k"), F.sum("gap").alias("gap"), F.count("gap").alias("gaps")
    )
    return rows.groupBy("object_type", "activity").agg(
        F.sum("k").alias("n_events"), F.count("*").alias("n_objects"), F.count_if(F.col("k") > 1).alias("rework"),
        (F.sum("gap") / F.nullif(F.sum("gaps"), F.lit(0)) / 1_000_000).alias("mean_sojourn_seconds"),
    )


def service_times(log: OcelFrames, start: str) -> DataFrame:
    """activity, n_events, mean_seconds, status: from the time in the event attribute ``start`` to the event's.

    An activity none of whose events has such a time is unavailable.
    """
    begun = F.get(F.filter("attributes", lambda a: (a["name"] == start) & a["value"]["t"].isNotNull()), 0)["value"]["t"]
    rows = log.events.select(F.col("type").alias("activity"), (F.unix_micros("time") - F.unix_micros(begun)).alias("took"))
    return rows.groupBy("activity").agg(
        F.count("took").alias("n_events"),
        (F.avg("took") / 1_000_000).alias("mean_seconds"),
        F.when(F.count("took") > 0, COMPUTED).otherwise(UNAVAILABLE).alias("status"),
    )


def eventually_follows(log: OcelFrames, object_type: str) -> DataFrame:
    """source, target, n: objects where some source comes before some target.

    By each activity's first and last place at an object, so a trace of n events
    costs the square of its distinct activities, not of n.
    """
    rows = traces(log, object_type).groupBy("object", "activity").agg(
        F.min("position").alias("lo"), F.max("position").alias("hi")
    )
    a = rows.select("object", F.col("activity").alias("source"), "lo")
    b = rows.select("object", F.col("activity").alias("target"), "hi")
    return a.join(b, "object").where("lo < hi").groupBy("source", "target").agg(F.count("*").alias("n"))


def object_state_at(log: OcelFrames, attribute: str) -> DataFrame:
    """event, object, value: the attribute's value of each related object as of the event's time."""
    history = log.objects.select(F.col("id").alias("object"), F.explode("attributes").alias("a")).where(
        F.col("a.name") == attribute
    )
    history = history.select("object", F.col("a.time").alias("since"), F.col("a.value").alias("value"))
    rows = project_events(log).select("event", "object", "time").distinct()
    joined = rows.join(history, (rows["object"] == history["object"]) & (history["since"] <= rows["time"]))
    return joined.groupBy("event", rows["object"]).agg(F.max_by("value", "since").alias("value"))
