"""Registered queries of the log engine, over the mapped logs.

Results are flat: issues carry their place as at_0..at_3, instants are ISO texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.functions import values
from objtrail.functions.digest import content_digest
from objtrail.functions.values import time_key, value_key
from objtrail.operators import extras, findings, normalize, process, validate
from objtrail.operators.build import build, settled
from objtrail.operators.report import Report
from objtrail.operators.shape import shape_violations
from objtrail.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STEPS = ("click", "error", "purchase", "signup", "view")


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def flat_issues(issues: DataFrame) -> DataFrame:
    return issues.select("code", "message", "level", *[F.get("at", i).alias(f"at_{i}") for i in range(4)])


def _rule(name: str, code: str, fixture: Callable[[SparkSession, str], OcelFrames], rule: str) -> None:
    """One rule: the validator's pass that emits it, over the log that breaks it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat_issues(validate.rules(fixture(spark, sf_dir))[rule].where(F.col("code") == code))

    QUERIES[name] = run


for _name, _fixture, _pass in (
    ("v01_duplicate_event_type", td.dirty_event_types, "event_types"),
    ("v02_duplicate_object_type", td.dirty_object_types, "object_types"),
    ("v03_duplicate_event_id", td.repeated_event_ids, "event_ids"),
    ("v04_duplicate_object_id", td.repeated_object_ids, "object_ids"),
    ("v05_undeclared_event_type", td.dirty_event_types, "events"),
    ("v06_undeclared_object_type", td.dirty_object_types, "objects"),
    ("v07_undeclared_event_attribute", td.dirty_event_types, "events"),
    ("v08_undeclared_object_attribute", td.dirty_object_types, "objects"),
    ("v09_event_attribute_type_mismatch", td.dirty_event_types, "events"),
    ("v10_object_attribute_type_mismatch", td.dirty_object_types, "objects"),
    ("v11_dangling_e2o_event", td.dangling_events, "e2o"),
    ("v12_dangling_e2o_object", td.dangling_objects, "e2o"),
    ("v13_dangling_o2o_source", td.dangling_ends, "o2o"),
    ("v14_dangling_o2o_target", td.dangling_ends, "o2o"),
    ("v15_duplicate_e2o", td.repeated_relations, "e2o_rows"),
    ("v16_duplicate_o2o", td.repeated_relations, "o2o_rows"),
):
    _rule(_name, _name.split("_", 1)[1], _fixture, _pass)


@query("validate")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a log that breaks several rules at once."""
    return flat_issues(validate.validate(td.dirty_event_types(spark, sf_dir)).issues)


@query("validate_clean")
def validate_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the clean log: the number of issues, zero."""
    return validate.validate(settled(td.clean(spark, sf_dir))).issues.agg(F.count("*").alias("n_issues"))


@query("build")
def build_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate's rows by table, and whether it is valid."""
    log = td.clean(spark, sf_dir)
    result = build(spark, **dict(log.tables()))
    errors = result.report.errors.agg(F.count("*").alias("n_errors"))
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in result.candidate.tables()]
    counts = reduce(DataFrame.unionByName, parts)
    # one row, as a scalar
    n_errors = errors.first().n_errors
    return counts.select("table", "n_rows", F.lit(n_errors == 0).alias("valid"))


@query("s_shape_violations")
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local shape rules over events made to break them, counted."""
    t = td.Tables(spark, sf_dir)
    value = values.float_value(F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")))
    second = F.when(F.col("event_type") == "signup", "value").otherwise("k")
    events = t.events.select(
        F.when(F.col("event_type") == "view", F.lit(" \t")).otherwise(td.key("ev", "event_id")).alias("id"),
        F.col("event_type").alias("type"),
        F.when(F.col("event_type") != "click", td.utc("ts")).alias("time"),
        F.array(
            F.struct(F.lit("value").alias("name"), value.alias("value")),
            F.struct(second.alias("name"), values.string_value(F.when(F.col("event_type") != "purchase", "x")).alias("value")),
        ).alias("attributes"),
    )
    found = shape_violations(td.log(spark, events=events))
    return found.groupBy("table", "field", "error_class", "message").agg(F.count("*").alias("n"))


@query("b_utc_normalize")
def utc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = normalize.normalized(td.users(spark, sf_dir))
    return log.events.select("id", time_key(F.col("time")).alias("time"))


def _exploded(df: DataFrame, *cols) -> DataFrame:
    return df.select(*cols, F.posexplode("attributes").alias("_pos", "a")).withColumn("pos", (F.col("_pos") + 1).cast("long"))


@query("b_sort_type_attrs")
def sort_type_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = normalize.sort_type_attributes(td.declare(spark, td.OBJECT_TYPES.items()))
    return _exploded(types, F.col("name").alias("type")).select(
        "type", "pos", F.col("a.name").alias("name"), F.col("a.type").alias("value_type")
    )


@query("b_sort_event_attrs")
def sort_event_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize.sort_event_attributes(td.events_of_users(td.Tables(spark, sf_dir)))
    return _exploded(events, "id").select("id", "pos", F.col("a.name").alias("name"), F.col("a.value.tag").alias("tag"))


@query("b_sort_object_history")
def sort_object_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the status and priority of each order as history, given unsorted."""
    t = td.Tables(spark, sf_dir)
    entry = lambda name, c: F.struct(
        F.lit(name).alias("name"), values.string_value(F.col(c)).alias("value"), td.utc("o_orderdate").alias("time")
    )
    history = t.orders.groupBy("o_custkey").agg(
        F.flatten(F.collect_list(F.array(entry("status", "o_orderstatus"), entry("priority", "o_orderpriority")))).alias("attributes")
    )
    objects = history.select(td.key("customer", "o_custkey").alias("id"), F.lit("customer").alias("type"), "attributes")
    return _exploded(normalize.sort_object_history(objects), "id").select(
        "id", "pos", F.col("a.name").alias("name"), time_key(F.col("a.time")).alias("time"), F.col("a.value.s").alias("value")
    )


@query("b_order_types")
def order_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = normalize.sort_type_attributes(td.declare(spark, td.EVENT_TYPES.items()))
    return normalize.numbered(types, "event_types").select("ord", "name", F.size("attributes").cast("long").alias("n_attributes"))


@query("b_order_events")
def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = td.repeated_event_ids(spark, sf_dir).events.withColumn("attributes", td.no_attributes("events"))
    return normalize.numbered(events, "events").select("ord", "id", time_key(F.col("time")).alias("time"))


@query("b_order_objects")
def order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.numbered(td.repeated_object_ids(spark, sf_dir).objects, "objects").select("ord", "id", "type")


@query("b_order_e2o")
def order_e2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.numbered(td.repeated_relations(spark, sf_dir).e2o, "e2o").select("ord", "event", "object", "qualifier")


@query("b_order_o2o")
def order_o2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.numbered(td.repeated_relations(spark, sf_dir).o2o, "o2o").select("ord", "source", "target", "qualifier")


@query("b_value_key")
def value_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a string, an integer, a boolean, an instant and a power of two per order."""
    t = td.Tables(spark, sf_dir)
    made = F.array(
        values.string_value(F.col("o_orderpriority")),
        values.integer_value(F.col("o_orderkey").cast("decimal(38,0)")),
        values.boolean_value(F.col("o_orderstatus") == "F"),
        values.time_value(td.utc("o_orderdate")),
        values.float_value(F.pow(F.lit(2.0), (F.col("o_orderkey") % 60).cast("double"))),
    )
    rows = t.orders.select("o_orderkey", F.explode(made).alias("v"))
    return rows.select("o_orderkey", value_key(F.col("v")).alias("k")).select("o_orderkey", "k.tag", "k.text")


def _mixed_report(spark: SparkSession, sf_dir: str) -> Report:
    """A report with warnings: undeclared attributes are taken as such."""
    issues = validate.validate(td.dirty_event_types(spark, sf_dir)).issues
    level = F.when(F.col("code") == "undeclared_event_attribute", "warning").otherwise(F.col("level"))
    return Report(issues.withColumn("level", level))


@query("r_valid")
def report_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = {"dirty_event_types": td.dirty_event_types, "repeated_object_ids": td.repeated_object_ids, "types_only": lambda s, d: td.log(s, event_types=td.declare(s, td.EVENT_TYPES.items()))}
    rows = [(name, validate.validate(f(spark, sf_dir)).valid) for name, f in logs.items()]
    return spark.createDataFrame(rows, "log string, valid boolean")


@query("r_errors")
def report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_issues(_mixed_report(spark, sf_dir).errors)


@query("r_warnings")
def report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_issues(_mixed_report(spark, sf_dir).warnings)


@query("r_has_code")
def report_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = validate.validate(td.dirty_event_types(spark, sf_dir))
    codes = ("duplicate_event_type", "undeclared_event_type", "dangling_e2o_event", "duplicate_o2o")
    return spark.createDataFrame([(c, report.has(c)) for c in codes], "code string, present boolean")


@query("r_summary_by_code")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(td.dirty_event_types(spark, sf_dir)).summary()


@query("c_project_events_by_object")
def project_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process.project_events(td.users(spark, sf_dir), "customer")
    return rows.withColumn("time", time_key(F.col("time")))


@query("c_reconstruct_trace")
def reconstruct_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process.traces(td.users(spark, sf_dir), "customer")
    return rows.select("object", "event", "activity", "position")


@query("c_check_relation_integrity")
def check_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_issues(process.relation_integrity(td.dangling_ends(spark, sf_dir)).issues)


@query("c_check_temporal_constraints")
def check_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process.temporal_constraints(td.users(spark, sf_dir), [("signup", "purchase"), ("view", "refund")])
    return rows.select("object", "before", "after", "violated", "status")


@query("c_temporal_unavailable")
def temporal_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations have turns but no times: their order is unavailable, not kept or broken."""
    rows = process.temporal_constraints(td.conversations(spark, sf_dir), [("user", "assistant")], "conversation")
    return rows.select("object", "before", "after", "violated", "status")


@query("c_lifecycle_completeness")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process.lifecycle_completeness(td.users(spark, sf_dir), [*STEPS, "refund"], "customer")
    return rows.withColumn("missing", F.array_join("missing", ","))


@query("c_evidence_lineage")
def evidence_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three steps reach from every customer: orders, their events and lines; nothing is reached twice."""
    log = td.fulfilling(spark, sf_dir)
    seeds = log.objects.where("type = 'customer'").select(F.col("id").alias("seed"))
    return process.lineage(log, seeds, 3)


@query("c_retry_recovery_metrics")
def retry_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process.retries(td.users(spark, sf_dir), "customer", "k")
    return rows.withColumns({"first_position": F.col("first_position").cast("long")})


PLAN = findings.Plan("customer", (*STEPS, "refund"), (("signup", "purchase"),), "purchase", "k")


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumn("computation_refs", F.array_join("computation_refs", ";"))


@query("f_missing_lifecycle_activity")
def f_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(findings.missing_lifecycle_activity(process.lifecycle_completeness(td.users(spark, sf_dir), PLAN.required, "customer")))


@query("f_temporal_order_violation")
def f_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(findings.temporal_order_violation(process.temporal_constraints(td.users(spark, sf_dir), PLAN.constraints)))


@query("f_dangling_relation")
def f_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(findings.dangling_relation(process.relation_integrity(td.dangling_ends(spark, sf_dir)).issues))


@query("f_orphan_evidence")
def f_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(findings.orphan_evidence(td.users(spark, sf_dir)))


@query("f_ambiguous_provenance")
def f_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(findings.ambiguous_provenance(td.repeated_relations(spark, sf_dir)))


@query("f_false_completion_risk")
def f_false_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = td.users(spark, sf_dir)
    facts = process.lifecycle_completeness(log, PLAN.required, "customer")
    return _flat(findings.false_completion_risk(log, facts, "purchase", "customer"))


@query("f_ineffective_retry")
def f_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(findings.ineffective_retry(process.retries(td.users(spark, sf_dir), "customer")))


@query("p_process_state")
def p_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = td.users(spark, sf_dir)
    state = findings.process_state(log, findings.compute(log, PLAN), PLAN)
    return state.withColumn("missing", F.array_join("missing", ","))


@query("a_analyze")
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of one log, counted."""
    found = findings.analyze(td.users(spark, sf_dir), PLAN).findings
    return found.groupBy("finding").agg(F.count("*").alias("n"))


@query("d_content_digest")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_digest(td.placing(spark, sf_dir))


@query("d_relation_digest")
def relation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of relations, repeated ones too."""
    log = td.repeated_relations(spark, sf_dir)
    return content_digest(log).where("table IN ('e2o', 'o2o')")


@query("v_both_ends")
def both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a log where one, both or no end of relations exists, some of them twice."""
    return flat_issues(validate.validate(td.broken_both(spark, sf_dir)).issues)


@query("s_shape_all_tables")
def shape_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape rules of all six tables over rows made to break them, counted."""
    t = td.Tables(spark, sf_dir)
    nation = F.col("n_nationkey")
    blank = lambda c, k: F.when(nation % 5 == k, F.lit(" ")).otherwise(c)
    name = F.col("n_name")
    item = lambda n, kind: F.struct(n.alias("name"), kind.alias("type"))
    twice = F.array(item(name, F.lit("string")), item(F.when(nation % 2 == 0, name).otherwise("other"), F.when(nation % 3 == 0, "text").otherwise("float")))
    types = t.nation.select(blank(name, 0).alias("name"), twice.alias("attributes"))
    when = F.when(nation % 4 != 0, F.timestamp_seconds(F.lit(0)))
    odd = values.string_value(F.col("n_name")).withField("b", F.when(nation % 3 == 0, F.lit(True)))
    change = lambda n: F.struct(F.lit(n).alias("name"), odd.alias("value"), when.alias("time"))
    second = F.when(nation % 2 == 0, change("a")).otherwise(change("b"))
    objects = t.nation.select(
        blank(name, 1).alias("id"), F.when(nation % 5 != 2, name).alias("type"), F.array(change("a"), second).alias("attributes")
    )
    e2o = t.nation.select(blank(name, 3).alias("event"), name.alias("object"), F.when(nation % 5 != 4, "q").alias("qualifier"))
    o2o = t.nation.select(name.alias("source"), F.when(nation % 5 != 0, name).alias("target"), F.lit("").alias("qualifier"))
    found = shape_violations(td.log(spark, event_types=types, object_types=types, objects=objects, e2o=e2o, o2o=o2o))
    return found.groupBy("table", "field", "error_class", "message").agg(F.count("*").alias("n"))


@query("x_flatten")
def x_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.flatten(td.placing(spark, sf_dir), "customer").withColumn("time", time_key(F.col("time")))


@query("x_oc_dfg")
def x_dfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.directly_follows(td.users(spark, sf_dir)).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query("x_start_end_activities")
def x_start_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.start_end_activities(td.users(spark, sf_dir))


@query("x_object_summary")
def x_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extras.object_summary(td.shipping_to_customers(spark, sf_dir))
    return rows.select(
        "object", F.array_join("lifecycle", ">").alias("lifecycle"), time_key(F.col("start")).alias("start"),
        time_key(F.col("end")).alias("end"), "n_events", "n_partners",
    )


@query("x_object_interactions")
def x_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.object_interactions(td.placing(spark, sf_dir))


@query("x_activities_of_types")
def x_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.activities_of_types(td.clean(spark, sf_dir))


@query("x_extended_table")
def x_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extras.extended_table(td.placing(spark, sf_dir), ["customer", "order"])
    return rows.select("event", "activity", F.array_join("customer", ",").alias("customer"), F.array_join("order", ",").alias("order"))


@query("x_log_summary")
def x_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.log_summary(td.placing(spark, sf_dir))


@query("x_is_ocel20")
def x_ocel20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.uses_ocel20(td.placing(spark, sf_dir))


@query("x_event_graph")
def x_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.event_graph(td.users(spark, sf_dir))


@query("x_process_executions_cc")
def x_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.executions_connected(td.placing(spark, sf_dir))


@query("x_process_executions_leading")
def x_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.executions_leading(td.placing(spark, sf_dir), "order")


@query("x_variants")
def x_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.variants(td.shipping(spark, sf_dir), "order")


@query("x_statistics")
def x_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.statistics(td.users(spark, sf_dir)).withColumn("mean_sojourn_seconds", F.round("mean_sojourn_seconds", 2))


@query("x_service_times")
def x_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.service_times(td.started(spark, sf_dir), "start").withColumn("mean_seconds", F.round("mean_seconds", 2))


@query("x_graph_variants")
def x_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions of orders and their lines; a variant's name is a digest, its members tell it."""
    return extras.graph_variants(td.shipping(spark, sf_dir), rounds=7).select("n", "n_events", "example")


@query("x_eventually_follows")
def x_eventually(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.eventually_follows(td.users(spark, sf_dir), "customer")


@query("x_object_state_at")
def x_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What had been said of each customer when an order was placed, if anything had."""
    rows = extras.object_state_at(td.histories(spark, sf_dir), "segment")
    return rows.select("event", "object", F.col("value.s").alias("value"))
