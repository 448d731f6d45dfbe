"""The sixteen rules over a whole log.

Every rule is one branch of a union; rules that look at the same rows share one
pass, which builds an array of issues per row and explodes it once.  Ids and
type names are reduced to distinct keys before rows are joined to them, so
duplicates never multiply issues.
"""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames, frames
from objtrail.operators.report import Report, issue
from objtrail.records import OCEL

#: declarations up to this number are broadcast; more are joined by a shuffle
BROADCAST_TYPES = 100_000


def _say(template: str, *values: Column) -> Column:
    """A message with {} filled in, by concat: values may hold any characters."""
    first, *rest = template.split("{}")
    parts = [F.lit(first)]
    for v, text in zip(values, rest, strict=True):
        parts += [v, F.lit(text)]
    return F.concat(*parts)


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Each key that occurs more than once, once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def _expand(df: DataFrame, issues: Column) -> DataFrame:
    return df.select(F.explode(issues).alias("x")).select("x.*")


def _one(df: DataFrame, found: Column) -> DataFrame:
    return df.select(found.alias("x")).select("x.*")


def _when(bad: Column, found: Column) -> Column:
    """An array with the issue where ``bad`` holds."""
    kind = "array<struct<code:string,message:string,level:string,at:array<string>>>"
    return F.when(bad, F.array(found)).otherwise(F.array().cast(kind))


def duplicate_types(types: DataFrame, kind: str) -> DataFrame:
    name = F.col("name")
    text = f"{kind.capitalize()} type '{{}}' is declared more than once."
    return _one(_repeated(types, "name"), issue(f"duplicate_{kind}_type", _say(text, name), f"{kind}_type", name))


def counted_ids(entities: DataFrame) -> DataFrame:
    """id, n: the distinct ids of a table; the rules that need them share one exchange."""
    return entities.groupBy("id").agg(F.count("*").alias("n"))


def duplicate_ids(ids: DataFrame, kind: str) -> DataFrame:
    """Of counted ids, those that occur more than once."""
    text = f"{kind.capitalize()} id '{{}}' occurs more than once."
    return _one(ids.where("n > 1"), issue(f"duplicate_{kind}_id", _say(text, F.col("id")), kind, F.col("id")))


def entity_issues(entities: DataFrame, types: DataFrame, kind: str) -> DataFrame:
    """Undeclared types, undeclared attributes and mismatches, in one pass over the entities.

    An entity of an undeclared type reports that alone; one of a type declared
    twice reports nothing here, since no declaration is preferred.
    """
    declared = types.groupBy("name").agg(F.count("*").alias("n"), F.first("attributes").alias("attributes"))
    # equal names within a type are a shape violation; the first declaration counts
    fields = F.when(F.col("n") == 1, F.col("attributes")).alias("fields")
    declared = declared.select(F.col("name").alias("_type"), fields)
    if types.count() <= BROADCAST_TYPES:
        declared = F.broadcast(declared)
    joined = entities.join(declared, entities["type"] == declared["_type"], "left")
    name = F.col("id")

    def expected(a: Column) -> Column:
        return F.element_at(F.filter("fields", lambda d: d["name"] == a["name"]), 1)["type"]

    def of_attribute(a: Column) -> Column:
        want = F.when(F.exists("fields", lambda d: d["name"] == a["name"]), expected(a))
        place = (kind, name, "attribute", a["name"])
        unknown = issue(
            f"undeclared_{kind}_attribute",
            _say(
                f"{kind.capitalize()} '{{}}' has undeclared attribute '{{}}' for {kind} type '{{}}'.",
                name, a["name"], F.col("type"),
            ),
            *place,
        )
        wrong = issue(
            f"{kind}_attribute_type_mismatch",
            _say(
                f"{kind.capitalize()} '{{}}' attribute '{{}}' requires '{{}}' but contains '{{}}'.",
                name, a["name"], want, a["value"]["tag"],
            ),
            *place,
        )
        return F.when(want.isNull(), unknown).when(want != a["value"]["tag"], wrong)

    undeclared = issue(
        f"undeclared_{kind}_type",
        _say(f"{kind.capitalize()} '{{}}' refers to undeclared {kind} type '{{}}'.", name, F.col("type")),
        kind, name, "type",
    )
    per_attribute = F.filter(F.transform("attributes", of_attribute), lambda x: x.isNotNull())
    found = (
        F.when(F.col("_type").isNull(), F.array(undeclared))
        .when(F.col("fields").isNotNull(), per_attribute)
    )
    return _expand(joined, found)


def relation_issues(relations: DataFrame, kind: str, ends: tuple[tuple[str, str, DataFrame], ...]) -> DataFrame:
    """Dangling ends of each relation row; both may dangle.  ends: column, noun, counted ids."""
    joined, place = relations, (kind, *(F.col(c) for c, _, _ in ends), F.col("qualifier"))
    found = []
    for column, noun, ids in ends:
        # the count tells who is there: without it the planner would build another exchange than that of the duplicates
        known = ids.select(F.col("id").alias(f"_{column}"), F.col("n").alias(f"_n_{column}"))
        joined = joined.join(known, F.col(column) == F.col(f"_{column}"), "left")
        text = f"{kind.upper()} refers to unknown {noun} '{{}}'."
        found.append(
            _when(
                F.col(f"_n_{column}").isNull(),
                issue(f"dangling_{kind}_{column}", _say(text, F.col(column)), *place),
            )
        )
    return _expand(joined, F.concat(*found))


def duplicate_relations(relations: DataFrame, kind: str) -> DataFrame:
    a, b, q = (F.col(c) for c in relations.columns)
    text = f"{kind.upper()} relation ('{{}}', '{{}}', '{{}}') occurs more than once."
    return _one(_repeated(relations, *relations.columns), issue(f"duplicate_{kind}", _say(text, a, b, q), kind, a, b, q))


def rules(log: OcelFrames) -> dict[str, DataFrame]:
    """The passes of the validator, by a name of each; together they are the report."""
    event_ids, object_ids = counted_ids(log.events), counted_ids(log.objects)
    return {
        "event_types": duplicate_types(log.event_types, "event"),
        "object_types": duplicate_types(log.object_types, "object"),
        "event_ids": duplicate_ids(event_ids, "event"),
        "object_ids": duplicate_ids(object_ids, "object"),
        "events": entity_issues(log.events, log.event_types, "event"),
        "objects": entity_issues(log.objects, log.object_types, "object"),
        "e2o": relation_issues(
            log.e2o, "e2o", (("event", "event", event_ids), ("object", "object", object_ids))
        ),
        "o2o": relation_issues(
            log.o2o, "o2o", (("source", "source object", object_ids), ("target", "target object", object_ids))
        ),
        "e2o_rows": duplicate_relations(log.e2o, "e2o"),
        "o2o_rows": duplicate_relations(log.o2o, "o2o"),
    }


def validate(log: OcelFrames | OCEL) -> Report:
    """All issues of a log, as a multiset; the log, in frames or in records, is not changed."""
    if isinstance(log, OCEL):
        log = frames(SparkSession.getActiveSession(), **{f.name: getattr(log, f.name) for f in fields(log)})
    if not isinstance(log, OcelFrames):
        raise TypeError("ocel must be OCEL")
    return Report(reduce(DataFrame.unionByName, rules(log).values()))
