"""Logs mapped from the driver's tables.

Assumption, recorded here for all mappings: the tables' naive timestamps are UTC.
Static object attributes carry the epoch as their time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objtrail.frames import OcelFrames
from objtrail.functions.values import float_value, integer_value, string_value, time_value
from objtrail.schema import SCHEMAS, configure

# fixed values: declarations of the clean log
EVENT_TYPES = {
    **{t: {"value": "float", "k": "integer"} for t in ("click", "error", "purchase", "signup", "view")},
    "place_order": {"totalprice": "float", "priority": "string"},
    "ship_item": {
        "quantity": "float", "extendedprice": "float", "discount": "float", "tax": "float",
        "returnflag": "string", "linestatus": "string",
    },
}
OBJECT_TYPES = {
    "region": {"name": "string"},
    "nation": {"name": "string"},
    "customer": {"name": "string", "acctbal": "float", "mktsegment": "string"},
    "supplier": {"name": "string", "acctbal": "float"},
    "part": {"name": "string", "brand": "string", "type": "string", "size": "integer", "retailprice": "float"},
    "order": {"status": "string", "totalprice": "float"},
}
_LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
)


class Tables:
    """The driver's tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = configure(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def key(prefix: str, column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(f"{prefix}:"), c.cast("string"))


def utc(column: str) -> Column:
    """A naive timestamp read as UTC; the session zone is UTC."""
    return F.col(column).cast("timestamp")


def attributes(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])


def static(**values: Column) -> Column:
    epoch = F.timestamp_seconds(F.lit(0))
    return F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), epoch.alias("time")) for n, v in values.items()])


def declare(spark: SparkSession, types: Iterable[tuple[str, dict[str, str]]]) -> DataFrame:
    return spark.createDataFrame([(n, list(a.items())) for n, a in types], SCHEMAS["event_types"])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def log(spark: SparkSession, **tables: DataFrame) -> OcelFrames:
    """A log of these tables; the others are empty."""
    return OcelFrames(**{name: tables.get(name) if name in tables else empty(spark, name) for name in SCHEMAS})


def no_attributes(table: str) -> Column:
    return F.array().cast(SCHEMAS[table]["attributes"].dataType)


def events_of_users(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("decimal(38,0)")
    return t.events.select(
        key("ev", "event_id").alias("id"), F.col("event_type").alias("type"), utc("ts").alias("time"),
        attributes(value=float_value(F.col("value")), k=integer_value(k)).alias("attributes"),
    )


def events_of_orders(t: Tables) -> DataFrame:
    return t.orders.select(
        key("po", "o_orderkey").alias("id"), F.lit("place_order").alias("type"), utc("o_orderdate").alias("time"),
        attributes(totalprice=float_value(F.col("o_totalprice")), priority=string_value(F.col("o_orderpriority"))).alias("attributes"),
    )


def lines(t: Tables) -> DataFrame:
    """lineitem with ``line``, a surrogate id that is unique."""
    order = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return t.lineitem.withColumn("line", F.concat_ws(":", F.lit("li"), "l_orderkey", F.row_number().over(order)))


def events_of_lines(rows: DataFrame) -> DataFrame:
    values = {n: float_value(F.col(f"l_{n}")) for n in ("quantity", "extendedprice", "discount", "tax")}
    values |= {n: string_value(F.col(f"l_{n}")) for n in ("returnflag", "linestatus")}
    return rows.select(
        F.col("line").alias("id"), F.lit("ship_item").alias("type"), utc("l_shipdate").alias("time"),
        attributes(**values).alias("attributes"),
    )


def _object(df: DataFrame, kind: str, id_col: str, **values: Column) -> DataFrame:
    return df.select(key(kind, id_col).alias("id"), F.lit(kind).alias("type"), static(**values).alias("attributes"))


def customers(t: Tables) -> DataFrame:
    return _object(
        t.customer, "customer", "c_custkey", name=string_value(F.col("c_name")),
        acctbal=float_value(F.col("c_acctbal")), mktsegment=string_value(F.col("c_mktsegment")),
    )


def orders(t: Tables) -> DataFrame:
    return _object(
        t.orders, "order", "o_orderkey", status=string_value(F.col("o_orderstatus")), totalprice=float_value(F.col("o_totalprice"))
    )


def suppliers(t: Tables) -> DataFrame:
    return _object(
        t.supplier, "supplier", "s_suppkey", name=string_value(F.col("s_name")), acctbal=float_value(F.col("s_acctbal"))
    )


def parts(t: Tables) -> DataFrame:
    return _object(
        t.part, "part", "p_partkey", name=string_value(F.col("p_name")), brand=string_value(F.col("p_brand")),
        type=string_value(F.col("p_type")), size=integer_value(F.col("p_size").cast("decimal(38,0)")),
        retailprice=float_value(F.col("p_retailprice")),
    )


def relation(df: DataFrame, table: str, a: Column, b: Column, qualifier: str) -> DataFrame:
    x, y, q = SCHEMAS[table].names
    return df.select(a.alias(x), b.alias(y), F.lit(qualifier).alias(q))


def union(*dfs: DataFrame) -> DataFrame:
    out, *rest = dfs
    for df in rest:
        out = out.unionByName(df)
    return out


def clean(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """C0: the whole business as one valid log."""
    t = Tables(spark, sf_dir)
    rows = lines(t)
    return OcelFrames(
        event_types=declare(spark, EVENT_TYPES.items()),
        object_types=declare(spark, OBJECT_TYPES.items()),
        events=union(events_of_users(t), events_of_orders(t), events_of_lines(rows)),
        objects=union(
            _object(t.region, "region", "r_regionkey", name=string_value(F.col("r_name"))),
            _object(t.nation, "nation", "n_nationkey", name=string_value(F.col("n_name"))),
            customers(t), suppliers(t), parts(t), orders(t),
        ),
        e2o=union(
            relation(t.events, "e2o", key("ev", "event_id"), key("customer", "user_id"), "actor"),
            relation(t.orders, "e2o", key("po", "o_orderkey"), key("order", "o_orderkey"), "order"),
            relation(t.orders, "e2o", key("po", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
            relation(rows, "e2o", F.col("line"), key("order", "l_orderkey"), "of_order"),
            relation(rows, "e2o", F.col("line"), key("part", "l_partkey"), "item"),
            relation(rows, "e2o", F.col("line"), key("supplier", "l_suppkey"), "from"),
        ),
        o2o=union(
            relation(t.orders, "o2o", key("order", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
            relation(t.customer, "o2o", key("customer", "c_custkey"), key("nation", "c_nationkey"), "located_in"),
            relation(t.supplier, "o2o", key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "located_in"),
            relation(t.nation, "o2o", key("nation", "n_nationkey"), key("region", "n_regionkey"), "in_region"),
        ),
    )


def users(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """The part of C0 that users' events make: their traces at customers."""
    t = Tables(spark, sf_dir)
    return log(
        spark, events=events_of_users(t), objects=customers(t),
        e2o=relation(t.events, "e2o", key("ev", "event_id"), key("customer", "user_id"), "actor"),
    )


def placing(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """The part of C0 about orders being placed by customers."""
    t = Tables(spark, sf_dir)
    return log(
        spark, events=events_of_orders(t), objects=union(customers(t), orders(t)),
        e2o=union(
            relation(t.orders, "e2o", key("po", "o_orderkey"), key("order", "o_orderkey"), "order"),
            relation(t.orders, "e2o", key("po", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
        ),
        o2o=relation(t.orders, "o2o", key("order", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
    )


def shipping(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """The part of C0 about orders being placed and their lines shipped."""
    t = Tables(spark, sf_dir)
    rows = lines(t)
    return log(
        spark, events=union(events_of_orders(t), events_of_lines(rows)), objects=orders(t),
        e2o=union(
            relation(t.orders, "e2o", key("po", "o_orderkey"), key("order", "o_orderkey"), "order"),
            relation(rows, "e2o", F.col("line"), key("order", "l_orderkey"), "of_order"),
        ),
    )


def dirty_event_types(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D1: signup declared twice, error undeclared, view without k, purchase's value an integer."""
    types = [
        ("click", {"value": "float", "k": "integer"}), ("view", {"value": "float"}),
        ("purchase", {"value": "integer", "k": "integer"}), ("signup", {"value": "float"}), ("signup", {"k": "integer"}),
    ]
    return log(spark, event_types=declare(spark, types), events=events_of_users(Tables(spark, sf_dir)))


def dirty_object_types(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D2: supplier declared twice, part undeclared, customer without mktsegment, order's price an integer."""
    t = Tables(spark, sf_dir)
    types = [
        ("customer", {"name": "string", "acctbal": "float"}), ("order", {"status": "string", "totalprice": "integer"}),
        ("supplier", {"name": "string"}), ("supplier", {"name": "string"}),
    ]
    return log(
        spark, object_types=declare(spark, types), objects=union(customers(t), orders(t), suppliers(t), parts(t))
    )


def repeated_event_ids(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D3: events named by a key of lines that is not one."""
    rows = Tables(spark, sf_dir).lineitem.withColumn("line", F.concat_ws(":", F.lit("li"), "l_orderkey", "l_linenumber"))
    return log(spark, event_types=declare(spark, [("ship_item", EVENT_TYPES["ship_item"])]), events=events_of_lines(rows))


def repeated_object_ids(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D4: parts named by their name."""
    named = Tables(spark, sf_dir).part.select(
        key("partname", "p_name").alias("id"), F.lit("part").alias("type"), no_attributes("objects").alias("attributes")
    )
    return log(spark, object_types=declare(spark, [("part", {})]), objects=named)


def dangling_events(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D5: only finished lines are events, all lines have relations."""
    t = Tables(spark, sf_dir)
    rows = lines(t)
    return log(
        spark, events=events_of_lines(rows.where("l_linestatus = 'F'")), objects=parts(t),
        e2o=relation(rows, "e2o", F.col("line"), key("part", "l_partkey"), "item"),
    )


def dangling_objects(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D6: customers of one segment are missing."""
    t = Tables(spark, sf_dir)
    some = customers(t).where(F.get("attributes", 2)["value"]["s"] != "HOUSEHOLD")
    return log(
        spark, events=events_of_orders(t), objects=some,
        e2o=relation(t.orders, "e2o", key("po", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
    )


def dangling_ends(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D7: some orders and some customers are missing."""
    t = Tables(spark, sf_dir)
    some = customers(t).where(F.get("attributes", 2)["value"]["s"] != "HOUSEHOLD")
    kept = orders(t).where(F.get("attributes", 0)["value"]["s"] != "P")
    return log(
        spark, objects=union(kept, some),
        o2o=relation(t.orders, "o2o", key("order", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
    )


def repeated_relations(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D8: what orders contain, once per line."""
    t = Tables(spark, sf_dir)
    return log(
        spark,
        e2o=relation(t.lineitem, "e2o", key("po", "l_orderkey"), key("part", "l_partkey"), "contains"),
        o2o=relation(t.lineitem, "o2o", key("order", "l_orderkey"), key("part", "l_partkey"), "contains"),
    )


def histories(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """Orders placed by customers with a history: each day's largest status of their orders, from that
    day on, or a hundred days later for every other customer."""
    t = Tables(spark, sf_dir)
    day = t.orders.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderstatus").alias("o_orderstatus"))
    late = F.when(F.col("o_custkey") % 2 == 0, F.expr("INTERVAL 100 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    change = F.struct(
        F.lit("segment").alias("name"), string_value(F.col("o_orderstatus")).alias("value"), (utc("o_orderdate") + late).alias("time")
    )
    held = day.groupBy("o_custkey").agg(F.collect_list(change).alias("attributes"))
    objects = held.select(key("customer", "o_custkey").alias("id"), F.lit("customer").alias("type"), "attributes")
    return log(
        spark, events=events_of_orders(t), objects=objects,
        e2o=relation(t.orders, "e2o", key("po", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
    )


def fulfilling(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """Customers, their orders and the lines shipped: customers reach lines through orders alone."""
    t = Tables(spark, sf_dir)
    rows = lines(t)
    return log(
        spark, events=union(events_of_orders(t), events_of_lines(rows)), objects=union(customers(t), orders(t)),
        e2o=union(
            relation(t.orders, "e2o", key("po", "o_orderkey"), key("order", "o_orderkey"), "order"),
            relation(rows, "e2o", F.col("line"), key("order", "l_orderkey"), "of_order"),
        ),
        o2o=relation(t.orders, "o2o", key("order", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
    )


def shipping_to_customers(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """Orders placed by customers and their lines shipped to them."""
    t = Tables(spark, sf_dir)
    rows = lines(t).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return log(
        spark, events=union(events_of_orders(t), events_of_lines(rows)), objects=union(customers(t), orders(t)),
        e2o=union(
            relation(t.orders, "e2o", key("po", "o_orderkey"), key("order", "o_orderkey"), "order"),
            relation(t.orders, "e2o", key("po", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
            relation(rows, "e2o", F.col("line"), key("customer", "o_custkey"), "to"),
        ),
    )


def started(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """Lines shipped, with the date of their order as their start; orders have none."""
    t = Tables(spark, sf_dir)
    rows = lines(t).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = rows.select(
        F.col("line").alias("id"), F.lit("ship_item").alias("type"), utc("l_shipdate").alias("time"),
        attributes(start=time_value(utc("o_orderdate")), returnflag=string_value(F.col("l_returnflag"))).alias("attributes"),
    )
    return log(spark, events=union(shipped, events_of_orders(t)))


def broken_both(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D12: relations of which either, both or no end exists, some of them twice."""
    t = Tables(spark, sf_dir)
    some = customers(t).where(F.get("attributes", 2)["value"]["s"] != "HOUSEHOLD")
    placed = relation(t.orders, "e2o", key("po", "o_orderkey"), key("customer", "o_custkey"), "placed_by")
    urgent = relation(t.orders.where("o_orderpriority = '1-URGENT'"), "e2o", key("po", "o_orderkey"), key("customer", "o_custkey"), "placed_by")
    return log(
        spark, event_types=declare(spark, [("place_order", EVENT_TYPES["place_order"])]),
        object_types=declare(spark, [("customer", OBJECT_TYPES["customer"])]),
        events=events_of_orders(t).where(F.get("attributes", 1)["value"]["s"] != "2-HIGH"), objects=some, e2o=union(placed, urgent),
    )


def conversations(spark: SparkSession, sf_dir: str) -> OcelFrames:
    """D11: conversations and their turns as objects; without times there are no events."""
    t = Tables(spark, sf_dir).conversations
    turn = F.concat_ws(":", F.lit("turn"), "conv_id", "turn")
    whole = t.select(key("conversation", "conv_id").alias("id"), F.lit("conversation").alias("type")).distinct()
    turns = t.select(turn.alias("id"), F.lit("turn").alias("type"))
    none = no_attributes("objects").alias("attributes")
    return log(
        spark, objects=union(whole.select("*", none), turns.select("*", none)),
        o2o=relation(t, "o2o", turn, key("conversation", "conv_id"), "part_of"),
    )
