"""DuckDB SQL of the engine's registered queries, written over the plain tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

EV = "concat('ev:', CAST(event_id AS VARCHAR))"
ISO = "concat(strftime({}, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00')"
LINES = """lines AS (
  SELECT *, concat('li:', l_orderkey, ':', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)) AS line
  FROM lineitem)"""
USERS = f"""users AS (
  SELECT concat('customer:', e.user_id) AS object, {EV} AS event, e.event_type AS activity, e.ts AS time, e.props
  FROM events e JOIN customer c ON c.c_custkey = e.user_id)"""


def _issues(code: str, message: str, source: str, *at: str) -> str:
    place = [*at, *["CAST(NULL AS VARCHAR)"] * (4 - len(at))]
    cells = ", ".join(f"{x} AS at_{i}" for i, x in enumerate(place))
    return f"SELECT '{code}' AS code, {message} AS message, 'error' AS level, {cells} {source}"


D1 = """decl(type, attr, expected) AS (
  SELECT * FROM (VALUES ('click', 'value', 'float'), ('click', 'k', 'integer'), ('view', 'value', 'float'),
    ('purchase', 'value', 'integer'), ('purchase', 'k', 'integer')) t(type, attr, expected)),
entries AS (
  SELECT concat('ev:', event_id) AS id, event_type AS type, 'value' AS attr, 'float' AS actual FROM events
  UNION ALL SELECT concat('ev:', event_id), event_type, 'k', 'integer' FROM events)"""
D2 = """decl(type, attr, expected) AS (
  SELECT * FROM (VALUES ('customer', 'name', 'string'), ('customer', 'acctbal', 'float'), ('order', 'status', 'string'),
    ('order', 'totalprice', 'integer')) t(type, attr, expected)),
entries AS (
  SELECT concat('customer:', c_custkey) AS id, 'customer' AS type, a.attr, a.actual FROM customer,
    (VALUES ('name', 'string'), ('acctbal', 'float'), ('mktsegment', 'string')) a(attr, actual)
  UNION ALL SELECT concat('order:', o_orderkey), 'order', a.attr, a.actual FROM orders,
    (VALUES ('status', 'string'), ('totalprice', 'float')) a(attr, actual))"""

V01 = _issues("duplicate_event_type", "concat('Event type ''', name, ''' is declared more than once.')",
              "FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('signup')) t(name) GROUP BY name HAVING count(*) > 1",
              "'event_type'", "name")
V05 = _issues("undeclared_event_type", f"concat('Event ''', {EV}, ''' refers to undeclared event type ''', event_type, '''.')",
              "FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')", "'event'", EV, "'type'")
V07 = _issues("undeclared_event_attribute",
              "concat('Event ''', id, ''' has undeclared attribute ''', attr, ''' for event type ''', type, '''.')",
              "FROM entries e WHERE type IN ('click', 'view', 'purchase') AND NOT EXISTS (SELECT 1 FROM decl d WHERE d.type = e.type AND d.attr = e.attr)",
              "'event'", "id", "'attribute'", "attr")
V09 = _issues("event_attribute_type_mismatch",
              "concat('Event ''', e.id, ''' attribute ''', e.attr, ''' requires ''', d.expected, ''' but contains ''', e.actual, '''.')",
              "FROM entries e JOIN decl d ON d.type = e.type AND d.attr = e.attr WHERE d.expected <> e.actual",
              "'event'", "e.id", "'attribute'", "e.attr")
ORACLES["v01_duplicate_event_type"] = V01
ORACLES["v02_duplicate_object_type"] = _issues(
    "duplicate_object_type", "concat('Object type ''', name, ''' is declared more than once.')",
    "FROM (VALUES ('customer'), ('order'), ('supplier'), ('supplier')) t(name) GROUP BY name HAVING count(*) > 1",
    "'object_type'", "name")
ORACLES["v03_duplicate_event_id"] = _issues(
    "duplicate_event_id", "concat('Event id ''', id, ''' occurs more than once.')",
    "FROM (SELECT concat('li:', l_orderkey, ':', l_linenumber) AS id FROM lineitem) GROUP BY id HAVING count(*) > 1",
    "'event'", "id")
ORACLES["v04_duplicate_object_id"] = _issues(
    "duplicate_object_id", "concat('Object id ''', id, ''' occurs more than once.')",
    "FROM (SELECT concat('partname:', p_name) AS id FROM part) GROUP BY id HAVING count(*) > 1", "'object'", "id")
ORACLES["v05_undeclared_event_type"] = V05
ORACLES["v06_undeclared_object_type"] = _issues(
    "undeclared_object_type", "concat('Object ''part:', p_partkey, ''' refers to undeclared object type ''part''.')",
    "FROM part", "'object'", "concat('part:', p_partkey)", "'type'")
ORACLES["v07_undeclared_event_attribute"] = f"WITH {D1} {V07}"
ORACLES["v08_undeclared_object_attribute"] = f"WITH {D2} " + _issues(
    "undeclared_object_attribute",
    "concat('Object ''', id, ''' has undeclared attribute ''', attr, ''' for object type ''', type, '''.')",
    "FROM entries e WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.type = e.type AND d.attr = e.attr)",
    "'object'", "id", "'attribute'", "attr")
ORACLES["v09_event_attribute_type_mismatch"] = f"WITH {D1} {V09}"
ORACLES["v10_object_attribute_type_mismatch"] = f"WITH {D2} " + _issues(
    "object_attribute_type_mismatch",
    "concat('Object ''', e.id, ''' attribute ''', e.attr, ''' requires ''', d.expected, ''' but contains ''', e.actual, '''.')",
    "FROM entries e JOIN decl d ON d.type = e.type AND d.attr = e.attr WHERE d.expected <> e.actual",
    "'object'", "e.id", "'attribute'", "e.attr")
ORACLES["v11_dangling_e2o_event"] = f"WITH {LINES} " + _issues(
    "dangling_e2o_event", "concat('E2O refers to unknown event ''', line, '''.')",
    "FROM lines WHERE l_linestatus <> 'F'", "'e2o'", "line", "concat('part:', l_partkey)", "'item'")
ORACLES["v12_dangling_e2o_object"] = _issues(
    "dangling_e2o_object", "concat('E2O refers to unknown object ''customer:', o_custkey, '''.')",
    "FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')",
    "'e2o'", "concat('po:', o_orderkey)", "concat('customer:', o_custkey)", "'placed_by'")
_O2O = ("'o2o'", "concat('order:', o_orderkey)", "concat('customer:', o_custkey)", "'placed_by'")
V13 = _issues("dangling_o2o_source", "concat('O2O refers to unknown source object ''order:', o_orderkey, '''.')",
              "FROM orders WHERE o_orderstatus = 'P'", *_O2O)
V14 = _issues("dangling_o2o_target", "concat('O2O refers to unknown target object ''customer:', o_custkey, '''.')",
              "FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')", *_O2O)
ORACLES["v13_dangling_o2o_source"] = V13
ORACLES["v14_dangling_o2o_target"] = V14
for _key, _code, _kind, _from in (
    ("v15_duplicate_e2o", "duplicate_e2o", "E2O", "po"), ("v16_duplicate_o2o", "duplicate_o2o", "O2O", "order"),
):
    ORACLES[_key] = _issues(
        _code, f"concat('{_kind} relation (''', a, ''', ''', b, ''', ''contains'') occurs more than once.')",
        f"FROM (SELECT concat('{_from}:', l_orderkey) AS a, concat('part:', l_partkey) AS b FROM lineitem) GROUP BY a, b HAVING count(*) > 1",
        f"'{_kind.lower()}'", "a", "b", "'contains'")
ORACLES["validate"] = f"WITH {D1} {V01} UNION ALL {V05} UNION ALL {V07} UNION ALL {V09}"
ORACLES["validate_clean"] = "SELECT CAST(0 AS BIGINT) AS n_issues"
ORACLES["build"] = """
SELECT t.table, t.n_rows, TRUE AS valid FROM (
  SELECT 'event_types' AS "table", CAST(7 AS BIGINT) AS n_rows UNION ALL SELECT 'object_types', 6
  UNION ALL SELECT 'events', (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem)
  UNION ALL SELECT 'objects', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer)
    + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders)
  UNION ALL SELECT 'e2o', (SELECT count(*) FROM events) + 2 * (SELECT count(*) FROM orders) + 3 * (SELECT count(*) FROM lineitem)
  UNION ALL SELECT 'o2o', (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
    + (SELECT count(*) FROM nation)) t
"""
ORACLES["s_shape_violations"] = """
SELECT 'events' AS "table", v.field, v.error_class, v.message, count(*) AS n
FROM events e JOIN (VALUES
  ('view', 'Event.id', 'ValueError', 'Event.id must not be empty'),
  ('click', 'Event.time', 'TypeError', 'Event.time must be a datetime'),
  ('error', 'EventAttr.value', 'ValueError', 'EventAttr.value must be finite'),
  ('purchase', 'EventAttr.value', 'TypeError', 'EventAttr.value must be str, datetime, int, float, or bool'),
  ('signup', 'Event attribute names', 'ValueError', 'Event attribute names must not contain duplicates')
) v(event_type, field, error_class, message) ON v.event_type = e.event_type
GROUP BY v.field, v.error_class, v.message
"""
ORACLES["b_utc_normalize"] = f"SELECT {EV} AS id, {ISO.format('ts')} AS time FROM events"
ORACLES["b_sort_type_attrs"] = """
SELECT type, row_number() OVER (PARTITION BY type ORDER BY name, value_type) AS pos, name, value_type FROM (VALUES
  ('region', 'name', 'string'), ('nation', 'name', 'string'), ('customer', 'name', 'string'), ('customer', 'acctbal', 'float'),
  ('customer', 'mktsegment', 'string'), ('supplier', 'name', 'string'), ('supplier', 'acctbal', 'float'), ('part', 'name', 'string'),
  ('part', 'brand', 'string'), ('part', 'type', 'string'), ('part', 'size', 'integer'), ('part', 'retailprice', 'float'),
  ('order', 'status', 'string'), ('order', 'totalprice', 'float')) t(type, name, value_type)
"""
ORACLES["b_sort_event_attrs"] = f"""
SELECT {EV} AS id, a.pos, a.name, a.tag FROM events,
  (VALUES (CAST(1 AS BIGINT), 'k', 'integer'), (2, 'value', 'float')) a(pos, name, tag)
"""
ORACLES["b_sort_object_history"] = f"""
SELECT id, row_number() OVER (PARTITION BY id ORDER BY name, t, value) AS pos, name, {ISO.format('t')} AS time, value FROM (
  SELECT concat('customer:', o_custkey) AS id, 'status' AS name, o_orderdate AS t, o_orderstatus AS value FROM orders
  UNION ALL SELECT concat('customer:', o_custkey), 'priority', o_orderdate, o_orderpriority FROM orders)
"""
ORACLES["b_order_types"] = """
SELECT row_number() OVER (ORDER BY name) AS ord, name, CAST(n AS BIGINT) AS n_attributes FROM (VALUES
  ('click', 2), ('error', 2), ('purchase', 2), ('signup', 2), ('view', 2), ('place_order', 2), ('ship_item', 6)) t(name, n)
"""
ORACLES["b_order_events"] = f"""
SELECT row_number() OVER (ORDER BY id, l_shipdate) AS ord, id, {ISO.format('l_shipdate')} AS time
FROM (SELECT concat('li:', l_orderkey, ':', l_linenumber) AS id, l_shipdate FROM lineitem)
"""
ORACLES["b_order_objects"] = """
SELECT row_number() OVER (ORDER BY id) AS ord, id, 'part' AS type FROM (SELECT concat('partname:', p_name) AS id FROM part)
"""
for _key, _a, _b, _from in (("b_order_e2o", "event", "object", "po"), ("b_order_o2o", "source", "target", "order")):
    ORACLES[_key] = f"""
SELECT row_number() OVER (ORDER BY a, b) AS ord, a AS {_a}, b AS {_b}, 'contains' AS qualifier
FROM (SELECT concat('{_from}:', l_orderkey) AS a, concat('part:', l_partkey) AS b FROM lineitem)
"""
ORACLES["b_value_key"] = f"""
SELECT o_orderkey, 'string' AS tag, o_orderpriority AS text FROM orders
UNION ALL SELECT o_orderkey, 'integer', CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT o_orderkey, 'boolean', CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END FROM orders
UNION ALL SELECT o_orderkey, 'time', {ISO.format('o_orderdate')} FROM orders
UNION ALL SELECT o_orderkey, 'float', concat('0x1.0000000000000p+', o_orderkey % 60) FROM orders
"""
_WARN = "undeclared_event_attribute"
ORACLES["r_valid"] = """
SELECT * FROM (VALUES ('dirty_event_types', FALSE),
  ('repeated_object_ids', (SELECT count(*) = count(DISTINCT p_name) FROM part)), ('types_only', TRUE)) t(log, valid)
"""
ORACLES["r_errors"] = f"WITH {D1} {V01} UNION ALL {V05} UNION ALL {V09}"
ORACLES["r_warnings"] = f"WITH {D1} SELECT * REPLACE ('warning' AS level) FROM ({V07})"
ORACLES["r_has_code"] = """
SELECT * FROM (VALUES ('duplicate_event_type', TRUE), ('undeclared_event_type', (SELECT bool_or(event_type = 'error') FROM events)),
  ('dangling_e2o_event', FALSE), ('duplicate_o2o', FALSE)) t(code, present)
"""
ORACLES["r_summary_by_code"] = f"SELECT code, count(*) AS n FROM ({ORACLES['validate']}) GROUP BY code"

ORACLES["c_project_events_by_object"] = f"""
WITH {USERS} SELECT object, 'customer' AS object_type, event, activity, {ISO.format('time')} AS time, 'actor' AS qualifier FROM users
"""
ORACLES["c_reconstruct_trace"] = f"""
WITH {USERS} SELECT object, event, activity, row_number() OVER (PARTITION BY object ORDER BY time, event) AS position FROM users
"""
ORACLES["c_check_relation_integrity"] = f"{V13} UNION ALL {V14}"
ORACLES["c_check_temporal_constraints"] = f"""
WITH {USERS}, firsts AS (
  SELECT o.object, min(struct_pack(t := time, e := event)) FILTER (WHERE activity = 'signup') AS a,
    min(struct_pack(t := time, e := event)) FILTER (WHERE activity = 'purchase') AS b
  FROM (SELECT concat('customer:', c_custkey) AS object FROM customer) o LEFT JOIN users u ON u.object = o.object GROUP BY o.object)
SELECT object, 'signup' AS "before", 'purchase' AS "after", CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a > b END AS violated,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'computed' ELSE 'unavailable' END AS status FROM firsts
UNION ALL SELECT object, 'view', 'refund', NULL, 'unavailable' FROM firsts
"""
ORACLES["c_temporal_unavailable"] = """
SELECT DISTINCT concat('conversation:', conv_id) AS object, 'user' AS "before", 'assistant' AS "after",
  CAST(NULL AS BOOLEAN) AS violated, 'unavailable' AS status FROM conversations
"""
_COMPLETE = f"""{USERS}, steps(activity) AS (
  SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) t(activity)),
complete AS (
  SELECT o.object, count(DISTINCT u.activity) AS observed, CAST(6 AS BIGINT) AS required,
    coalesce((SELECT string_agg(s.activity, ',' ORDER BY s.activity) FROM steps s
      WHERE NOT EXISTS (SELECT 1 FROM users x WHERE x.object = o.object AND x.activity = s.activity)), '') AS missing,
    count(u.event) AS n_events
  FROM (SELECT concat('customer:', c_custkey) AS object FROM customer) o LEFT JOIN users u ON u.object = o.object
  GROUP BY o.object)"""
ORACLES["c_lifecycle_completeness"] = f"""
WITH {_COMPLETE} SELECT object, CASE WHEN n_events > 0 THEN observed END AS observed, required,
  CASE WHEN n_events > 0 THEN missing END AS missing, CASE WHEN n_events > 0 THEN 'computed' ELSE 'unavailable' END AS status
FROM complete
"""
ORACLES["c_evidence_lineage"] = f"""
WITH {LINES}, reached AS (
  SELECT c_custkey, 'object' AS kind, concat('customer:', c_custkey) AS node, 0 AS distance FROM customer
  UNION ALL SELECT c_custkey, 'object', concat('order:', o_orderkey), 1 FROM customer JOIN orders ON o_custkey = c_custkey
  UNION ALL SELECT c_custkey, 'event', concat('po:', o_orderkey), 2 FROM customer JOIN orders ON o_custkey = c_custkey
  UNION ALL SELECT c_custkey, 'event', line, 2 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lines ON l_orderkey = o_orderkey)
SELECT concat('customer:', c_custkey) AS seed, kind, node, CAST(distance AS BIGINT) AS distance FROM reached
"""
_RUNS = f"""{USERS}, placed AS (
  SELECT *, row_number() OVER w AS position, CAST(props::JSON->>'k' AS BIGINT) AS k,
    lag(activity) OVER w AS prior, lead(activity) OVER w AS later FROM users WINDOW w AS (PARTITION BY object ORDER BY time, event)),
runs AS (
  SELECT *, sum(CASE WHEN prior IS NULL OR prior <> activity THEN 1 ELSE 0 END) OVER (PARTITION BY object ORDER BY position) AS run
  FROM placed),
retry AS (
  SELECT object, activity, min(position) AS first_position, count(*) AS attempts, NOT bool_or(later IS NULL) AS recovered,
    count(DISTINCT k) > 1 AS strategy_changed FROM runs GROUP BY object, run, activity HAVING count(*) > 1)"""
ORACLES["c_retry_recovery_metrics"] = f"""
WITH {_RUNS} SELECT object, activity, first_position, attempts, recovered, strategy_changed, 'computed' AS strategy_status FROM retry
"""


def _finding(name: str, subject: str, detail: str, ref: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS finding, {subject} AS subject, {detail} AS detail, 'computed' AS status, "
        f"{ref} AS computation_refs {source}"
    )


ORACLES["f_missing_lifecycle_activity"] = f"WITH {_COMPLETE} " + _finding(
    "missing_lifecycle_activity", "c.object", "s.activity", "concat('lifecycle:', c.object)",
    "FROM complete c, steps s WHERE c.n_events > 0 AND NOT EXISTS (SELECT 1 FROM users u WHERE u.object = c.object AND u.activity = s.activity)")
ORACLES["f_temporal_order_violation"] = _finding(
    "temporal_order_violation", "object", "'signup>purchase'", "concat('temporal:', object, ':signup>purchase')",
    f"FROM ({ORACLES['c_check_temporal_constraints']}) WHERE violated")
_PLACE = "concat_ws('|', at_0, at_1, at_2, at_3)"
ORACLES["f_dangling_relation"] = _finding(
    "dangling_relation", _PLACE, "code", f"concat('integrity:', {_PLACE})", f"FROM ({V13} UNION ALL {V14})")
ORACLES["f_orphan_evidence"] = _finding(
    "orphan_evidence", "concat('customer:', c_custkey)", "'customer'", "concat('lineage:customer:', c_custkey)",
    "FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
ORACLES["f_ambiguous_provenance"] = _finding(
    "ambiguous_provenance", "target", "'contains'", "concat('lineage:', target, ':contains')",
    "FROM (SELECT concat('part:', l_partkey) AS target FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1)")
ORACLES["f_false_completion_risk"] = f"WITH {_COMPLETE} " + _finding(
    "false_completion_risk", "object", "missing", "concat('lifecycle:', object)",
    "FROM complete c WHERE missing <> '' AND n_events > 0 AND EXISTS (SELECT 1 FROM users u WHERE u.object = c.object AND u.activity = 'purchase')")
ORACLES["f_ineffective_retry"] = f"WITH {_RUNS} " + _finding(
    "ineffective_retry", "object", "activity", "concat('retries:', object, ':', first_position)", "FROM retry WHERE NOT recovered")
ORACLES["p_process_state"] = f"""
WITH {_COMPLETE}, order_facts AS (SELECT * FROM ({ORACLES['c_check_temporal_constraints']}) WHERE "before" = 'signup'),
last AS (SELECT object, arg_max(activity, struct_pack(t := time, e := event)) AS stage FROM users GROUP BY object)
SELECT c.object, l.stage, CASE WHEN n_events > 0 THEN observed END AS completed, c.required,
  CASE WHEN n_events > 0 THEN missing END AS missing,
  CASE WHEN f.status = 'computed' THEN CAST(f.violated AS BIGINT) END AS violations,
  CAST(f.status <> 'computed' AS BIGINT) AS unresolved,
  CASE WHEN n_events > 0 THEN 'computed' ELSE 'unavailable' END AS status
FROM complete c LEFT JOIN order_facts f ON f.object = c.object LEFT JOIN last l ON l.object = c.object
"""
ORACLES["a_analyze"] = " UNION ALL ".join(
    f"SELECT finding, count(*) AS n FROM ({ORACLES[k]}) GROUP BY finding"
    for k in ("f_missing_lifecycle_activity", "f_temporal_order_violation", "f_orphan_evidence", "f_false_completion_risk", "f_ineffective_retry")
)

ORACLES["x_flatten"] = f"""
SELECT concat('customer:', o_custkey) AS "case", concat('po:', o_orderkey) AS event, 'place_order' AS activity,
  {ISO.format('o_orderdate')} AS time FROM orders
"""
ORACLES["x_oc_dfg"] = f"""
WITH {USERS}, steps AS (
  SELECT activity AS source, lead(activity) OVER w AS target, epoch_us(lead(time) OVER w) - epoch_us(time) AS gap FROM users
  WINDOW w AS (PARTITION BY object ORDER BY time, event))
SELECT 'customer' AS object_type, source, target, count(*) AS n, round(avg(gap) / 1000000, 3) AS mean_seconds
FROM steps WHERE target IS NOT NULL GROUP BY source, target
"""
ORACLES["x_start_end_activities"] = f"""
WITH {USERS}, placed AS (
  SELECT activity, row_number() OVER (PARTITION BY object ORDER BY time, event) AS p, count(*) OVER (PARTITION BY object) AS n FROM users)
SELECT 'customer' AS object_type, activity, count(*) FILTER (WHERE p = 1) AS starts, count(*) FILTER (WHERE p = n) AS ends
FROM placed GROUP BY activity HAVING count(*) FILTER (WHERE p = 1 OR p = n) > 0
"""
ORACLES["x_object_summary"] = f"""
WITH {LINES}, steps AS (
  SELECT concat('order:', o_orderkey) AS object, concat('po:', o_orderkey) AS event, 'place_order' AS activity, o_orderdate AS time FROM orders
  UNION ALL SELECT concat('customer:', o_custkey), concat('po:', o_orderkey), 'place_order', o_orderdate FROM orders
  UNION ALL SELECT concat('customer:', o_custkey), line, 'ship_item', l_shipdate FROM lines JOIN orders ON l_orderkey = o_orderkey),
partners AS (SELECT a.object, count(DISTINCT b.object) AS n FROM steps a JOIN steps b ON a.event = b.event AND a.object <> b.object GROUP BY a.object)
SELECT s.object, string_agg(activity, '>' ORDER BY time, event) AS lifecycle, {ISO.format('min(time)')} AS start,
  {ISO.format('max(time)')} AS "end", count(*) AS n_events, coalesce(max(p.n), 0) AS n_partners
FROM steps s LEFT JOIN partners p ON p.object = s.object GROUP BY s.object
"""
ORACLES["x_object_interactions"] = """
SELECT concat('customer:', o_custkey) AS object, concat('order:', o_orderkey) AS other, CAST(1 AS BIGINT) AS n_events FROM orders
"""
ORACLES["x_activities_of_types"] = """
SELECT 'customer' AS object_type, event_type AS activity, count(*) AS n_events, count(DISTINCT user_id) AS n_objects
FROM events JOIN customer ON c_custkey = user_id GROUP BY event_type
UNION ALL SELECT 'customer', 'place_order', count(*), count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'order', 'place_order', count(*), count(*) FROM orders
UNION ALL SELECT 'order', 'ship_item', count(*), count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'part', 'ship_item', count(*), count(DISTINCT l_partkey) FROM lineitem JOIN part ON p_partkey = l_partkey
UNION ALL SELECT 'supplier', 'ship_item', count(*), count(DISTINCT l_suppkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
"""
ORACLES["x_extended_table"] = """
SELECT concat('po:', o_orderkey) AS event, 'place_order' AS activity, concat('customer:', o_custkey) AS customer,
  concat('order:', o_orderkey) AS "order" FROM orders
"""
ORACLES["x_log_summary"] = """
SELECT 'rows' AS measure, 'event_types' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'rows', 'object_types', 0
UNION ALL SELECT 'rows', 'events', count(*) FROM orders
UNION ALL SELECT 'rows', 'objects', (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)
UNION ALL SELECT 'rows', 'e2o', 2 * count(*) FROM orders UNION ALL SELECT 'rows', 'o2o', count(*) FROM orders
UNION ALL SELECT 'events_of_type', 'place_order', count(*) FROM orders
UNION ALL SELECT 'objects_of_type', 'customer', count(*) FROM customer
UNION ALL SELECT 'objects_of_type', 'order', count(*) FROM orders
"""
ORACLES["x_is_ocel20"] = """
SELECT * FROM (VALUES ('o2o', TRUE), ('qualifiers', TRUE), ('object_history', FALSE)) t(feature, present)
"""
ORACLES["x_event_graph"] = f"""
WITH {USERS}, steps AS (SELECT event AS source, lead(event) OVER (PARTITION BY object ORDER BY time, event) AS target FROM users)
SELECT DISTINCT source, target FROM steps WHERE target IS NOT NULL
"""
ORACLES["x_process_executions_cc"] = """
SELECT concat('po:', o_orderkey) AS event, min(concat('po:', o_orderkey)) OVER (PARTITION BY o_custkey) AS execution FROM orders
"""
ORACLES["x_process_executions_leading"] = """
SELECT concat('order:', a.o_orderkey) AS execution, concat('order:', a.o_orderkey) AS object, concat('po:', a.o_orderkey) AS event FROM orders a
UNION SELECT concat('order:', a.o_orderkey), concat('customer:', a.o_custkey), concat('po:', b.o_orderkey)
FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey
"""
ORACLES["x_variants"] = f"""
WITH {LINES}, steps AS (
  SELECT o_orderkey, concat('po:', o_orderkey) AS event, 'place_order' AS activity, o_orderdate AS time FROM orders
  UNION ALL SELECT o_orderkey, line, 'ship_item', l_shipdate FROM lines JOIN orders ON o_orderkey = l_orderkey),
traces AS (SELECT concat('order:', o_orderkey) AS object, string_agg(activity, '>' ORDER BY time, event) AS variant FROM steps GROUP BY o_orderkey)
SELECT variant, count(*) AS n, min(object) AS example FROM traces GROUP BY variant
"""
ORACLES["x_statistics"] = f"""
WITH {USERS}, placed AS (
  SELECT *, epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY object ORDER BY time, event)) AS gap FROM users),
k AS (SELECT activity, object, count(*) AS k, sum(gap) AS gap, count(gap) AS gaps FROM placed GROUP BY activity, object)
SELECT 'customer' AS object_type, activity, CAST(sum(k) AS BIGINT) AS n_events, count(*) AS n_objects,
  count(*) FILTER (WHERE k > 1) AS rework, round(CAST(sum(gap) AS DOUBLE) / sum(gaps) / 1000000, 2) AS mean_sojourn_seconds
FROM k GROUP BY activity
"""
ORACLES["x_service_times"] = """
SELECT 'ship_item' AS activity, count(*) AS n_events, round(avg(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000, 2) AS mean_seconds,
  'computed' AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'place_order', 0, NULL, 'unavailable'
"""
ORACLES["x_graph_variants"] = f"""
WITH {LINES}, steps AS (
  SELECT o_orderkey, concat('po:', o_orderkey) AS event, 'place_order' AS activity, o_orderdate AS time FROM orders
  UNION ALL SELECT o_orderkey, line, 'ship_item', l_shipdate FROM lines JOIN orders ON o_orderkey = l_orderkey),
traces AS (
  SELECT o_orderkey, string_agg(activity, '>' ORDER BY time, event) AS variant, count(*) AS n_events, min(event) AS execution
  FROM steps GROUP BY o_orderkey)
SELECT count(*) AS n, n_events, min(execution) AS example FROM traces GROUP BY variant, n_events
"""
ORACLES["x_eventually_follows"] = f"""
WITH {USERS}, placed AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY time, event) AS p FROM users)
SELECT a.activity AS source, b.activity AS target, count(DISTINCT a.object) AS n
FROM placed a JOIN placed b ON a.object = b.object AND a.p < b.p GROUP BY a.activity, b.activity
"""
ORACLES["x_object_state_at"] = """
WITH day AS (
  SELECT o_custkey, o_orderdate + CASE WHEN o_custkey % 2 = 0 THEN INTERVAL 100 DAY ELSE INTERVAL 0 DAY END AS since, max(o_orderstatus) AS status
  FROM orders GROUP BY o_custkey, o_orderdate)
SELECT concat('po:', o.o_orderkey) AS event, concat('customer:', o.o_custkey) AS object, max_by(d.status, d.since) AS value
FROM orders o JOIN day d ON d.o_custkey = o.o_custkey AND d.since <= o.o_orderdate GROUP BY o.o_orderkey, o.o_custkey
"""
_HELD = "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"
_ROWS = """rows AS (
  SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')"""
_END = ("'e2o'", "concat('po:', o_orderkey)", "concat('customer:', o_custkey)", "'placed_by'")
ORACLES["v_both_ends"] = f"WITH {_ROWS} " + " UNION ALL ".join([
    _issues("dangling_e2o_event", "concat('E2O refers to unknown event ''po:', o_orderkey, '''.')",
            "FROM rows WHERE o_orderpriority = '2-HIGH'", *_END),
    _issues("dangling_e2o_object", "concat('E2O refers to unknown object ''customer:', o_custkey, '''.')",
            f"FROM rows WHERE o_custkey NOT IN ({_HELD})", *_END),
    _issues("duplicate_e2o", "concat('E2O relation (''po:', o_orderkey, ''', ''customer:', o_custkey, ''', ''placed_by'') occurs more than once.')",
            "FROM orders WHERE o_orderpriority = '1-URGENT'", *_END),
])
ORACLES["d_relation_digest"] = """
WITH rows AS (
  SELECT 'e2o' AS "table", sha256(concat('{"event":"po:', l_orderkey, '","object":"part:', l_partkey, '","qualifier":"contains"}')) AS digest FROM lineitem
  UNION ALL
  SELECT 'o2o', sha256(concat('{"source":"order:', l_orderkey, '","target":"part:', l_partkey, '","qualifier":"contains"}')) FROM lineitem),
counted AS (SELECT "table", digest, count(*) AS n FROM rows GROUP BY ALL),
l6 AS (
  SELECT "table", digest[1:6] AS bucket, sum(n) AS n, sha256(string_agg(concat(digest, ':', n), ',' ORDER BY concat(digest, ':', n))) AS digest
  FROM counted GROUP BY 1, 2),
l4 AS (
  SELECT "table", bucket[1:4] AS b, sum(n) AS n, sha256(string_agg(concat(bucket, '=', digest), ',' ORDER BY concat(bucket, '=', digest))) AS digest
  FROM l6 GROUP BY 1, 2),
l2 AS (
  SELECT "table", b[1:2] AS bucket, sum(n) AS n, sha256(string_agg(concat(b, '=', digest), ',' ORDER BY concat(b, '=', digest))) AS digest
  FROM l4 GROUP BY 1, 2)
SELECT "table", CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(concat(bucket, '=', digest), ',' ORDER BY concat(bucket, '=', digest))) AS digest
FROM l2 GROUP BY 1
"""
_BROKEN = [
    *[(t, f"{r}.name", "ValueError", f"{r}.name must not be empty", "k % 5 = 0") for t, r in (("event_types", "EventType"), ("object_types", "ObjectType"))],
    *[(t, "Attribute.type", "TypeError", "Attribute.type must be ValueType", "k % 3 = 0") for t in ("event_types", "object_types")],
    *[(t, f"{r} attribute names", "ValueError", f"{r} attribute names must not contain duplicates", "k % 2 = 0")
      for t, r in (("event_types", "EventType"), ("object_types", "ObjectType"))],
    ("objects", "Object.id", "ValueError", "Object.id must not be empty", "k % 5 = 1"),
    ("objects", "Object.type", "TypeError", "Object.type must be a string", "k % 5 = 2"),
    ("objects", "ObjectAttr.value", "TypeError", "ObjectAttr.value must be str, datetime, int, float, or bool", "k % 3 = 0"),
    ("objects", "ObjectAttr.time", "TypeError", "ObjectAttr.time must be a datetime", "k % 4 = 0"),
    ("objects", "Object attribute assignments", "ValueError", "Object attribute assignments must not contain duplicates", "k % 2 = 0"),
    ("e2o", "E2O.event", "ValueError", "E2O.event must not be empty", "k % 5 = 3"),
    ("e2o", "E2O.qualifier", "TypeError", "E2O.qualifier must be a string", "k % 5 = 4"),
    ("o2o", "O2O.target", "TypeError", "O2O.target must be a string", "k % 5 = 0"),
]
ORACLES["s_shape_all_tables"] = "WITH rows AS (SELECT n_nationkey AS k FROM nation) " + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{f}' AS field, '{e}' AS error_class, '{m}' AS message, count(*) AS n FROM rows WHERE {w}"""
    for t, f, e, m, w in _BROKEN
)
