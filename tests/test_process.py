import random
from collections import Counter, defaultdict
from datetime import timedelta
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from objtrail.api import E2O, O2O, Event, EventAttr, Object, Plan, analyze, frames
from objtrail.operators import extras, process
from objtrail.operators.components import connected_components
from tests.logs import NOON


def made(spark):
    steps = [("e1", "start", 0, 1), ("e2", "try", 1, 1), ("e3", "try", 1, 2), ("e4", "end", 3, 1), ("e5", "try", 4, 1), ("e6", "try", 5, 1)]
    return frames(
        spark,
        events=[Event(i, t, NOON + timedelta(hours=h), (EventAttr("how", how),)) for i, t, h, how in steps],
        objects=[Object("a", "case"), Object("b", "case"), Object("c", "doc")],
        e2o=[E2O(i, "a", "q") for i, *_ in steps] + [E2O("e1", "a", "again"), E2O("e1", "c", "q"), E2O("e9", "b", "q")],
        o2o=[O2O("c", "a", "x"), O2O("a", "c", "x"), O2O("b", "a", "x")],
    )


def test_traces_hold_an_event_once_and_order_ties_by_id(spark):
    rows = process.traces(made(spark), "case").orderBy("position").collect()
    assert [(r.event, r.position) for r in rows] == [(f"e{i}", i) for i in range(1, 7)]
    assert process.project_events(made(spark), "case").count() == 7


def test_missing_facts_are_unavailable(spark):
    log = made(spark)
    rows = {r.object: r for r in process.lifecycle_completeness(log, ["start", "end", "close"], "case").collect()}
    assert (rows["a"].observed, rows["a"].missing, rows["a"].status) == (2, ["close"], "computed")
    assert (rows["b"].observed, rows["b"].missing, rows["b"].status) == (None, None, "unavailable")
    order = process.temporal_constraints(log, [("end", "start"), ("start", "close")], "case").collect()
    assert {(r.object, r.before, r.violated, r.status) for r in order} == {
        ("a", "end", True, "computed"), ("a", "start", None, "unavailable"),
        ("b", "end", None, "unavailable"), ("b", "start", None, "unavailable"),
    }


def test_lineage_ends_on_cycles(spark):
    seeds = spark.createDataFrame([("a",)], "seed string")
    rows = {(r.kind, r.node): r.distance for r in process.lineage(made(spark), seeds, 9).collect()}
    assert rows[("object", "a")] == 0
    assert rows[("event", "e1")] == rows[("object", "c")] == rows[("object", "b")] == 1
    assert rows[("event", "e9")] == 2


def test_retries(spark):
    rows = process.retries(made(spark), "case", "how").orderBy("first_position").collect()
    assert [(r.activity, r.attempts, r.recovered, r.strategy_changed, r.strategy_status) for r in rows] == [
        ("try", 2, True, True, "computed"), ("try", 2, False, False, "computed"),
    ]
    unknown = process.retries(made(spark), "case").first()
    assert unknown.strategy_changed is None and unknown.strategy_status == "unavailable"


def test_every_finding_has_references(spark):
    result = analyze(made(spark), Plan("case", ("start", "close"), (("end", "start"),), "end", "how"))
    rows = result.findings.collect()
    assert all(len(r.computation_refs) > 0 for r in rows)
    assert {r.finding for r in rows} == {
        "missing_lifecycle_activity", "dangling_relation", "temporal_order_violation", "false_completion_risk", "ineffective_retry",
        "ambiguous_provenance",
    }
    state = {r.object: r for r in result.state.collect()}
    assert (state["a"].stage, state["a"].violations) == ("try", 1)
    assert state["b"].stage is None and state["b"].violations is None
    assert analyze(made(spark), Plan("case", ("start",))).facts["temporal"].status == "unavailable"
    assert analyze(None, Plan("case", ())).status == "invalid_input"


def test_extensions(spark):
    log = made(spark)
    assert extras.variants(log, "case").first().variant == "start>try>try>end>try>try"
    edges = {(r.source, r.target): r.n for r in extras.directly_follows(log).where("object_type = 'case'").collect()}
    assert edges == {("start", "try"): 1, ("try", "try"): 2, ("try", "end"): 1, ("end", "try"): 1}
    assert {r.execution for r in extras.executions_connected(log).collect()} == {"e1"}
    assert extras.eventually_follows(log, "case").where("source = 'try' AND target = 'end'").first().n == 1


def test_components_of_long_chains_and_stars(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1100).select(F.col("id").alias("a"), F.lit(1000).cast("long").alias("b"))
    got = {r.node: r.component for r in connected_components(chain.union(star)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert connected_components(chain.limit(0)).count() == 0


def variants_by_hand(links, types, times, rounds):
    """Counter of (n, n_events, example): labels as nested tuples, so none is like another by chance."""
    home = {e: e for e in types}
    for _ in types:
        for o in {o for _, o in links}:
            low = min(home[e] for e, x in links if x == o)
            home |= {e: low for e, x in links if x == o}
    follow = set()
    for o in {o for _, o in links}:
        trace = sorted({(times[e], e) for e, x in links if x == o})
        follow |= {(a[1], b[1]) for a, b in pairwise(trace)}
    label, numbers = dict(types), {}
    for _ in range(rounds):
        wide = {
            e: (label[e], tuple(sorted(label[b] for a, b in follow if a == e)), tuple(sorted(label[a] for a, b in follow if b == e)))
            for e in label
        }
        # numbered through all rounds, so that labels stay short and sort
        label = {e: "%06d" % numbers.setdefault(w, len(numbers)) for e, w in wide.items()}
    found = defaultdict(list)
    for x in set(home.values()):
        found[tuple(sorted(label[e] for e in home if home[e] == x))].append(x)
    return Counter((len(xs), len(k), min(xs)) for k, xs in found.items())


@pytest.mark.parametrize("gathered", [64, 5, 0])
def test_graph_variants_are_those_by_hand(spark, monkeypatch, gathered):
    monkeypatch.setattr(extras, "GATHERED", gathered)
    dice = random.Random(7)
    types, times, links, loose = {}, {}, [], []
    for case in range(60):
        events = [f"e{dice.randrange(10**6):06d}-{case}" for _ in range(dice.randint(1, 5))]
        types |= {e: dice.choice("ab") for e in events}
        times |= {e: NOON + timedelta(hours=dice.randint(0, 3)) for e in events}
        objects = [f"o{case}-{i}" for i in range(dice.randint(1, 2))]
        links += [(e, o) for e in events for o in objects if dice.random() < 0.8]
    # an event that is named like an object, objects that do not exist and events that do not
    types["o0-0"], times["o0-0"] = "a", NOON
    loose = [("o0-0", "gone"), (min(types), "gone"), (max(types), "gone"), ("none", "o1-0")]
    log = frames(
        spark,
        events=[Event(e, types[e], times[e]) for e in types],
        objects=[Object(o, "x") for o in sorted({o for _, o in links} | {"o1-0"})],
        e2o=[E2O(e, o, q) for e, o in links for q in ("q", "r")] + [E2O(e, o, "q") for e, o in loose],
    )
    got = Counter((r.n, r.n_events, r.example) for r in extras.graph_variants(log, rounds=3).collect())
    assert got == variants_by_hand(links, types, times, 3)
    assert max(n for n, *_ in got) > 5 and max(k for _, k, _ in got) > 3


def test_graph_variants_label_executions_that_are_the_same_once(spark, monkeypatch):
    kept, plain = defaultdict(list), extras.Scratch.store

    def counted(self, df, label, *rest):
        table = plain(self, df, label, *rest)
        kept[label].append(table.count())
        return table

    monkeypatch.setattr(extras.Scratch, "store", counted)
    cases = [(f"c{i}", ("a", "b", "b") if i % 2 else ("a", "b")) for i in range(50)]
    log = frames(
        spark,
        events=[Event(f"{c}-{k}", t, NOON + timedelta(hours=k)) for c, ts in cases for k, t in enumerate(ts)],
        objects=[Object(c, "case") for c, _ in cases],
        e2o=[E2O(f"{c}-{k}", c, "q") for c, ts in cases for k in range(len(ts))],
    )
    got = {(r.n, r.n_events, r.example) for r in extras.graph_variants(log, rounds=2).collect()}
    assert got == {(25, 2, "c0-0"), (25, 3, "c1-0")}
    assert kept["labels"] == [5, 5, 5]
