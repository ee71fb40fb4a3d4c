"""Cycles in graphs of many shapes, and graphs of many buildings in one table."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.operators import graph, review
from assayer.operators.cycles import cycle_nodes, strong_parts
from assayer.sources.scratch import Scratch

EDGE = "property_id string, floor string, seq long, child string, parent string, child_raw string, parent_raw string, ref_type string, confidence double, conflict boolean, review_required boolean, review_reason string"


def on_cycles(edges):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = set()
    for a in list(after):
        seen, todo = set(), list(after[a])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += after[x]
        if a in seen:
            out.add(a)
    return out


def made_graph(seed):
    rng = random.Random(seed)
    n = rng.choice([12, 40, 90])
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.3, 1.8])))}
    for r in range(3):  # rings that hang together, with ways in and out
        k = rng.choice([1, 2, 3, 7])
        edges |= {(1000 + 100 * r + i, 1000 + 100 * r + (i + 1) % k) for i in range(k)} | {(1000 + 100 * r, 1100 + 100 * r), (1000 + 100 * r, rng.randrange(n))}
    return sorted(edges)


@pytest.mark.parametrize("seed", range(4))
def test_cycles_by_brute_force(spark, seed):
    edges = made_graph(seed)
    frame = spark.createDataFrame([*edges, *edges[:5], (None, 1), (1, None)], "child long, parent long")
    assert {r["node"] for r in cycle_nodes(frame, local=0).collect()} == on_cycles(edges) == {r["node"] for r in cycle_nodes(frame).collect()}


@pytest.mark.parametrize("seed", range(30))
def test_strong_parts_by_brute_force(seed):
    edges = [(a, b) for a, b in made_graph(seed) if a != b]
    assert {n for n, _ in strong_parts(edges)} == on_cycles(edges)


def test_cycles_of_long_shapes_take_few_tables(spark):
    rings = "SELECT id AS child, id + 1 AS parent FROM range(20000) WHERE id % 2 = 0 UNION ALL SELECT id, id - 1 FROM range(20000) WHERE id % 2 = 1 UNION ALL SELECT id, id + 1 FROM range(19999) WHERE id % 2 = 1"
    ladder = "SELECT id AS child, ((id div 2 + 1) % 10000) * 2 + x AS parent FROM range(20000), (VALUES (0L), (1L)) v(x)"
    for edges in (rings, ladder):
        scratch = Scratch()
        assert cycle_nodes(spark.sql(edges), scratch, local=0).count() == 20_000
        assert scratch.written < 60
        assert len(scratch._at) == 1  # the table that the result is read from


def test_cycles_stay_in_their_building(spark):
    rows = [("p1", "a", "b"), ("p1", "b", "a"), ("p2", "a", "b"), ("p3", "b", "a"), ("p3", "a", "a"), (None, "x", "y"), (None, "y", "x")]
    frame = spark.createDataFrame(rows, "property_id string, child string, parent string")
    for local in (0, 100):
        got = {tuple(r) for r in cycle_nodes(frame, local=local).collect()}
        assert got == {("p1", "a"), ("p1", "b"), ("p3", "a"), (None, "x"), (None, "y")}


def test_no_cycles(spark):
    frame = spark.createDataFrame([(1, 2), (2, 3)], "child long, parent long")
    assert cycle_nodes(frame).count() == cycle_nodes(frame, local=0).count() == cycle_nodes(frame.where("false")).count() == 0


def test_names_resolve_in_their_building(spark):
    edge = lambda prop, seq, child, parent: (prop, "1", seq, child, parent, "", "", "airRef", 0.9, False, False, "")
    edges = spark.createDataFrame([edge("b1", 1, "VAV 7", "AHU 2 1"), edge("b2", 1, "VAV 7", "AHU-2-1"), edge("b3", 1, "VAV 7", "AHU 2 1"), edge("b2", 2, "AHU 2 1", "VAV-7")], EDGE)
    names = [("b1", "AHU_2-01", "AHU"), ("b1", "VAV_7", "VAV"), ("b2", "AHU_2_1", "AHU"), ("b2", "VAV_07", "VAV"), ("b3", "VAV_7", "VAV"), ("b4", "VAV_9", "VAV")]
    equipment = spark.createDataFrame([(p, "1", n, t) for p, n, t in names], "property_id string, floor string, name string, type string")
    v = graph.validate(edges, equipment, spark.createDataFrame([("nothing", "AHU_2-01")], "alias string, name string"), save=Scratch())
    ends = {(r["property_id"], r["seq"], r["role"]): (r["status"], r["canonical"]) for r in v.ends.collect()}
    assert ends["b1", 1, "parent"] == ("resolved", "AHU_2-01") and ends["b2", 1, "parent"] == ("resolved", "AHU_2_1") and ends["b3", 1, "parent"] == ("unresolved", None)
    got = {r["property_id"]: r for r in graph.report(v).collect()}
    assert {p: (r["edge_count"], r["accepted_edge_count"], r["equipment_count"], r["unresolved_endpoint_count"], r["ambiguous_endpoint_count"], r["orphan_count"], r["passed"]) for p, r in got.items()} == {
        "b1": (1, 1, 2, 0, 0, 0, True), "b2": (2, 2, 2, 0, 0, 0, False), "b3": (1, 0, 1, 1, 0, 1, False), "b4": (0, 0, 1, 0, 0, 1, False)
    }
    assert {(r["property_id"], r["nodes"][0]) for r in v.findings.where("check_id = 'cycle'").collect()} == {("b2", "AHU_2_1"), ("b2", "VAV_07")}
    assert {r["property_id"]: '"passed":true' in r["document"] for r in graph.report_document(v).collect()} == {"b1": True, "b2": False, "b3": False, "b4": False}


def test_scoped_merges_and_lookups(spark):
    d = lambda *rows: spark.createDataFrame(rows, "property_id string, child string, ref_type string, parent string")
    first, second = d(("p", "a", "airRef", "x"), (None, "n", "airRef", "x")), d(("p", "a", "airRef", "y"), ("q", "a", "airRef", "y"), (None, "n", "airRef", "z"))
    assert sorted((r["property_id"], r["parent"]) for r in graph.merge_secondary(first, second).collect()) == [("", "x"), ("p", "x"), ("q", "y")]
    assert {tuple(r) for r in graph.candidates(d(("p", "a", "airRef", "OAVAV_1"), ("q", "OAVAV_1", "airRef", "z"))).collect()} <= {("p", "OAVAV_1")}
    names = spark.createDataFrame([("p", "a"), ("q", "y")], "property_id string, name string")
    lost = review.missing_endpoints(second.where("property_id IS NOT NULL").withColumn("seq", F.lit(1)), names)
    assert {(r["property_id"], r["role"], r["name"]) for r in lost.collect()} == {("p", "parent", "y"), ("q", "child", "a")}


def test_shared_aliases_stay_out_of_edges(spark):
    """Many edges under one alias of many units: only findings list the units, and rows of edges don't grow with them."""
    equipment = spark.range(300).select(F.format_string("AHU_2-%03d", "id").alias("name"), F.lit("AHU").alias("type"))
    aliases = equipment.select(F.lit("unit 1").alias("alias"), "name")
    edges = spark.range(40).select(
        F.col("id").alias("seq"), F.format_string("VAV %d", "id").alias("child"), F.lit("AHU 2 7").alias("parent"), F.lit("").alias("child_raw"), F.lit("unit 1").alias("parent_raw"),
        F.lit("airRef").alias("ref_type"), F.lit(0.9).alias("confidence"), F.lit(False).alias("conflict"), F.lit(False).alias("review_required"), F.lit("").alias("review_reason"),
    )
    scratch = Scratch()
    v = graph.validate(edges, equipment, aliases, save=scratch)
    assert not any(f.dataType.simpleString().startswith("array") for df in scratch.frames() for f in df.schema if "_child_status" in df.columns or f.name == "raw")
    assert "targets" not in v.ends.columns
    torn = v.findings.where("check_id = 'ambiguous_node'").collect()
    assert len(torn) == 1 and len(torn[0]["nodes"]) == 302 and torn[0]["message"].endswith("referenced by 40 edge(s)")
    ends = graph.end_counts(edges, equipment, aliases).where("role = 'parent'").collect()
    assert [(r["identity"], r["status"], r["n"]) for r in ends] == [("AHU_2_7", "ambiguous", 40)]
    plan = graph.end_counts(edges, equipment, aliases)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_set" not in graph.accepted_edges(edges, equipment, aliases)._jdf.queryExecution().optimizedPlan().toString()
    assert len(graph.resolve(edges, equipment, aliases).where("role = 'parent'").first()["targets"]) == 300


class Watched(Scratch):
    """Keeps the plans of its tables."""

    def __init__(self):
        super().__init__()
        self.plans = []

    def __call__(self, df):
        self.plans.append(df._jdf.queryExecution().executedPlan().toString())
        return super().__call__(df)


def test_rings_end_when_they_are_told(spark):
    """Steps follow the length of the rings, not the number of nodes, and chains beside them are followed to their ends."""
    rings = "SELECT id AS child, CASE WHEN id % 5 = 4 THEN id - 4 ELSE id + 1 END AS parent FROM range(5000)"
    chain = "SELECT id + 100000 AS child, id + 100001 AS parent FROM range(70) UNION ALL SELECT 100000L, 100069L UNION ALL SELECT 100069L, 200000L UNION ALL SELECT 200000L, 100000L"
    scratch = Watched()
    got = {r["node"] for r in cycle_nodes(spark.sql(rings), scratch, local=0).collect()}
    assert got == set(range(5000)) and scratch.written < 14
    assert not any("Broadcast" in p for p in scratch.plans)
    got = {r["node"] for r in cycle_nodes(spark.sql(f"{rings} UNION ALL {chain}"), local=0).collect()}
    assert got == set(range(5000)) | set(range(100000, 100070)) | {200000}
