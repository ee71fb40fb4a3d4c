"""Operators on small fixtures with known results."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import labels as L
from assayer.functions import vocab as V
from assayer.operators import graph, images, inject, picks, points, reconcile, responses, review, runs
from assayer.plans import stages
from assayer.queries import save
from assayer.sources import readers, sinks
from assayer.streaming import incremental


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("label, key", [
    ("AHU-02A", "AHU_02A"), ("AHU_02A", "AHU_02A"), ("OAVAV_02_01", "OAVAV_2_1"), ("VAVRH_2_01", "VAVRH_2_1"), ("DEV37159_EAVAV_1_01", "EAVAV_1_1"),
    ("AHU 02 A", "AHU_2_A"), ("DEV123_", None), ("", None), ("x 000", "X_0"), ("A " + "0" * 44 + "1", "A_1"), (None, None),
])
def test_canonical_key(spark, label, key):
    assert one(spark, L.canonical_key(F.lit(label).cast("string"))) == key


@pytest.mark.parametrize("key, raw, name, review", [
    ("AHU_2_1", "AHU", "AHU_2-01", False), ("AHU_02A", "AHU", "AHU_2-A", True), ("FCU_PM_2_1", "FCU", "FCU_2-PM_01", False),
    ("VAVRH_2_1", "VAVRH", "VAV-RH-HW_2-01", True), ("AHU", "AHU", "AHU_2", True), ("", "AHU", "", True), ("AHU_2", "AHU", "AHU_2-02", True), ("AHU_2_117", "AHU", "AHU_2-117", False),
])
def test_canonical_name(spark, key, raw, name, review):
    kind, got, flag, why = V.classified(F.lit(key), F.lit(raw), F.lit("2"))
    r = spark.range(1).select(got.alias("n"), flag.alias("f"), why.alias("w")).first()
    assert (r["n"], r["f"]) == (name, review) and bool(r["w"]) == review


def test_mapped_type(spark):
    kind, flag, why = V.mapped_type(F.col("t"))
    d = spark.createDataFrame([("ahu",), ("WIDGET",), (None,), ("FPTU",)], "t string").select(kind, flag, why)
    assert [tuple(r)[:2] for r in d.collect()] == [("AHU", False), ("WIDGET", True), ("UNRESOLVED", True), ("FPTU", True)]


TOPIC = "property_id string, floor string, seq int, raw_label string, inferred_raw_type string, review_required boolean, review_reason string"
DRAWING = "property_id string, floor string, seq int, raw_label string, llm_proposed_canonical_name string, equipment_type string, source_filename string, run_status string, review_required boolean, review_reason string"


def sides(spark):
    t = [("p", "F2", 1, "DEV1_AHU_02_A", "AHU", False, ""), ("p", "F2", 2, "AHU 2 A", "FCU", True, "late"), ("p", "F2", 3, "VAV_2_1", "VAV", True, ""), ("p", "F2", 4, "FCU_2_1", "FCU", False, ""), ("q", "F2", 5, "FCU_2_9", "FCU", False, "")]
    d = [("p", "F2", 1, "AHU 02 A", "AHU_02A", "AHU", "b.png", "succeeded", False, ""), ("p", "F2", 2, "AHU-2-A", "", "VAV", "a.png", "", True, "r2"), ("p", "F2", 3, "VAV 2 1", "", "OAVAV", "a.png", "succeeded", False, ""), ("p", "F2", 4, "X 9", "", "", "a.png", "failed", False, ""), ("p", "F2", 5, "FCU-2-9", "", "FCU", "a.png", "succeeded", False, ""), ("p", "F2", 6, "DEV1_", "", "FCU", "a.png", "succeeded", False, "")]
    return spark.createDataFrame(t, TOPIC), spark.createDataFrame(d, DRAWING)


def test_reconcile(spark):
    t, d = sides(spark)
    rows = {(r["property_id"], r["canonical_key"]): r for r in reconcile.reconcile(t, d).collect()}
    a = rows["p", "AHU_2_A"]
    assert (a["discrepancy_category"], a["status"], a["source_files"], a["review_reason"]) == ("type_mismatch", "review_required", "a.png", "type mismatch: topics=AHU drawings=VAV; r2")
    assert a["topics_raw_label"] == "DEV1_AHU_02_A" and a["canonical_name"] == "AHU_02_A"
    assert rows["p", "AHU_02A"]["discrepancy_category"] == "drawing_only"  # by its proposed name, not by its label
    v = rows["p", "VAV_2_1"]
    assert v["discrepancy_category"] == "type_mismatch" and v["review_reason"].endswith(reconcile.UNEXPLAINED["topics"])
    assert rows["p", "FCU_2_9"]["discrepancy_category"] == "drawing_only" and rows["q", "FCU_2_9"]["discrepancy_category"] == "topics_only"
    assert len(rows) == 6
    good, bad = readers.checked(reconcile.reconcile(t, d), readers.unit_rules())
    assert bad.count() == 0
    again = reconcile.reconcile(t.orderBy(F.rand(1)).repartition(3), d.orderBy(F.rand(2)).repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, reconcile.reconcile(t, d).collect()))


def test_drawings_are_keyed_by_their_proposed_name(spark):
    topic = lambda label, kind="AHU", flag=False, why="": ("p", "F2", 1, label, kind, flag, why)
    drawn = lambda seq, label, name, kind="AHU", status="succeeded", flag=False, why="", file="a.png": ("p", "F2", seq, label, name, kind, file, status, flag, why)

    def one(topics, drawings):
        return {r["canonical_key"]: r for r in reconcile.reconcile(spark.createDataFrame(topics, TOPIC), spark.createDataFrame(drawings, DRAWING)).collect()}

    got = one([topic("AHU-02A")], [drawn(1, "AHU 02 A", "AHU_02A")])
    assert list(got) == ["AHU_02A"] and (got["AHU_02A"]["discrepancy_category"], got["AHU_02A"]["status"]) == ("matched", "settled")
    got = one([topic("AHU-02A", flag=True)], [drawn(1, "AHU 02 A", "AHU_02A")])["AHU_02A"]
    assert (got["discrepancy_category"], got["status"], got["review_reason"]) == ("matched", "review_required", reconcile.UNEXPLAINED["topics"])
    got = one([topic("AHU-02A")], [drawn(1, "AHU 02 A", "AHU_02A"), drawn(2, "x", "AHU-02A", flag=True, why=" low ", file=" b.png "), drawn(3, "y", "AHU_02A", flag=True, why="low")])["AHU_02A"]
    assert (got["status"], got["review_reason"], got["source_files"], got["drawing_raw_label"]) == ("review_required", "low", "a.png;b.png", "AHU 02 A")
    assert list(one([topic("AHU-02A")], [drawn(1, "AHU 02 A", "AHU_02A", status="parse_failed")])) == ["AHU_02A"]


def test_contested_and_report(spark):
    t, d = sides(spark)
    c = spark.createDataFrame([("p", "F2", 1, "AHU 2 A", "first"), ("p", "F2", 2, "AHU_02_A", "")], "property_id string, floor string, seq int, raw_label string, review_reason string")
    out = stages.building(t, d, c, seq=F.lit(1))
    r = out["report"].where("equipment_id = 'AHU_2_A'").first()
    assert (r["status"], r["severity_hint"]) == ("floor_ambiguous", "medium")
    n = out["normalized"].where("canonical_key = 'AHU_2_A'").first()
    assert n["review_reason"].startswith(reconcile.CONTESTED)


def test_names_collide(spark):
    rows = [("p", "F2", k, k, "AHU", "matched", "settled", False, "") for k in ("AHU_2_1", "AHU_02_1")]
    d = spark.createDataFrame(rows, "property_id string, floor string, canonical_key string, canonical_name string, equipment_type string, discrepancy_category string, status string, review_required boolean, review_reason string")
    assert {r["canonical_name"] for r in reconcile.canonicalize(d).collect()} == {"AHU_2_1", "AHU_02_1"}


def test_ref_fold_order(spark):
    canon = spark.createDataFrame([("p", "F", 1, "X_1", "OLD_7", False, "")], "property_id string, floor string, seq int, canonical_name string, canonical_key string, review_required boolean, review_reason string")
    rows = [("p", "F", i, "zz", "X-01", p, "", "airRef", False, "", False, "") for i, p in enumerate("ABAA")] + [("p", "F", 9, "old 07", "", "P", "", "hotWaterRef", True, "", False, ""), ("p", "F", 10, "X 1", "", "", "q", "hotWaterRef", False, "", False, ""), ("p", "F", 11, "X 1", "", "Q", "", "systemRef", False, "", False, "")]
    e = spark.createDataFrame(rows, "property_id string, floor string, seq int, child string, child_raw string, parent string, parent_raw string, ref_type string, conflict boolean, conflict_reason string, review_required boolean, review_reason string")
    r = reconcile.fold_refs(canon, e).first()
    assert (r["airRef"], r["hotWaterRef"], r["review_required"]) == ("A;B;A;A", "", True) and r["review_reason"].endswith("multiple airRef parents inferred: A;B;A;A; hotWaterRef conflict: evidence points to P")
    assert tuple(reconcile.ref_join_counts(canon, e).first()) == (4, 1)
    assert reconcile.stage_counts(reconcile.fold_refs(canon, e).withColumn("status", F.lit("settled")), e).first().asDict() == {"units": 1, "settled": 1, "flagged": 1, "refs_filled": 1, "joined_edges": 4, "valid_uncolumned_edges": 1}


def test_coverage_and_examples(spark):
    e, a = spark.createDataFrame([("a",), ("b",)], "x string"), spark.createDataFrame([("a",), ("a",), ("c",)], "x string")
    assert {tuple(r) for r in points.coverage(e, a, "x").collect()} == {("missing", "b", 1), ("unexpected", "c", 1), ("duplicate", "a", 1)}
    d = spark.range(100).select(F.lit("missing").alias("k"), F.format_string("%03d", "id").alias("v"))
    assert picks.top_examples(d, "k", "v").first()["more"] == 97


EV = "seq int, source_image string, page_title string, evidence_kind string, object_raw string, link_state string, detail string"


def test_extrapolation_and_fusion(spark):
    rows = [(1, "i1", "OAVAV_02_01", "linked_widget_doas", "DOAS_22_1", "live_synced", ""), (2, "i2", "OAVAV_02_09", "linked_widget_doas", "DOAS_22_1", "offline", ""), (3, "i3", "FCU_2_1", "linked_widget_oavav", "OAVAV_02_06", "offline", "")]
    e = graph.fuse(spark.createDataFrame(rows, EV))
    x = e.where("evidence_kind = 'pattern_extrapolation'").collect()
    assert [(r["child"], r["parent"], r["confidence"], r["review_required"]) for r in x] == [("OAVAV_2-06", "DOAS_22_1", 0.55, True)]
    assert graph.fuse(spark.createDataFrame(rows[1:], EV)).where("evidence_kind = 'pattern_extrapolation'").count() == 0
    v = graph.fuse(spark.createDataFrame([(1, "i", "AHU 02 A", "valve_points", "CHW+WW", "n/a", "")], EV)).collect()
    assert {(r["child"], r["parent"], r["confidence"]) for r in v} == {("AHU_2-A", "CHW-PLANT_1", 0.9), ("AHU_2-A", "HW-PLANT_1", 0.9)}


def test_union_edges(spark):
    rows = [(1, "c", "r", "p", 0.6, False, None, "d1"), (2, "c", "r", "p", 0.9, True, "ambiguous tag", "d2"), (3, "c", "r", "p", None, True, "later", "d1")]
    r = graph.union_edges(spark.createDataFrame(rows, "seq int, child string, ref_type string, parent string, confidence double, conflict boolean, conflict_reason string, source_drawing string")).first()
    assert (r["confidence"], r["conflict"], r["conflict_reason"], r["source_drawings"], r["tile_hits"]) == (0.9, True, "ambiguous tag", "d1;d2", 3)


EDGE = "seq int, child string, parent string, child_raw string, parent_raw string, ref_type string, confidence double, conflict boolean, review_required boolean, review_reason string"


def test_validate(spark):
    eq = spark.createDataFrame([("AHU_2-01", "AHU"), ("VAV_2-01", "VAV"), ("VAV_2-02", "VAV"), ("CHW-PLANT_1", "CHW-PLANT")], "name string, type string")
    rows = [(1, "VAV_2-01", "AHU_2-01", "", "", "airRef", 0.9, False, False, ""), (2, "VAV-2-02", "AHU_2_1", "", "", "airRef", 0.9, False, False, ""), (3, "AHU_2-01", "CHW-PLANT_1", "", "", "chilledWaterRef", 0.9, False, False, "")]
    v = graph.validate(spark.createDataFrame(rows, EDGE), eq, save=save)
    assert graph.report(v).first().asDict() == {"edge_count": 3, "accepted_edge_count": 3, "equipment_count": 4, "alias_resolution_count": 2, "unresolved_endpoint_count": 0, "ambiguous_endpoint_count": 0, "error_count": 0, "orphan_count": 0, "review_item_count": 0, "passed": True}
    bad = rows[:1] + [(2, "AHU_2-01", "VAV_2-01", "", "", "airRef", 0.5, False, False, "why"), (3, "ghost 1", "AHU_2-01", "Ghost 01", "", "airRef", None, True, False, ""), (4, "", "AHU_2-01", None, "", "airRef", None, False, False, "")]
    v = graph.validate(spark.createDataFrame(bad, EDGE), eq, spark.createDataFrame([("twin", "AHU_2-01"), ("twin", "VAV_2-02"), ("twin", "nobody")], "alias string, name string"), spark.createDataFrame([("GHOST-1",)], "name string"), save=save)
    f = v.findings.collect()
    assert {k: sum(r["check_id"] == k for r in f) for k in {r["check_id"] for r in f}} == {"cycle": 2, "ref_type_sanity": 2, "unknown_node": 2, "unresolved_endpoint": 2, "review_item": 2, "orphan_terminal": 1}
    told = {r["message"]: list(r["nodes"]) for r in f if r["check_id"] == "unknown_node"}
    assert told == {f"unresolved endpoint ['Ghost 01', 'ghost 1']: {graph.CANDIDATE_NOTE}; referenced by 1 edge(s)": ["Ghost 01", "ghost 1"], f"unresolved endpoint ['<blank child>']: {graph.ABSENT_NOTE}; referenced by 1 edge(s)": ["<blank child>"]}
    doc = json.loads(graph.report_document(v).first()["document"])
    assert doc["unresolved_endpoint_count"] == 2 and len(doc["errors"]) == doc["error_count"] == 6 and not doc["passed"] and doc["orphans"][0]["nodes"] == ["VAV_2-02"]
    twins = [(1, "VAV_2-01", "twin", "", "", "airRef", 0.9, False, False, "")]
    v = graph.validate(spark.createDataFrame(twins, EDGE), eq, spark.createDataFrame([("twin", "AHU_2-01"), ("twin", "VAV_2-02")], "alias string, name string"), save=save)
    assert "endpoint labels ['twin'] resolve to multiple canonical units ['AHU_2-01', 'VAV_2-02']; referenced by 1 edge(s)" in {r["message"] for r in v.findings.collect()}
    assert graph.report(graph.validate(spark.createDataFrame([], EDGE), eq, save=save)).first()["orphan_count"] == 2


def test_cycles_of_any_length(spark):
    assert graph.cycle_nodes(spark.sql("SELECT id AS child, (id + 1) % 50000 AS parent FROM range(50000) UNION ALL SELECT id + 100000, id FROM range(200) UNION ALL SELECT id + 200000, id + 200001 FROM range(300)"), save).count() == 50_000
    rng, edges = random.Random(5), set()
    for _ in range(150):
        edges.add((rng.randrange(90), rng.randrange(90)))
    edges |= {(200 + i, 200 + (i + 1) % 7) for i in range(7)} | {(207, 200), (300, 300), (301, 300), (400, 401), (401, 400), (401, 402), (402, 401)}
    reach = {n: {b for a, b in edges if a == n} for n in {x for e in edges for x in e}}
    while True:
        more = {n: r | {y for x in r for y in reach[x]} for n, r in reach.items()}
        if more == reach:
            break
        reach = more
    got = {r["node"] for r in graph.cycle_nodes(spark.createDataFrame(sorted(edges), "child long, parent long"), save).collect()}
    assert got == {n for n in reach if n in reach[n]} and len(got) > 15


def test_responses(spark):
    good = '{"equipment": [{"raw_label": "A 1", "equipment_type": "AHU", "confidence": "0.9"}, {"raw_label": "A-01", "equipment_type": "AHU", "confidence": 0.95}]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, good + " x"), (4, "[]"), (5, None), (6, '{"equipment": []}'), (7, good.replace("0.95", "2")), (8, good.replace("AHU", "ZZ"))]
    d = responses.parsed(spark.createDataFrame(rows, "image int, raw_text string"))
    got = {r["image"]: r["run_status"] for r in d.collect()}
    assert got == {1: "succeeded", 2: "succeeded", 3: "parse_failed", 4: "parse_failed", 5: "parse_failed", 6: "validation_failed", 7: "validation_failed", 8: "validation_failed"}
    flat = responses.flattened(d).where("image = 1").collect()
    assert [(r["confidence"], r["first_seq"], r["review_required"]) for r in flat] == [(0.95, 0, False)]


def test_runs(spark):
    p = runs.price_list(spark)
    u = spark.createDataFrame([("small", False, 1_000_000, 1_000_000, 0, 0), ("small", True, 1_000_000, 1_000_000, 0, 0), ("small-x", False, 0, 0, 1_000_000, None), ("nope", False, 9, 9, 9, 9)], "model string, batch boolean, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long")
    assert {(r["model"], r["batch"]): r["cost"] for r in runs.usage_costs(u, p).collect()} == {("small", False): 6.0, ("small", True): 3.0, ("small-x", False): 0.1, ("nope", False): 0.0}
    assert runs.usage_costs(u, p, totals=True).where("is_total = 1").first()["cost"] == 9.1
    t = spark.createDataFrame([(1, "blank", 0), (2, "parsed", 0), (3, "parse_failed", 0), (4, "parsed", 2), (4, "blank", 0), (5, "parsed", 1), (5, "transport_failed", 0)], "image int, outcome string, labels int")
    assert {r["image"]: r["status"] for r in runs.drawing_status(t).collect()} == {1: "succeeded", 2: "validation_failed", 3: "parse_failed", 4: "succeeded", 5: "validation_failed"}


def test_tiles_and_plan(spark):
    d = spark.createDataFrame([(1, 1000, 800), (2, 12600, 9000)], "id int, width int, height int")
    boxes = images.tile_boxes(d)
    assert {r["id"]: r["count"] for r in boxes.groupBy("id").count().collect()} == {1: 1, 2: 24}
    assert boxes.where("id = 2").agg(F.max("right"), F.max("bottom")).first()[:] == (12600, 9000)
    f = spark.createDataFrame([("a.png", "png"), ("../b.png", "png"), ("c.txt", "unsupported"), ("d.pdf", "pdf")], "relative_path string, file_type string")
    plan = images.preservation_plan(f, spark.createDataFrame([("raw/pdf/d.pdf",)], "key string"), "raw")
    assert {r["relative_path"]: r["status"] for r in plan.collect()} == {"a.png": "planned", "../b.png": "rejected", "c.txt": "skipped", "d.pdf": "conflict"}


def test_review(spark):
    rows = [("s", "equipment", "A", "approve", 1, "a1"), ("s", "equipment", "A", "reject", 2, "a2"), ("s", "equipment", "B", "clear", 2, "a3"), ("s", "equipment", "C", "edit", 1, "a4")]
    live = review.live_actions(spark.createDataFrame(rows, "session_id string, item_type string, item_key string, action string, created_at int, action_id string"))
    n = review.session_counts(live, spark.createDataFrame([("s", 1)], "session_id string, n_total int")).first()
    assert (n["n_approved"], n["n_rejected"], n["n_pending"]) == (1, 1, 0)
    o = review.overlay(spark.createDataFrame([("x", '{"zone": " ", "odd": 1}')], "zone string, p string"), F.col("p"), ["zone"]).first()
    assert (o["unknown"], o["blank"]) == ("odd", True)


EVENT = "session_id string, item_type string, item_key string, action string, payload string, reason string, reviewer string, applied boolean, created_at int, action_id string"
MASTER = "equipment_id long, property_id string, name string, floorRef string, zone string, spaceRef string, airRef long, chilledWaterRef long, hotWaterRef long, condenserWaterRef long, systemRef long"


def ledger(spark, events, sessions=("s",), master=((1, "p", "AHU_2-01", "2", "old", None), (2, "p", "VAV_02_7", "2", None, None), (3, "q", "AHU_2-01", "2", None, None))):
    items = [("p", "A", "AHU_2-1", "AHU", "Floor_02"), ("p", "N", "FCU_2-05", "FCU", "Floor_02"), ("p", "V", "VAV_2-07", "VAV", "Floor_02"), ("p", "C", "CHW-PLANT_1", "CHW-PLANT", "Floor_02"), ("p", "W", "AHU_2-001", "AHU", "Floor_02")]
    edges = [("p", "N|airRef|A", "FCU_2-5", "AHU_2-01", "airRef"), ("p", "V|airRef|X", "VAV_2-07", "nobody_1", "airRef"), ("p", "V|spaceRef|A", "VAV_2-07", "AHU_2-01", "spaceRef"), ("p", "V|airRef|A", "VAV_2_7", "AHU_2-01", "airRef")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    opened = [(s, "p", "Floor_02", "open", "boss") for s in sessions]
    log = [(*(e[:4]), e[4], e[5], None, False, k, f"a{k}") for k, e in enumerate(events)]
    return (
        frame(opened, "session_id string, property_id string, floor string, status string, created_by string"), frame(log, EVENT),
        frame(items, "property_id string, item_key string, canonical_name string, equipment_type string, floor string"),
        frame(edges, "property_id string, item_key string, child string, parent string, ref_type string"), frame([(*m, None, None, None, None, None) for m in master], MASTER),
    )


def test_commit_and_again(spark):
    sessions, events, items, edges, master = ledger(spark, [
        ("s", "equipment", "A", "edit", '{"zone": "north"}', "moved"), ("s", "equipment", "N", "approve", None, None), ("s", "equipment", "V", "reject", None, "no such unit"),
        ("s", "relationship", "N|airRef|A", "approve", None, None), ("s", "equipment", "C", "approve", None, None), ("s", "relationship", "V|airRef|A", "edit", '{"parent": "AHU_2-1"}', "shorter"),
    ])
    out = review.commit(sessions, events, items, edges, master, save=save)
    assert out["problems"].count() == 0
    rows = {r["name"]: r for r in out["master"].where("property_id = 'p'").collect()}
    assert set(rows) == {"AHU_2-1", "VAV_02_7", "FCU_2-05", "CHW-PLANT_1"}
    assert (rows["AHU_2-1"]["equipment_id"], rows["AHU_2-1"]["zone"], rows["AHU_2-1"]["change"]) == (1, "north", "update")
    assert (rows["FCU_2-05"]["change"], rows["FCU_2-05"]["airRef"], rows["FCU_2-05"]["floorRef"], rows["CHW-PLANT_1"]["floorRef"]) == ("insert", 1, "2", None)
    assert (rows["VAV_02_7"]["airRef"], rows["VAV_02_7"]["change"]) == (1, "update") and out["master"].where("property_id = 'q'").first()["change"] == "keep"
    log = {r["item_key"]: r for r in out["corrections"].collect()}
    assert set(log) == {"A", "V", "V|airRef|A"} and log["V"]["corrected"] is None and json.loads(log["A"]["corrected"])["zone"] == "north" and json.loads(log["A"]["original"])["canonical_name"] == "AHU_2-1" and log["A"]["reviewer"] == "boss"
    assert tuple(out["counts"].first()) == ("s", 5, 3) and out["applied"].count() == 6
    again = review.commit(sessions, events.withColumn("applied", F.lit(True)), items, edges, out["master"].drop("change"), save=save)
    assert again["master"].where("change <> 'keep'").count() == 0 and again["corrections"].count() == again["applied"].count() == again["problems"].count() == 0
    assert sorted(map(str, again["master"].drop("change").collect())) == sorted(map(str, out["master"].drop("change").collect()))


@pytest.mark.parametrize("events, problem", [
    ([("equipment", "A", "edit", '{"color": "red"}', "x")], "unsupported edit field(s): color"),
    ([("equipment", "A", "edit", '{"canonical_name": " "}', "x")], "canonical_name must be a non-empty string"),
    ([("equipment", "A", "edit", '{"canonical_name": null}', "x")], "canonical_name must be a non-empty string"),
    ([("equipment", "A", "edit", '{"canonical_name": 7}', "x")], "canonical_name must be a non-empty string"),
    ([("equipment", "A", "reject", None, None)], "no reason given"),
    ([("equipment", "A", "edit", '{"canonical_name": "VAV_2-7"}', "x")], "edited identity already belongs to another equipment row"),
    ([("equipment", "A", "approve", None, None), ("equipment", "W", "approve", None, None)], "several items map to one equipment row"),
    ([("relationship", "N|airRef|A", "approve", None, None)], "relationship endpoint is absent from equipment_details"),
    ([("relationship", "V|airRef|X", "approve", None, None)], "relationship endpoint is absent from equipment_details"),
    ([("relationship", "V|spaceRef|A", "approve", None, None)], "not an equipment-to-equipment production reference"),
    ([("equipment", "zz", "approve", None, None)], "no such item"),
    ([("point", "A", "approve", None, None)], "unsupported item type"),
])
def test_a_session_is_committed_whole_or_not_at_all(spark, events, problem):
    events = [("s", *e) for e in events] + [("t", "equipment", "C", "approve", None, None), ("s", "equipment", "V", "approve", None, None)]
    out = review.commit(*ledger(spark, events, ("s", "t")), save=save)
    assert problem in {r["problem"] for r in out["problems"].collect()} and {r["session_id"] for r in out["problems"].collect()} == {"s"}
    assert {(r["session_id"], r["item_key"]) for r in out["applied"].collect()} == {("t", "C")} and [r["name"] for r in out["master"].where("change <> 'keep'").collect()] == ["CHW-PLANT_1"]


def test_sessions_as_operations(spark):
    frame = spark.createDataFrame
    keys = frame([("p", "F", "equipment", k) for k in "ABC"], "property_id string, floor string, item_type string, item_key string")
    s = review.opened(frame([("s", "p", "F", "me"), ("u", "q", "F", "me")], "session_id string, property_id string, floor string, created_by string"), keys, keys.where("item_key = 'C'"))
    assert {(r["session_id"], r["status"], r["n_open"]) for r in s.collect()} == {("s", "open", 2), ("u", "open", 0)}
    schema = f"{EVENT}, source_item string"
    ev = frame([("s", "equipment", "A", "approve", None, None, None, True, 1, "a1", None), ("s", "equipment", "B", "reject", None, "no", None, False, 2, "a2", None), ("s", "relationship", "x", "approve", None, None, None, False, 3, "a3", "{}")], schema)
    state = lambda e: tuple(review.session_state(s.where("session_id = 's'"), e).select("n_approved", "n_rejected", "n_pending").first())
    assert state(ev) == (2, 1, 0)
    new = frame([("s", "equipment", "A", "reject", None, "no", None, False, 4, "a4", None), ("s", "equipment", "B", "approve", None, None, None, False, 5, "a5", None), ("gone", "equipment", "B", "approve", None, None, None, False, 6, "a6", None)], schema)
    good, refused = review.recorded(ev, new, s)
    assert [r["action_id"] for r in good.collect()] == ["a5"] and {r["rule"] for r in refused.collect()} == {"action is already applied and frozen", "session is not open"}
    assert state(ev.unionByName(good)) == (3, 0, 0)
    cleared = lambda *a: review.cleared(ev, *a, sessions=s.withColumn("status", F.when(F.col("session_id") == "u", "committed").otherwise("open")))
    assert state(ev.unionByName(cleared("s", 9, "c1", "relationship", " x ")[0])) == (1, 1, 0)
    assert state(ev.unionByName(cleared("s", 9, "c1")[0])) == (1, 0, 1) and cleared("s", 9, "c1")[1].count() == 0
    assert [r["rule"] for r in cleared("s", 9, "c1", "equipment", "A")[1].collect()] == ["action is already applied and frozen"]
    ev = ev.withColumn("session_id", F.lit("u"))
    assert {r["rule"] for r in cleared("u", 9, "c1")[1].collect()} == {"session is not open"} and cleared("u", 9, "c1")[0].count() == 0


def test_safe_correction_fields(spark):
    text = '{"raw_label": " AHU 1 ", "canonical_name": "", "equipment_type": ["x"], "topics_raw_label": 7, "drawing_raw_label": {"a": 1}, "note": "secret"}'
    assert json.loads(one(spark, review.safe_fields(F.lit(text)))) == {"raw_label": "AHU 1", "topics_raw_label": "7"}
    assert json.loads(one(spark, review.safe_fields(F.lit("[1]")))) == {}


def test_type_library(spark, tmp_path):
    (tmp_path / "types.jsonl").write_text("\n".join(json.dumps({"type": t, "point_types": ["Zone_airtemp"], "equip_tags": ["equip"]}) for t in [*V.LIBRARY_TYPES[1:], "KILN"]))
    library = readers.type_library(spark, str(tmp_path / "types.jsonl"))
    assert {tuple(r) for r in V.library_gaps(library).collect()} == {("KILN", "vocabulary"), (V.LIBRARY_TYPES[0], "library")} and library.first()["point_types"] == ["Zone_airtemp"]
    with pytest.raises(readers.ContractError, match="no equipment names"):
        readers.names(spark.createDataFrame([(" ", 1)], "n string, seq int"), "n")
    assert readers.topic_names(spark.createDataFrame([("a ",), ("a",), (" ",)], "n string"), "n").count() == 2


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,flag\nx,\n,true\n")
    s = T.StructType.fromDDL("flag boolean, name string")
    assert sorted(map(tuple, readers.csv_contract(spark, str(tmp_path / "a.csv"), s).collect()), key=str) == [(None, "x"), (True, "")]
    with pytest.raises(readers.ContractError):
        readers.csv_contract(spark, str(tmp_path / "a.csv"), T.StructType.fromDDL("name string"))
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2\n\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), T.StructType.fromDDL("a int"), False).count() == 1
    with pytest.raises(Exception, match="bad line"):
        readers.json_lines(spark, str(tmp_path / "l.jsonl"), T.StructType.fromDDL("a int"), True).collect()


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", True, ["x", "y"]), (None, False, [])], "n string, f boolean, l array<string>")
    sinks.write_csv(d, str(tmp_path / "c"), ["n", "f", "l"])
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(d, str(tmp_path / "c"), ["n", "f", "l"])
    assert {tuple(r) for r in readers.csv_some(spark, str(tmp_path / "c"), ["n", "f", "l", "z"]).collect()} == {("a", "true", "x;y", ""), ("", "false", "", "")}
    sinks.publish(d, str(tmp_path / "v"), "1")
    sinks.publish(d.limit(1), str(tmp_path / "v"), "2")
    assert sinks.published(spark, str(tmp_path / "v")).count() == 1
    c = spark.createDataFrame([(1,), (2,), (2,)], "correction_id int")
    assert [sinks.export_outbox(spark, c, str(tmp_path / "pool")) for _ in range(2)] == [2, 0]


def test_ladder(spark):
    d = inject.ladder(spark.range(4), [lambda r: "ok" if r["id"] == 0 else "no", lambda r: "ok" if r["id"] < 2 else "no"], "id", F.col("result") == "ok", save=save)
    assert {r["id"]: (r["tier"], r["trail"], r["accepted"]) for r in d.collect()} == {0: (0, "0", True), 1: (1, "0,1", True), 2: (1, "0,1", False), 3: (1, "0,1", False)}


def test_second_opinion(spark):
    rows = [(1, "VAV", True, "type unknown", "vav"), (2, "VAV", True, "other", "FCU"), (3, "VAV", False, "", "FCU"), (4, "VAV", True, "grouping and type ambiguous", "VAV"), (5, "VAV", True, "x", None)]
    d = points.second_opinion(spark.createDataFrame(rows, "id int, equipment_type string, review_required boolean, review_reason string, seen string"), F.col("seen"))
    got = {r["id"]: (r["review_required"], r["review_reason"]) for r in d.collect()}
    assert got == {
        1: (False, "type unknown; vision second pass CONFIRMED vav"), 2: (True, "other; vision second pass CONFLICT: sees FCU, topics say VAV"), 3: (False, ""),
        4: (True, f"grouping and type ambiguous; vision second pass CONFIRMED VAV; {points.RETAINED}"), 5: (True, f"x; {points.NOTHING_SEEN}"),
    }


@pytest.mark.parametrize("reason, only", [
    ("type 'FPTU' not evident in path label 'Floor context'", True), ("type ambiguous", True), ("Equipment  TYPE low confidence", True), ("type-only: look", True), ("[type-only]", True),
    ("grouping and type ambiguous", False), ("type mismatch; floor unclear", False), ("type", False), ("unknown", False), ("", False), (" ; ", False), (None, False), ("merged types; type conflict", False),
])
def test_type_only_reasons(spark, reason, only):
    assert one(spark, points.type_only(F.lit(reason).cast("string"))) == only


def test_tile_union_and_image_duplicates(spark):
    tiles = spark.createDataFrame([("i", 1, "OAVAV 2-1", 0.90), ("i", 2, "OAVAV2-1", 0.95), ("i", 3, "oavav2-1", 0.5)], "image string, seq int, canonical_name string, confidence double")
    assert sorted((r["canonical_name"], r["confidence"]) for r in responses.tile_union(tiles).collect()) == [("OAVAV2-1", 0.95), ("oavav2-1", 0.5)]
    item = lambda label, name, c: f'{{"raw_label": "{label}", "canonical_name": "{name}", "equipment_type": "FCU", "confidence": {c}}}'
    text = '{"equipment": [' + ", ".join([item("FCU 02 5", "FCU_02_5", 0.7), item("other", "fcu-2-5", 0.74), item("FCU-2-5", "", 0.6), item("--", "", 0.9)]) + "]}"
    rows = responses.flattened(responses.parsed(spark.createDataFrame([(1, text)], "image int, raw_text string"))).collect()
    assert sorted((r["raw_label"], r["confidence"], r["first_seq"], r["review_reason"]) for r in rows) == [("--", 0.9, 3, ""), ("other", 0.74, 0, "low_confidence")]


def test_identity_and_fingerprint(spark):
    for name, want in (("VAVRH_2-01", "VAV-RH-HW|2_1"), ("VAV-RH-HW_02_1", "VAV-RH-HW|2_1"), ("Pump 07", "PUMP_7"), ("AHU_", "AHU|")):
        assert one(spark, V.production_identity(F.lit(name))) == want
    assert one(spark, L.fingerprint(a=F.lit("xy"), b=F.lit(None).cast("string"))) == hashlib.sha256(b"a\x002\x00xy\x00b\x000\x00\x00").hexdigest()


def test_run_outcome(spark):
    runs_ = spark.createDataFrame([("succeeded",), ("succeeded",), ("parse_failed",)], "run_status string")
    routes = spark.createDataFrame([("a", "drawing"), ("b", "flat"), ("c", "flat")], "key string, route string")
    log = spark.createDataFrame([("a", "succeeded", 1), ("b", "succeeded", 1), ("b", "failed", 2)], "key string, status string, seq int")
    got = runs.outcome(runs_, routes, spark.createDataFrame([(0.9,), (0.75,), (0.1,), (None,)], "confidence double"), log).first().asDict()
    assert list(got.values()) == [3, 2, 1, 1, 2, 1, 2, 4, 2, 2]
    with pytest.raises(ValueError, match="Expected 3 topic contexts, found 2"):
        points.expect_contexts(spark.range(2), 3)


def test_groups_are_reduced_before_they_meet(spark):
    import pandas as pd

    part = lambda d: pd.DataFrame({"host": [d["host"].iloc[0]], "n": [len(d)], "most": [len(d)]})
    merge = lambda d: pd.DataFrame({"host": [d["host"].iloc[0]], "n": [d["n"].sum()], "most": [d["most"].max()]})
    d = spark.range(60_000).selectExpr("CASE WHEN id % 3 > 0 THEN 'h' WHEN id % 6 = 0 THEN 'g' END AS host", "id")
    got = {r["host"]: (r["n"], r["most"] <= 10_000) for r in inject.grouped(d, ["host"], part, "host string, n long, most long", merge).collect()}
    assert got == {"h": (40_000, True), "g": (10_000, True), None: (10_000, True)}

    tiles = spark.range(3000).selectExpr("id AS seq", "'c' AS child", "'r' AS ref_type", "'p' AS parent", "0.5D AS confidence", "id > 7 AS conflict", "'w' || id AS conflict_reason", "elt(int(id % 3) + 1, 'd2', 'd0', '') AS source_drawing")
    r = graph.union_edges(tiles)
    assert listed_over(r) and r.first()[3:] == (0.5, True, "w8", "d2;d0", 3000)
    drawn = spark.range(3000).selectExpr("'p' AS property_id", "'2' AS floor", "id AS seq", "'VAV 1' AS raw_label", "'' AS llm_proposed_canonical_name", "'VAV' AS equipment_type", "'f' || (id % 2) AS source_filename",
                                         "'' AS run_status", "true AS review_required", "'why' || (7 - id % 3) AS review_reason")
    topics = spark.createDataFrame([], "property_id string, floor string, seq long, raw_label string, inferred_raw_type string, review_required boolean, review_reason string")
    r = reconcile.reconcile(topics, drawn)
    assert listed_over(r) and "why7; why6; why5" in str(r.first()) and "f0;f1" in str(r.first())


def listed_over(df):
    """Whether rows are listed only after an aggregate has reduced them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(plan) if "collect_list(" in x)
    return any("Aggregate [" in x and "min(seq" in x for x in plan[at + 1 :])


def test_extrapolated_names_each_image_for_each_row(spark):
    rows = [(k, f"i{k % 2}", f"OAVAV_02_0{k % 3}", "linked_widget_doas", "DOAS_22_1", "offline", "") for k in range(5)] + [(9, "i9", "FCU_2_1", "linked_widget_oavav", "OAVAV_02_06", "offline", "")]
    r = graph.extrapolated(spark.createDataFrame(rows, EV))
    assert r.first()["source_drawing"] == "i0, i0, i0, i1, i1"
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(source_image" not in plan


def test_plain_calls_need_no_threads(spark):
    import threading

    def fn(row):
        if row["id"] == 2:
            raise ValueError("no")
        return str(threading.current_thread() is threading.main_thread())

    got = {r["id"]: (r["payload"], r["run_status"], r["error"]) for r in inject.extracted(spark.range(4), fn, "id", retries=1, pause=0.0).collect()}
    assert got == {0: ("True", "succeeded", None), 1: ("True", "succeeded", None), 2: (None, "parse_failure", "no"), 3: ("True", "succeeded", None)}


def test_drawings_are_ordered_without_a_window(spark):
    from assayer import queries

    for name in ("stage_counters", "reconcile_full_outer"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan


def test_shared_keys_meet_once(spark):
    """Candidates under a key that many units have are reduced before they meet."""
    units = spark.range(50).select(F.col("id").alias("unit_id"), F.format_string("DEV1_U_%d", "id").alias("raw_context"), F.lit("unit 1").alias("raw_label"))
    found = spark.range(60).select(F.col("id").alias("candidate_id"), F.when(F.col("id") == 7, "U 3").otherwise("UNIT_01").alias("raw_label"), F.lit("x").alias("canonical_name"), F.lit("AHU").alias("equipment_type"))
    assert points.only_candidate(units, found).where("detected IS NOT NULL").count() == 0
    one = points.only_candidate(units, found.where("candidate_id < 1"))
    assert one.where("detected = 'AHU'").count() == 50
    assert points.only_candidate(units.withColumn("raw_label", F.lit("")), found).where("detected IS NOT NULL").select("unit_id").first()["unit_id"] == 3
    # two aggregates: of the candidates of a key, and of the keys of a unit
    assert points.only_candidate(units, found)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
