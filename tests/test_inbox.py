"""Folds that keep what tells, and the review inbox over stored tables."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import reconcile
from assayer.plans import inbox, stages
from assayer.sources import readers, sinks

EDGE = "property_id string, floor string, seq int, child string, child_raw string, parent string, parent_raw string, ref_type string, conflict boolean, conflict_reason string, review_required boolean, review_reason string"


def folded(edges):
    """Row by row, in order: {(unit, ref): (cell, flag)} and {unit: notes}."""
    cells, notes = {}, {}
    for seq, unit, parent, ref, conflict, why, review, note in sorted(edges):
        cell, flag = cells.get((unit, ref), ("", False))
        said = None
        if conflict:
            flag, said = True, f"{ref} conflict: {why or 'evidence points to ' + parent}"
        elif cell and cell != parent:
            cell, flag = f"{cell};{parent}", True
            said = f"multiple {ref} parents inferred: {cell}"
        else:
            cell = parent
            if review:
                flag, said = True, f"{ref} {parent} inferred but unconfirmed: {note or 'flagged by relationship extraction'}"
        cells[unit, ref] = cell, flag
        if said:
            notes.setdefault(unit, []).append((seq, said))
    return cells, {u: "; ".join(n for _, n in sorted(ns)) for u, ns in notes.items()}


def canon(spark, names):
    return spark.createDataFrame([("p", "f", k, n, n, False, "") for k, n in enumerate(names)], "property_id string, floor string, seq int, canonical_key string, canonical_name string, review_required boolean, review_reason string")


def laid(spark, edges):
    return spark.createDataFrame([("p", "f", s, u, "", p, "", r, c, w, v, n) for s, u, p, r, c, w, v, n in edges], EDGE)


def test_folds_equal_a_walk_over_the_edges(spark):
    draw, units = random.Random(7), [f"U_{k}" for k in range(40)]
    parents = ["P 1", "P 2", "P 1;P 2", "P 2;P 1", "P 1;P 2;P 1"]
    edges = []
    for seq in range(3000):
        unit = draw.choice(units)
        steady = int(unit[2:]) % 4 != 0 or seq < 1500
        parent = "P 1" if steady else draw.choice(parents)
        edges.append((seq, unit, parent, draw.choice(["airRef", "hotWaterRef"]), draw.random() < 0.02, draw.choice(["", "torn"]), draw.random() < 0.02, draw.choice(["", "late"])))
    cells, notes = folded(edges)
    got = reconcile.fold_refs(canon(spark, units), laid(spark, edges).repartition(7)).collect()
    for r in got:
        for ref in ("airRef", "hotWaterRef"):
            assert r[ref] == cells.get((r["canonical_name"], ref), ("", False))[0]
        assert r["review_reason"] == notes.get(r["canonical_name"], "")
        assert r["review_required"] == any(cells.get((r["canonical_name"], ref), ("", False))[1] for ref in ("airRef", "hotWaterRef"))


def test_a_unit_with_a_third_of_all_edges_keeps_those_that_tell(spark):
    hot = [(s, "HOT_1", "P 1", "airRef", s % 1000 == 7, "torn", s % 1000 == 8, "late") for s in range(10_000)]
    rest = [(s, f"U_{s % 500}", "P 2", "airRef", False, "", False, "") for s in range(20_000)]
    names = ["HOT_1", *[f"U_{k}" for k in range(500)]]
    joined = reconcile.joined_edges(canon(spark, names), laid(spark, hot + rest))
    kept = {r["unit"]: r["n"] for r in reconcile.telling_edges(joined).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept.pop("HOT_1") == 21 and set(kept.values()) == {1} and len(kept) == 500
    row = reconcile.fold_refs(canon(spark, names), laid(spark, hot + rest)).where("canonical_name = 'HOT_1'").first()
    cells, notes = folded(hot)
    assert (row["airRef"], row["review_required"], row["review_reason"]) == (*cells["HOT_1", "airRef"], notes["HOT_1"])


def test_edges_without_a_place_come_first(spark):
    edges = [(None, "U_1", "P 2", "airRef", False, "", False, ""), (1, "U_1", "P 1", "airRef", False, "", False, ""), (2, "U_1", "P 1", "airRef", False, "", False, ""), (5, "U_1", "P 2", "airRef", False, "", False, "")]
    assert reconcile.fold_refs(canon(spark, ["U_1"]), laid(spark, edges)).first()["airRef"] == "P 2;P 1;P 1;P 2"
    assert reconcile.fold_refs(canon(spark, ["U_1"]), laid(spark, []).where("false")).first()["airRef"] == ""


def test_stored_tables_meet_without_a_shuffle(spark, tmp_path):
    units = spark.range(200).select(F.concat(F.lit("p"), F.col("id") % 3).alias("property_id"), F.lit("2").alias("floor"), F.concat(F.lit("AHU 0"), F.col("id")).alias("canonical_name"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("AHU_"), "id")).otherwise("").alias("canonical_key"), F.lit("a.png; ;b.png").alias("source_files"))
    rows = spark.range(600).select(F.concat(F.lit("p"), (F.col("id") % 200) % 3).alias("property_id"), F.lit("2").alias("floor"), F.concat(F.lit("AHU_"), F.col("id") % 200).alias("key"), F.lit("s").alias("source"), F.col("id").cast("string").alias("detail")).where("id % 200 <> 7")
    spark.sql(f"CREATE DATABASE inbox_test LOCATION '{tmp_path}/db'")
    try:
        sinks.write_bucketed(inbox.keyed_units(units), "inbox_test.units", inbox.KEYS, 4)
        sinks.write_bucketed(inbox.evidence_by_key(rows), "inbox_test.evidence", inbox.KEYS, 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = inbox.equipment(spark.table("inbox_test.units"), spark.table("inbox_test.evidence"))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        rows = {r["canonical_name"]: r for r in got.collect()}
        assert len(rows) == 200 and {r["n_evidence"] for n, r in rows.items() if n != "AHU 07"} == {3} and rows["AHU 07"]["evidence"] == []
        assert [e["detail"] for e in rows["AHU 011"]["evidence"]] == ["11", "211", "411"] and rows["AHU 011"]["files"] == ["a.png", "b.png"]
        one = got.where("property_id = 'p1'")
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString() and "PushedFilters: [IsNotNull(property_id), EqualTo(property_id,p1)" in one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE inbox_test CASCADE")


def test_views_of_the_inbox(spark):
    report = spark.createDataFrame([("b", "u1", "floor_ambiguous"), ("b", "u2", "floor_ambiguous"), ("b", "u3", "matched")], "building string, equipment_id string, status string")
    rulings = spark.createDataFrame([("b", "u2", "4"), ("b", "u2", "3"), ("b", "u3", "9")], "building string, equipment_id string, resolved_floor string")
    assert {r["equipment_id"]: (r["status"], r["resolved_floor"]) for r in inbox.gaps(report, rulings).collect()} == {"u1": ("resolved_out_of_scope", "1"), "u2": ("resolved_out_of_scope", "3"), "u3": ("matched", None)}
    edges = spark.createDataFrame([("p", "1", "a", "airRef", "b"), ("p", "2", "a", "airRef", "b"), (None, "1", "c", "airRef", "d")], "property_id string, floor string, child string, ref_type string, parent string")
    found = spark.createDataFrame([("p", "1", "cycle", "error", "m"), ("p", "3", "x", "review", "m"), ("p", "4", "o", "orphan", "m")], "property_id string, floor string, check_id string, severity string, message string")
    view = inbox.relationships(edges, found)
    assert {(r["property_id"], r["floor"]): (r["edges"], r["errors"], r["orphans"], r["review_items"], r["passed"]) for r in view["summary"].collect()} == {
        ("p", "1"): (1, 1, 0, 0, False), ("p", "2"): (1, 0, 0, 0, True), ("", "1"): (1, 0, 0, 0, True), ("p", "3"): (0, 0, 0, 1, True), ("p", "4"): (0, 0, 1, 0, False)
    }
    assert view["orphans"].count() == 1
    units = spark.createDataFrame([("p", "1", "u"), ("p", "2", "u"), ("p", "1", "u")], "property_id string, floor string, canonical_name string")
    applied = spark.createDataFrame([("p", "1", "equipment", "u"), ("p", "2", "relationship", "a|airRef|b")], "property_id string, floor string, item_type string, item_key string")
    left = inbox.pending(units, view["edges"], applied)
    assert {tuple(r) for r in left.collect()} == {("p", "2", "equipment", "u"), ("p", "1", "relationship", "a|airRef|b"), ("", "1", "relationship", "c|airRef|d")}


def test_ledger_lists(spark):
    sessions = spark.createDataFrame([("s2", "f", "open", None, 2, 3), ("s1", "f", "open", "x", 1, 1)], "session_id string, floor string, status string, created_by string, created_at int, n_open int")
    events = spark.createDataFrame([("s2", "equipment", "a", "approve", 1, 1, None), ("s2", "equipment", "b", "reject", 1, 2, None), ("s2", "equipment", "b", "clear", 2, 3, None)], "session_id string, item_type string, item_key string, action string, created_at int, action_id int, source_item string")
    got = inbox.sessions_list(sessions, events).collect()
    assert [(r["session_id"], r["n_pending"], r["n_approved"], r["n_rejected"]) for r in got] == [("s1", 1, 0, 0), ("s2", 2, 1, 0)]
    log = spark.createDataFrame([("c2", True, 1), ("c3", None, 3), ("c1", False, 3)], "correction_id string, fed_to_fewshot boolean, created_at int")
    assert [r["correction_id"] for r in inbox.unfed(log).collect()] == ["c1", "c3"]
    live = spark.createDataFrame([("s", "equipment", "a", "approve"), ("s", "equipment", "z", "reject")], "session_id string, item_type string, item_key string, action string")
    keys = spark.createDataFrame([("s", "equipment", "a"), ("s", "equipment", "a"), ("s", "equipment", "b")], "session_id string, item_type string, item_key string")
    assert inbox.progress(live, keys).first().asDict() == {"session_id": "s", "total": 2, "approved": 1, "rejected": 0, "left": 1}


def test_topics_are_grouped_covered_and_checked(spark):
    names = spark.createDataFrame([("p", "Floor_02", "Floor_02/DEV7_AHU_1/x"), ("p", "Floor_02", "Floor_02/AHU_1/y"), ("q", "Floor_02", "Floor_02/AHU_1/y")], "property_id string, floor string, topic_name string")
    unit = "property_id string, floor string, raw_label string, equipment_type string, source_topics array<string>, review_required boolean, review_reason string"
    good = [("p", "Floor_02", "AHU_1", "AHU", ["Floor_02/DEV7_AHU_1/x", "Floor_02/AHU_1/y"], False, ""), ("q", "Floor_02", "AHU_1", "VAV", ["Floor_02/AHU_1/y"], False, "")]
    out = stages.topics_to_units(names, lambda d: spark.createDataFrame(good, unit))
    assert out["coverage"].count() == 0 and {r["property_id"]: r["review_reason"] for r in out["units"].collect()} == {"p": "", "q": "type 'VAV' not evident in path label 'AHU_1'"}
    bad = [("p", "Floor_02", "AHU_1", "AHU", ["Floor_02/AHU_1/y", "Floor_02/AHU_1/y", "made/up"], False, "")]
    odd = stages.topics_to_units(names, lambda d: spark.createDataFrame(bad, unit), strict=False)["coverage"]
    assert {(r["property_id"], r["topic_name"], r["kind"], r["n"]) for r in odd.collect()} == {("p", "Floor_02/DEV7_AHU_1/x", "missing", 1), ("q", "Floor_02/AHU_1/y", "missing", 1), ("p", "Floor_02/AHU_1/y", "duplicate", 1), ("p", "made/up", "unexpected", 1)}
    with pytest.raises(readers.ContractError, match="missing|duplicate|unexpected"):
        stages.topics_to_units(names, lambda d: spark.createDataFrame(bad, unit))


def test_records_of_a_folder(spark, tmp_path):
    png = lambda w, h: bytes.fromhex("89504E470D0A1A0A0000000D49484452") + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, content in {"big.png": png(4000, 3000), "deep/small.PNG": png(10, 10), "a.pdf": b"%PDF", "b.txt": b"x", "broken.png": b"no"}.items():
        (tmp_path / "in" / name).write_bytes(content)
    have = spark.createDataFrame([("raw/png/big.png",)], "key string")
    out = stages.folder_to_records(spark, str(tmp_path / "in"), "raw", have)
    got = {kind: {r["relative_path"]: r["plan_status"] for r in d.collect()} for kind, d in out.items()}
    assert got == {"prepared": {"big.png": "conflict"}, "failures": {"deep/small.PNG": "planned", "broken.png": "planned"}, "deferred": {"a.pdf": "planned"}, "unsupported": {"b.txt": "skipped"}}
    assert out["prepared"].first()["image_class"] == "drawing" and len(out["prepared"].first()["sha256"]) == 64
