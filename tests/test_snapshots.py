"""Snapshots in folders: order of rows, and reading of the folders that are asked for."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators import images
from assayer.sources import readers, sinks

SCHEMA = "snapshot_version string, property_id string, floor string, raw_label string, n int"


def made(spark):
    rows = [(v, p, f, label, k) for v in ("2024-01", "2024-02") for p in ("007", "b") for f in ("1", "2") for k, label in enumerate(["b", "A", "a", "B", "Ä", "c"])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_rows_stand_in_order_over_a_folder(spark, tmp_path):
    sinks.write_snapshot(made(spark), str(tmp_path / "s"), order=["raw_label"])
    files = sorted((tmp_path / "s" / "snapshot_version=2024-01" / "property_id=007" / "floor=1").glob("*.parquet"))
    assert [r["raw_label"] for f in files for r in spark.read.parquet(str(f)).collect()] == ["A", "a", "B", "b", "c", "Ä"]
    sinks.write_csv(made(spark).where("snapshot_version = '2024-01' AND property_id = 'b' AND floor = '1'"), str(tmp_path / "c"), ["raw_label", "n"], order=["raw_label"])
    lines = [line for f in sorted((tmp_path / "c").glob("*.csv")) for line in f.read_text().splitlines()[1:]]
    assert [line.split(",")[0] for line in lines] == ["A", "a", "B", "b", "c", "Ä"]


def test_only_the_folders_asked_for_are_read(spark, tmp_path):
    sinks.write_snapshot(made(spark), str(tmp_path / "s"))
    schema = T.StructType.fromDDL(SCHEMA)
    one = readers.snapshot(spark, str(tmp_path / "s"), schema, snapshot_version="2024-02", property_id="007")
    assert one.columns == schema.names and one.count() == 12 and {r["property_id"] for r in one.collect()} == {"007"}
    assert len(one.inputFiles()) <= 40 and "PartitionFilters: [isnotnull(snapshot_version" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scopes = spark.createDataFrame([("b", "2"), ("b", "2"), ("zz", "9")], "property_id string, floor string")
    some = readers.snapshot(spark, str(tmp_path / "s"), schema, scopes, snapshot_version="2024-01")
    assert {(r["snapshot_version"], r["property_id"], r["floor"]) for r in some.collect()} == {("2024-01", "b", "2")} and some.count() == 6
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_version" in plan and "concat_ws" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "Join" not in plan
    assert readers.snapshot(spark, str(tmp_path / "s"), schema, floor="none").count() == 0


def test_many_scopes_meet_in_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "SCOPES", 1)
    sinks.write_snapshot(made(spark), str(tmp_path / "s"))
    scopes = spark.createDataFrame([("b", "2"), ("007", "1"), (None, "1")], "property_id string, floor string")
    assert readers.snapshot(spark, str(tmp_path / "s"), T.StructType.fromDDL(SCHEMA), scopes).count() == 24


def test_rejected_paths_meet_nothing(spark):
    rows = [("../x", "png")] * 300 + [("a.png", "png"), ("a.png", "png"), ("b.png", "png"), ("c.txt", "unsupported")]
    plan = images.preservation_plan(spark.createDataFrame(rows, "relative_path string, file_type string"), spark.createDataFrame([("raw/png/b.png",)], "key string"), "raw")
    assert {(r["relative_path"], r["status"]): r["n"] for r in plan.groupBy("relative_path", "status").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        ("../x", "rejected"): 300, ("a.png", "duplicate"): 2, ("b.png", "conflict"): 1, ("c.txt", "skipped"): 1
    }
