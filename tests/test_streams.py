"""Keyed state of streams: late and repeated events, restarts, work in proportion to the batch; and rows of files by number."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators import review
from assayer.sources import numbered, readers
from assayer.streaming import incremental

EVENTS = "session_id string, item_type string, item_key string, action string, created_at long, action_id string"


def arrives(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_counters_follow_late_and_repeated_events(spark, tmp_path):
    rng = random.Random(3)
    every = [(f"s{rng.randrange(3)}", "equipment", f"i{rng.randrange(6)}", rng.choice(["approve", "edit", "reject", "clear"]), rng.randrange(40), f"a{k:03d}") for k in range(60)]
    seen = []
    for k in range(0, 60, 20):
        batch = every[k : k + 20] + every[max(0, k - 5) : k]  # five events arrive again
        arrives(spark, batch, EVENTS, tmp_path / "in")
        seen += batch
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))  # a new stream each time: restarts from the checkpoint
        q = incremental.live_counters(stream, str(tmp_path / "changes"), str(tmp_path / "cp"))
        assert q.lastProgress["stateOperators"][0]["numRowsUpdated"] <= 25
        want = {r["session_id"]: (r["n_approved"], r["n_rejected"]) for r in review.session_counts(review.live_actions(spark.createDataFrame(seen, EVENTS).distinct())).collect()}
        got = {r["session_id"]: (r["n_approved"], r["n_rejected"]) for r in incremental.counters(spark, str(tmp_path / "changes")).collect()}
        assert {s: n for s, n in got.items() if n != (0, 0)} == {s: n for s, n in want.items() if n != (0, 0)}


def test_a_batch_writes_its_own_changes_only(spark, tmp_path):
    run = lambda: incremental.live_counters(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "changes"), str(tmp_path / "cp"))
    arrives(spark, [(f"s{k}", "e", "i", "approve", 1, "a") for k in range(500)], EVENTS, tmp_path / "in")
    run()
    arrives(spark, [("s7", "e", "i", "reject", 2, "b"), ("s8", "e", "i", "approve", 1, "a"), ("s9", "e", "i", "reject", 0, "z")], EVENTS, tmp_path / "in")
    assert run().lastProgress["stateOperators"][0]["numRowsUpdated"] == 1
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "changes" / "batch=1")).collect()} == {("s7", -1, 1)}
    assert incremental.counters(spark, str(tmp_path / "changes")).agg(F.sum("n_approved"), F.sum("n_rejected")).first()[:] == (499, 1)


def test_work_resumes_where_it_has_not_succeeded(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def work(todo):
        keys = [r["key"] for r in todo.collect()]
        (calls / str(len(list(calls.iterdir())))).write_text(" ".join(sorted(keys)))
        tries = sum("bad" in f.read_text().split() for f in calls.iterdir())
        return todo.select("key", F.when((F.col("key") == "bad") & F.lit(tries < 2), "parse_failed").otherwise("succeeded").alias("status"), "body")

    def run():
        stream = spark.readStream.schema("key string, body string").parquet(str(tmp_path / "in"))
        return incremental.resumable(stream, str(tmp_path / "done"), work, str(tmp_path / "cp"))

    def worked():
        return sorted(" ".join(f.read_text() for f in calls.iterdir()).split())

    arrives(spark, [("a", "1"), ("bad", "2"), ("a", "again"), (None, "x")], "key string, body string", tmp_path / "in")
    run()
    assert worked() == ["a", "bad"]
    arrives(spark, [("a", "1"), ("bad", "2"), ("c", "3")], "key string, body string", tmp_path / "in")
    run()
    assert worked() == ["a", "bad", "bad", "c"]
    arrives(spark, [("a", "1"), ("bad", "2"), ("c", "3")], "key string, body string", tmp_path / "in")
    q = run()
    assert worked() == ["a", "bad", "bad", "c"]
    assert max(p["numInputRows"] for p in q.recentProgress) <= 5  # three rows, and the two results since
    done = spark.read.parquet(str(tmp_path / "done"))
    assert {(r["key"], r["status"]) for r in done.collect()} == {("a", "succeeded"), ("bad", "parse_failed"), ("bad", "succeeded"), ("c", "succeeded")}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_many_splits(spark, tmp_path, small_splits):
    schema = T.StructType.fromDDL("a int, b string")
    bad = {17: "", 400: '{"a": 1', 401: "[1]", 777: '{"a": "x"}', 1000: "  "}
    for name, shift in (("one", 0), ("two", 3)):
        lines = [bad.get(k - shift, f'{{"a": {k}, "b": "é{k}", "more": 1}}') for k in range(1, 1200)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    good, wrong = numbered.json_lines(spark, str(tmp_path / "*.jsonl"), schema)
    assert spark.read.text(str(tmp_path / "one.jsonl")).rdd.getNumPartitions() > 20
    got = {(r["file"].rsplit("/", 1)[1], r["row"]): r["rule"] for r in wrong.collect()}
    rules = {17: "blank JSONL record", 400: "not a JSON object", 401: "not a JSON object", 777: "fields of other types", 1000: "blank JSONL record"}
    assert got == {(f"{n}.jsonl", k + s): rules[k] for n, s in (("one", 0), ("two", 3)) for k in rules}
    assert good.count() == 2 * (1199 - 5) and good.agg(F.sum("a")).first()[0] == sum(k for s in (0, 3) for k in range(1, 1200) if k - s not in bad)
    with pytest.raises(readers.ContractError, match=r"one.jsonl: blank JSONL record at line 17; .*not a JSON object at line 400"):
        numbered.strict_json_lines(spark, str(tmp_path / "one.jsonl"), schema)
    (tmp_path / "fine.jsonl").write_text('{"a": 1}\n{"b": "x"}\n')
    assert sorted(map(str, numbered.strict_json_lines(spark, str(tmp_path / "fine.jsonl"), schema).collect())) == ["Row(a=1, b=None)", "Row(a=None, b='x')"]
    (tmp_path / "none.jsonl").write_text("")
    assert numbered.strict_json_lines(spark, str(tmp_path / "none.jsonl"), schema).count() == 0


def test_rows_of_a_csv_are_numbered_from_the_header(spark, tmp_path, small_splits):
    rows = [f"n{k},{k if k not in (50, 333) else 'many'},{'true' if k != 200 else ''}" for k in range(2, 600)]
    (tmp_path / "a.csv").write_text("name,size,flag\n" + "\n".join(rows) + "\n")
    schema = T.StructType.fromDDL("name string, size int, flag boolean")
    good, bad = numbered.csv_rows(spark, str(tmp_path / "a.csv"), schema, {"flagged": F.col("flag").isNotNull(), "named": F.col("name") != "n7"})
    assert {(r["row"], r["rule"]): r["size"] for r in bad.collect()} == {(50, "size is no int"): "many", (333, "size is no int"): "many", (200, "flagged"): "200", (7, "named"): "7"}
    assert good.count() == 594
    with pytest.raises(readers.ContractError, match="a.csv: CSV row 50 failed validation: size is no int"):
        numbered.strict_csv_rows(spark, str(tmp_path / "a.csv"), schema)
