"""Calls of users' functions under a bound and with a log of answers; documents and counters written in one pass."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from assayer.operators import inject
from assayer.sources import sinks


def test_calls_are_parallel_and_bounded(spark, tmp_path):
    def slow(row):
        mark = tmp_path / f"on-{row['id']}"
        mark.touch()
        on = len(list(tmp_path.glob("on-*")))
        time.sleep(0.05)
        mark.unlink()
        return str(on)

    rows = spark.range(60)
    got = [int(r["payload"]) for r in inject.extracted(rows, slow, "id", concurrency=4, tasks=1).collect()]
    assert len(got) == 60 and 1 < max(got) <= 4
    with pytest.raises(ValueError):
        inject.extracted(rows, slow, "id", concurrency=0)


def test_coroutines_are_awaited_and_tried_again(spark, tmp_path):
    async def flaky(row):
        tries = tmp_path / str(row["id"])
        n = len(tries.read_text()) if tries.exists() else 0
        tries.write_text("x" * (n + 1))
        if n < row["id"]:
            raise RuntimeError("busy " + "." * 400)
        return f"answer {row['id']}"

    got = {r["id"]: r for r in inject.extracted(spark.range(4).coalesce(1), flaky, "id", concurrency=8, retries=2, pause=0.01).collect()}
    assert [got[k]["run_status"] for k in range(4)] == ["succeeded"] * 3 + ["parse_failure"]
    assert got[2]["payload"] == "answer 2" and len(got[3]["error"]) == 300 and (tmp_path / "3").read_text() == "xxx"


def test_answers_of_a_lost_task_are_not_asked_again(spark, tmp_path):
    asked, alive = tmp_path / "asked", tmp_path / "alive"
    asked.mkdir()

    def fn(row):
        if row["id"] == 7 and not alive.exists():
            os._exit(1)  # the worker is lost
        (asked / f"{row['id']}-{time.time_ns()}").touch()
        return f"answer {row['id']}"

    rows, log = spark.range(10).coalesce(1), inject.FolderLog(f"file://{tmp_path}/log")
    with pytest.raises(Exception):
        inject.extracted(rows, fn, "id", log=log).collect()
    before = len(list(asked.iterdir()))
    alive.touch()
    got = inject.extracted(rows, fn, "id", log=log).collect()
    assert before == 7 and len(list(asked.iterdir())) == 10 and {r["payload"] for r in got} == {f"answer {k}" for k in range(10)}


def test_a_ladder_keeps_answers_by_tier(spark, tmp_path):
    tiers = [lambda r: "no", lambda r: "ok" if r["id"] else "no"]
    log = inject.FolderLog(f"file://{tmp_path}/log")
    d = inject.ladder(spark.range(2), tiers, "id", F.col("result") == "ok", save=lambda x: x.checkpoint(), log=log, concurrency=2)
    assert {r["id"]: (r["tier"], r["accepted"]) for r in d.collect()} == {0: (1, False), 1: (1, True)}
    assert (log.get("tier 0|1"), log.get("tier 1|1"), log.get("tier 2|1")) == ("no", "ok", None)


def test_documents_stream_to_their_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select(
            F.when(F.col("id") < 2900, "p1").when(F.col("id") < 2999, "p2").otherwise("p/3").alias("property_id"), F.lit("Floor_01").alias("floor"), (3000 - F.col("id")).alias("seq"),
            F.format_string('c"%d', "id").alias("child"), F.when(F.col("id") % 2 == 0, "x").alias("note"),
        )
        sinks.write_documents(rows, {"schema_version": "1.0", "n": None}, str(tmp_path / "docs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {}
    for folder in (tmp_path / "docs").glob("property_id=*/floor=Floor_01"):
        parts = sorted(folder.glob("part-*"))
        found[folder.parent.name] = (json.loads("".join(p.read_text() for p in parts)), len(parts))
    assert set(found) == {"property_id=p1", "property_id=p2", "property_id=p%2F3"} and found["property_id=p1"][1] > 1
    one = found["property_id=p1"][0]
    assert list(one) == ["schema_version", "n", "relationships"] and [r["seq"] for r in one["relationships"]] == list(range(101, 3001))
    assert one["relationships"][0] == {"seq": 101, "child": 'c"2899', "note": None} and len(found["property_id=p%2F3"][0]["relationships"]) == 1
    with pytest.raises(ValueError):
        sinks.write_documents(rows.drop("property_id", "floor"), {}, str(tmp_path / "none"))


def test_counters_come_with_the_write(spark, tmp_path):
    d = spark.range(10).withColumn("status", F.when(F.col("id") < 3, "failed").otherwise("succeeded"))
    metrics = {"rows": F.count(F.lit(1)), "failed": F.count_if(F.col("status") == "failed"), "kinds": F.max("status")}
    for run in ("r1", "r2"):
        told = sinks.write_counted(d, str(tmp_path / "out"), metrics, log=str(tmp_path / "log"), run={"run_id": run})
        assert told == {"rows": 10, "failed": 3, "kinds": "succeeded"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert {(r["run_id"], r["rows"], r["failed"]) for r in spark.read.json(str(tmp_path / "log")).collect()} == {("r1", 10, 3), ("r2", 10, 3)}
    assert sinks.write_counted(d.where("false"), str(tmp_path / "out"), metrics)["rows"] == 0
